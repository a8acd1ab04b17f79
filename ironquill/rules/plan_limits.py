"""Plans, quotas, rate limits, trial length, payment events."""

PLAN_COLUMNS = (
    "plan", "daily_scans", "daily_repos", "history_limit", "ai_depth", "repo_scan",
    "pdf_download", "json_export", "advanced_ai", "scheduled_scans", "api_access",
)
# -1 = unlimited
PLAN_LIMITS = (
    ("free", 5, 2, 10, "basic", True, False, False, False, False, False),
    ("pro_trial", -1, -1, 500, "full", True, True, True, True, True, True),
    ("pro", -1, -1, 500, "full", True, True, True, True, True, True),
    ("enterprise", -1, -1, 9999, "full", True, True, True, True, True, True),
)
PLAN_LABELS = {"free": "Free", "pro_trial": "Pro Trial", "pro": "Pro", "enterprise": "Enterprise"}
PAID_PLANS = ("pro", "pro_trial", "enterprise")
FEATURES = PLAN_COLUMNS[5:]

RATE_LIMITS = {"auth": 5, "scan": 30, "payment": 10, "default": 60}
RATE_WINDOW_SECONDS = 60

TRIAL_DAYS = 30
TREND_MAX_ROWS = 500
AUDIT_MAX_ROWS = 200
LOG_VALUE_CHARS = 500

EPSS_EXPLOIT_THRESHOLD = 0.1
CVE_QUERY_MIN_CHARS = 2
CVE_QUERY_MAX_CHARS = 100

EV_ACTIVATED = "BILLING.SUBSCRIPTION.ACTIVATED"
EV_RENEWED = ("BILLING.SUBSCRIPTION.RENEWED", "PAYMENT.SALE.COMPLETED")
EV_FAILED = ("BILLING.SUBSCRIPTION.PAYMENT.FAILED", "BILLING.SUBSCRIPTION.SUSPENDED")
EV_CANCELLED = "BILLING.SUBSCRIPTION.CANCELLED"
EV_CAPTURE = "PAYMENT.CAPTURE.COMPLETED"
# Requests of the user (not sent by the payment provider).
EV_USER_CANCEL = "USER_CANCELLED"
EV_MANUAL = "MANUAL"
EV_CHECKOUT = "SUBSCRIPTION_ACTIVATED"
EV_ORDER_CAPTURED = "ORDER_CAPTURED"
