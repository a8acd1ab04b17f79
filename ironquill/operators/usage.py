"""Usage, quotas, trends, audit, dashboards.  "Today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.small import small_table
from ..functions.text import first_match
from ..rules.plan_limits import (
    AUDIT_MAX_ROWS, FEATURES, PAID_PLANS, PLAN_COLUMNS, PLAN_LABELS, PLAN_LIMITS, TREND_MAX_ROWS)
from .sliced import first_rows, running_count

PLANS = tuple(p[0] for p in PLAN_LIMITS)


def _day(today) -> Column:
    return today if isinstance(today, Column) else F.to_date(F.lit(str(today)))


def plan_limits_table(spark: SparkSession, limits=PLAN_LIMITS) -> DataFrame:
    return small_table(
        spark, limits, "plan string, daily_scans int, daily_repos int, history_limit int, ai_depth string, "
        + ", ".join(f"{f} boolean" for f in FEATURES))


def plan_of(col: Column) -> Column:
    """Lower case; empty or missing is free."""
    return F.lower(F.coalesce(F.nullif(col, F.lit("")), F.lit("free")))


def limits_plan(col: Column) -> Column:
    """The plan whose limits apply: unknown plans have those of free."""
    plan = plan_of(col)
    return F.when(plan.isin(*PLANS), plan).otherwise("free")


def plan_label(plan: Column) -> Column:
    return first_match([(plan == p, F.lit(t)) for p, t in PLAN_LABELS.items()], F.lit("Free"))


def _with_limits(users: DataFrame, limits: DataFrame) -> DataFrame:
    return users.withColumn("_lp", limits_plan(F.col("plan"))).join(
        limits.withColumnRenamed("plan", "_lp"), "_lp", "left").drop("_lp")


def plan_gate(users: DataFrame, feature: str, limits: DataFrame | None = None) -> DataFrame:
    """Add ``allowed`` for one feature."""
    limits = plan_limits_table(users.sparkSession) if limits is None else limits
    if feature == "repo_scan":
        return users.withColumn("allowed", F.lit(True))
    flag = F.col(feature) if feature in PLAN_COLUMNS else F.lit(False)
    paid = plan_of(F.col("plan")).isin(*PAID_PLANS)
    out = _with_limits(users, limits)
    return out.withColumn("allowed", paid | F.coalesce(flag, F.lit(False))).select(*users.columns, "allowed")


def team_members(users: DataFrame, org_id: str | None = None) -> DataFrame:
    """Members of one organisation, or of all (with ``org_id``) when none is given."""
    cols = ["id", "email", "plan", "trial_active", "is_pro", "created_at"]
    if org_id is None:
        return users.filter(F.col("org_id").isNotNull()).select("org_id", *cols)
    return users.filter(F.col("org_id") == org_id).select(*cols)


def user_org_limits(users: DataFrame, orgs: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """User with organisation name and plan limits."""
    limits = plan_limits_table(users.sparkSession) if limits is None else limits
    named = users.join(orgs.select(F.col("id").alias("org_id"), F.col("name").alias("org_name")), "org_id", "left")
    return _with_limits(named, limits).withColumn("plan_label", plan_label(plan_of(F.col("plan"))))


# ---- usage ---------------------------------------------------------------------

def usage_daily(requests: DataFrame) -> DataFrame:
    return requests.groupBy("user_id", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("request_count"))


def quota_check(requests: DataFrame, users: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Running count per user and day against the plan's daily limit.

    Counting goes by minute slices, so a user with a huge day is no bottleneck.
    Requests of unknown users count against the free plan.
    """
    limits = plan_limits_table(requests.sparkSession) if limits is None else limits
    days = requests.select("req_id", "user_id", "ts", F.to_date("ts").alias("date"),
                           F.date_trunc("minute", "ts").alias("_slice"))
    counted = running_count(days, ["user_id", "date"], "_slice", ["ts", "req_id"], "usage_count").drop("_slice")
    plans = users.select(F.col("id").alias("user_id"), "plan")
    cap = F.col("daily_scans")
    return _with_limits(counted.join(plans, "user_id", "left"), limits).select(
        *counted.columns, plan_of(F.col("plan")).alias("plan"), "daily_scans").withColumn(
        "allowed", (cap == -1) | (F.col("usage_count") <= cap))


def usage_meter(usage: DataFrame, used: str = "request_count", limit: str = "daily_scans") -> DataFrame:
    """Add ``unlimited``, ``pct`` and ``band``; pct and band are null when unlimited."""
    n, cap = F.coalesce(F.col(used), F.lit(0)), F.col(limit)
    unlimited = F.coalesce((cap == 0) | (cap < 0) | (cap > 9000), F.lit(True))
    pct = F.least(F.lit(100), F.floor(F.greatest(F.lit(0), n) / cap * 100 + 0.5)).cast("bigint")
    return (usage.withColumn("unlimited", unlimited)
            .withColumn("pct", F.when(~F.col("unlimited"), pct))
            .withColumn("band", F.when(F.col("pct") >= 90, "danger").when(F.col("pct") >= 70, "warning")
                        .when(F.col("pct").isNotNull(), "success")))


def usage_history(usage: DataFrame, n: int = 30) -> DataFrame:
    """The last ``n`` day rows of each user, newest first."""
    return first_rows(usage, ["user_id"], [F.col("date").desc()], n)


def usage_7day_series(usage: DataFrame, users: DataFrame, today, days: int = 7) -> DataFrame:
    """Every user's last ``days`` days ending today, zero where nothing was used."""
    end = _day(today)
    start = F.date_sub(end, days - 1)
    # At most one entry per day of the range.
    counts = (usage.filter(F.col("date").between(start, end)).groupBy("user_id", "date")
              .agg(F.max("request_count").alias("n")).groupBy("user_id")
              .agg(F.map_from_entries(F.collect_list(F.struct("date", "n"))).alias("_by_day")))
    rows = (users.select(F.col("id").alias("user_id")).join(counts, "user_id", "left")
            .select("user_id", "_by_day", F.explode(F.sequence(start, end)).alias("date")))
    return rows.select("user_id", "date", F.coalesce(F.try_element_at("_by_day", F.col("date")), F.lit(0))
                       .alias("request_count"))


# ---- scans ---------------------------------------------------------------------

def recent_scans(scans: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` scans of each user."""
    cols = ["user_id", "id", "source", "risk_level", "total_secrets", "created_at"]
    return first_rows(scans.select(*cols), ["user_id"], [F.col("created_at").desc(), F.col("id").desc()], n)


def recent_scans_by_plan(scans: DataFrame, users: DataFrame, limits: DataFrame | None = None,
                         at_most: int = 20) -> DataFrame:
    """As :func:`recent_scans`, cut to the plan's history limit."""
    limits = plan_limits_table(scans.sparkSession) if limits is None else limits
    caps = _with_limits(users.select(F.col("id").alias("user_id"), "plan"), limits).select("user_id", "history_limit")
    return recent_scans(scans, at_most).join(caps, "user_id").filter(
        F.col("rank") <= F.col("history_limit")).drop("history_limit")


def scan_score(result_json: Column) -> Column:
    """Stored score: ``security_score`` if that key exists (even as null), else ``score``."""
    has = F.array_contains(F.json_object_keys(result_json), F.lit("security_score"))
    raw = F.when(has, F.get_json_object(result_json, "$.security_score")).otherwise(
        F.get_json_object(result_json, "$.score"))
    return raw.try_cast("double").cast("int")


def trend_points(scans: DataFrame, now, days: int = 30, max_rows: int = TREND_MAX_ROWS) -> DataFrame:
    """Score points of each user: the oldest ``max_rows`` scans of the last ``days`` days."""
    end = now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")
    since = end - F.make_interval(days=F.lit(days))
    recent = scans.filter(F.col("created_at") >= since).select("user_id", "id", "created_at", "result_json")
    kept = first_rows(recent, ["user_id"], ["created_at", "id"], max_rows)
    return (kept.withColumn("score", scan_score(F.col("result_json"))).filter(F.col("score").isNotNull())
            .select("user_id", "id", "rank", F.to_date("created_at").alias("date"), "score"))


def security_trend(scans: DataFrame, now, days: int = 30, users: DataFrame | None = None) -> DataFrame:
    """Average (one decimal), best, worst and number of the trend points; zeros when none."""
    agg = trend_points(scans, now, days).groupBy("user_id").agg(
        F.bround((F.sum("score") / F.count("score")).cast("decimal(20,12)"), 1).cast("double").alias("average_score"),
        F.max("score").alias("best_score"), F.min("score").alias("worst_score"), F.count(F.lit(1)).alias("count"))
    if users is None:
        return agg
    joined = users.select(F.col("id").alias("user_id")).join(agg, "user_id", "left")
    return joined.select("user_id", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("average_score", "best_score", "worst_score", "count")])


def sort_trend(scans: DataFrame, n: int) -> DataFrame:
    return scans.orderBy("created_at", "id").limit(n)


def sort_history(scans: DataFrame, n: int) -> DataFrame:
    return scans.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


sort_audit = sort_history


def audit_search(audit: DataFrame, org_id: str | None = None, user_id: str | None = None,
                 limit: int = 50, action_filter: str = "") -> DataFrame:
    """Newest audit rows of an organisation, else of a user; nothing without either."""
    limit = max(1, min(int(limit or 50), AUDIT_MAX_ROWS))
    if org_id:
        out = audit.filter(F.col("org_id") == org_id)
    elif user_id:
        out = audit.filter(F.col("user_id") == user_id)
    else:
        return audit.filter(F.lit(False))
    if action_filter:  # wildcards in the filter keep their meaning
        out = out.filter(F.col("action").ilike(f"%{action_filter}%"))
    return sort_audit(out, limit)


def dashboard_bundle(users: DataFrame, usage: DataFrame, scans: DataFrame, today,
                     limits: DataFrame | None = None) -> DataFrame:
    """One row per user: plan, today's use and limit, last 30 usage days, last 10 scans, team size.

    The children are cut to their top rows before they are gathered.  The team
    itself is shared by its members: read it from :func:`team_members`.
    """
    limits = plan_limits_table(users.sparkSession) if limits is None else limits
    series = (usage_history(usage, 30).groupBy("user_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "date", "request_count"))).alias("usage_series")))
    history = (recent_scans(scans, 10).groupBy("user_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "id", "source", "risk_level", "total_secrets", "created_at"))).alias("history")))
    now = usage.filter(F.col("date") == _day(today)).groupBy("user_id").agg(
        F.max("request_count").alias("usage_today"))
    teams = users.groupBy("org_id").agg(F.count(F.lit(1)).alias("team_size"))
    base = _with_limits(users.select("id", "email", "plan", "org_id"), limits).select(
        F.col("id").alias("user_id"), "email", plan_of(F.col("plan")).alias("plan"), "org_id",
        F.col("daily_scans").alias("usage_limit"))
    return (base.join(now, "user_id", "left").join(series, "user_id", "left").join(history, "user_id", "left")
            .join(teams, "org_id", "left")
            .withColumn("usage_today", F.coalesce("usage_today", F.lit(0)))
            .withColumn("team_size", F.coalesce("team_size", F.lit(0))))
