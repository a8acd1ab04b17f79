"""Incoming requests: address, bucket, hostile queries, validation, rate limits.

A *requests* DataFrame has ``req_id, ts, user_id, method, path, query,
content_type, cf_ip, real_ip, fwd_for, peer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.small import small_table
from ..functions.regex import jvm
from ..functions.text import first_match, html_escape, strip
from ..rules.literal_rules import INJECTION_REGEXES
from ..rules.plan_limits import RATE_LIMITS, RATE_WINDOW_SECONDS
from ..rules.scan_limits import MAX_TEXT_CHARS, REPO_HOSTS, REPO_URL_PREFIX

from .rate_windows import anchored_windows

# ---- per-request columns ----------------------------------------------------

def request_bucket(path: Column) -> Column:
    return (F.when(F.startswith(path, F.lit("/auth/")), "auth")
            .when(F.contains(path, F.lit("/analyze")) | F.contains(path, F.lit("/scan")), "scan")
            .when(F.startswith(path, F.lit("/payment/")), "payment").otherwise("default"))


def client_ip(*headers: Column, peer: Column) -> Column:
    """First header that is set, up to its first comma; else the peer."""
    value = F.coalesce(*[F.nullif(h, F.lit("")) for h in headers])
    return F.when(value.isNotNull(), strip(F.substring_index(value, ",", 1))).otherwise(
        F.coalesce(peer, F.lit("unknown")))


def looks_malicious(text: Column, regexes=INJECTION_REGEXES) -> Column:
    test = F.lit(False)
    for r in regexes:
        test = test | F.rlike(text, F.lit(jvm("(?i)" + r)))
    return F.coalesce(test, F.lit(False))


def injection_filter(requests: DataFrame) -> DataFrame:
    """Add ``flagged`` for hostile query strings."""
    return requests.withColumn("flagged", looks_malicious(F.col("query")))


def content_type_guard(requests: DataFrame) -> DataFrame:
    """Add ``reject`` for writes of HTML to the API."""
    bad = (F.col("method").isin("POST", "PUT", "PATCH") & F.contains("content_type", F.lit("text/html"))
           & F.startswith("path", F.lit("/api/")))
    return requests.withColumn("reject", F.coalesce(bad, F.lit(False)))


# ---- validation --------------------------------------------------------------

def _url_parts(url: Column) -> tuple[Column, Column, Column]:
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#@:]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    return scheme, host, path


def validate_repo_urls(rows: DataFrame, url: str = "url") -> DataFrame:
    """Add ``ok`` and ``reason`` (null when ok); the first failing rule is the reason."""
    value = strip(F.col(url))
    scheme, host, path = _url_parts(value)
    parts = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    reason = (F.when(~F.startswith(value, F.lit(REPO_URL_PREFIX)) & (scheme == "https") & host.isin(*REPO_HOSTS),
                     "Only GitHub HTTPS URLs are supported")
              .when(scheme != "https", "Only HTTPS repository URLs are accepted.")
              .when(~host.isin(*REPO_HOSTS), "Only GitHub (github.com) repositories are supported.")
              .when(parts < 2, "URL must point to a specific repository: https://github.com/owner/repo"))
    return rows.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def validate_registrations(rows: DataFrame) -> DataFrame:
    """Normalise ``email, password, org_name`` and add one error per field and ``ok``."""
    email = strip(F.lower(F.col("email")))
    bad = F.lit(False)
    for c in ("\x00", "<", ">", "'", '"', ";", "--", "/*"):
        bad = bad | F.contains(email, F.lit(c))
    domain = F.substring_index(email, "@", -1)
    email_error = (F.when(~F.contains(email, F.lit("@")) | ~F.contains(domain, F.lit(".")), "Invalid email address")
                   .when(F.char_length(email) > 254, "Email address too long")
                   .when(bad, "Invalid characters in email address"))
    n = F.char_length("password")
    password_error = (F.when(n < 8, "Password must be at least 8 characters")
                      .when(n > 128, "Password too long (max 128 characters)"))
    org = strip(F.col("org_name"))
    org_error = (F.when(org == "", "Organization name is required")
                 .when(F.char_length(org) > 100, "Organization name too long (max 100 characters)"))
    return (rows.withColumns({"email_error": email_error, "password_error": password_error, "org_error": org_error})
            .withColumns({"email": email, "org_name": html_escape(org)})
            .withColumn("ok", F.coalesce("email_error", "password_error", "org_error").isNull()))


def validate_text(rows: DataFrame, text: str = "text", max_chars: int = MAX_TEXT_CHARS) -> DataFrame:
    """Strip the text, drop NULs, add ``ok`` and ``reason``."""
    value = strip(F.col(text))
    reason = (F.when(value == "", "Code text cannot be empty")
              .when(F.char_length(value) > max_chars, f"Input too large (max {max_chars:,} chars)"))
    return (rows.withColumn("reason", reason).withColumn(text, F.replace(value, F.lit("\x00"), F.lit("")))
            .withColumn("ok", F.col("reason").isNull()))


# ---- rate limit ----------------------------------------------------------------

def limits_table(spark: SparkSession, limits=None) -> DataFrame:
    return small_table(spark, sorted((limits or RATE_LIMITS).items()), "bucket string, max_requests int")


def with_rate_key(requests: DataFrame) -> DataFrame:
    return requests.withColumns({
        "ip": client_ip(F.col("cf_ip"), F.col("real_ip"), F.col("fwd_for"), peer=F.col("peer")),
        "bucket": request_bucket(F.col("path"))})


def rate_limit_batch(requests: DataFrame, limits: DataFrame | None = None, window: int = RATE_WINDOW_SECONDS,
                     slices: int | None = None) -> DataFrame:
    """Verdict per request under windows anchored at the first request of (ip, bucket).

    A window ends with the first request more than ``window`` seconds after
    its start, and that request starts the next.  A key may have any number of
    requests (:mod:`rate_windows`).
    """
    window_us = window * 1_000_000
    limits = limits_table(requests.sparkSession) if limits is None else limits
    keyed = with_rate_key(requests).select(
        "req_id", "ip", "bucket", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    numbered = anchored_windows(keyed, ["ip", "bucket"], "req_id", window_us, slices)
    return verdicts(numbered.join(limits, "bucket", "left"), window_us)


def verdicts(numbered: DataFrame, window_us: int) -> DataFrame:
    most = F.col("max_requests")
    return numbered.select(
        "req_id", "ip", "bucket", F.timestamp_micros("t").alias("ts"), F.col("n").alias("request_number"),
        (F.col("n") <= most).alias("allowed"),
        F.greatest(F.lit(0), most - F.col("n")).cast("bigint").alias("remaining"),
        F.floor((F.lit(window_us) - (F.col("t") - F.col("window_start"))) / 1_000_000).cast("bigint").alias("reset_in"))


# ---- guards on collections -------------------------------------------------------

def request_reasons(requests: DataFrame) -> DataFrame:
    """Both request guards; ``status`` is the HTTP status a request would get."""
    checked = content_type_guard(injection_filter(requests))
    return checked.withColumn("status", first_match(
        [(F.col("flagged"), F.lit(400)), (F.col("reject"), F.lit(415))], F.lit(200)))
