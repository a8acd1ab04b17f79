"""One query per operator over the derived tables; each reads whole tables.

Results are flat: lists become text and times become strings, so that any
engine's result can be compared by value.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import advisory_sweep, billing, cve, cve_index, guards, reports, scoring, secrets, usage
from ..operators import dependencies as dep
from ..operators import requests as req
from ..operators.enrich import auto_fix, compliance_map
from ..operators.paste import analyze_text, entropy_secrets, literal_rule_match
from ..plans import composites
from ..rules.scan_limits import FREE_FINDINGS
from ..session import scratch_folder
from ..sources import files as src
from ..sources import manifests as man
from ..sources import sinks, tables
from ..sources.tables import src_tables
from ..streaming import streams
from .views import BASE, TODAY, settled, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = f"{TODAY} 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _v(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return functools.partial(view, name=name)


def stamp(col: str | Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(col: str | Column) -> Column:
    return F.array_join(col, " | ")


def wide(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


tree, files, texts, manifests = _v("v_tree"), _v("v_files"), _v("v_texts"), _v("v_manifests")
users, usage_rows, scans, requests = _v("v_users"), _v("v_usage"), _v("v_scans"), _v("v_requests")
declared, repos, burst, audit = _v("v_declared"), _v("v_repos"), _v("v_burst"), _v("v_audit")
members = _v("v_members")


def snippets(spark, d):
    return view(spark, d, "v_snippets")


def names(spark, d):
    """The tree without content: none is built."""
    return view(spark, d, "v_tree", only=("repo", "path", "size"))


def findings(spark, d):
    return secrets.secret_findings(tree(spark, d), names=names(spark, d))


def paste(spark, d):
    return analyze_text(texts(spark, d))


def deps(spark, d):
    return dep.dedup_packages(declared(spark, d))


def cves_raw(spark, d):
    """Nested feed documents built from the flat CVE view."""
    flat = view(spark, d, "v_cve_flat")

    def metric(c):
        return F.when(F.col(c).isNotNull(), F.array(F.struct(F.struct(F.col(c).alias("baseScore")).alias("cvssData"))))

    cpe = F.transform(F.sequence(F.lit(0), F.col("cpes").cast("int")), lambda i: F.struct(
        (i % 3 != 1).alias("vulnerable"), F.concat(F.lit("cpe:"), F.col("k").cast("string"), F.lit(":"), i.cast("string"))
        .alias("criteria")))
    return flat.select(F.struct(
        "id", "published", F.array(F.struct(F.col("description").alias("value"))).alias("descriptions"),
        F.struct(metric("v31").alias("cvssMetricV31"), metric("v30").alias("cvssMetricV30"),
                 metric("v2").alias("cvssMetricV2")).alias("metrics"),
        F.array(F.struct(F.array(F.struct(cpe.alias("cpeMatch"))).alias("nodes"))).alias("configurations"),
        F.transform(F.sequence(F.lit(1), (F.col("cpes") + 1).cast("int")), lambda i: F.struct(F.concat(
            F.lit("https://ref.example/"), i.cast("string")).alias("url"))).alias("references")).alias("cve"))


def flat_cves(df: DataFrame) -> DataFrame:
    return df.withColumn("affected_products", joined("affected_products")).withColumn("references", joined("references"))


def nested_events(e: DataFrame) -> DataFrame:
    return e.select("seq", "ts", "event_type", F.struct(
        F.col("res_id").alias("id"), "custom_id", F.col("agreement_id").alias("billing_agreement_id"), "invoice_id",
        F.struct(F.col("sub_email").alias("email_address")).alias("subscriber"),
        F.struct("total", F.col("val").alias("value")).alias("amount"), "billing").alias("resource"))


def payment_events(spark, d):
    return nested_events(view(spark, d, "v_payment_events"))


# ---- sources and sinks ------------------------------------------------------------

@query
def src_file_corpus(spark, d):
    """The tree's files, written as files, listed and read."""
    def read(roots):
        return src.src_file_corpus(spark, roots, src.scannable).select("repo", "path", "is_link", "size", F.md5("content").alias("content_md5"))

    return src.through_trees(spark, tree(spark, d), scratch_folder(spark), read, names=names(spark, d))


@query
def src_lines(spark, d):
    return src.src_lines(tree(spark, d).select("repo", "path", "content")).select("repo", "path", "line", "text")


@query
def src_manifests(spark, d):
    return src.src_manifests(tree(spark, d)).select("repo", "path", "manifest")


def _parser(fn):
    def run(spark, d):
        m = src.src_manifests(manifests(spark, d))
        return fn(m).select("repo", "path", "name", "version")

    run.__name__ = fn.__name__
    return query(run)


for _fn in (man.src_requirements, man.src_package_json, man.src_package_lock, man.src_pipfile_lock, man.src_pipfile,
            man.src_poetry_lock):
    _parser(_fn)


@query
def src_cve_feed(spark, d):
    """The table as a feed of JSON lines, landed and read."""
    landed = scratch_folder(spark)
    cves_raw(spark, d).select(F.to_json(F.struct("cve"))).write.text(landed)
    return tables.src_cve_feed(spark, landed).select("cve.*").select("id", "published", F.get("descriptions", 0)["value"].alias("description"),
                         F.size("references").alias("n_references"))


@query
def src_epss_feed(spark, d):
    landed = scratch_folder(spark)
    view(spark, d, "v_epss").select("cve", "epss").write.option("header", True).csv(landed)
    return tables.src_epss_feed(spark, landed)


@query
def src_tables_query(spark, d):
    orders = src_tables(spark, d, "orders")
    since = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    return orders.filter(F.col("o_orderdate") >= since).select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


QUERIES["src_tables"] = QUERIES.pop("src_tables_query")


@query
def sink_scan_results(spark, d):
    out = scratch_folder(spark)
    sinks.sink_scan_results(scans(spark, d), out)
    return spark.read.parquet(out).select("id", "user_id", "source", "risk_level", "total_secrets", "result_json",
                                          F.col("scan_date").cast("string").alias("scan_date"))


@query
def sink_upsert_usage(spark, d):
    out = scratch_folder(spark)
    stream = stream_of(spark, d, "v_requests", "events").withColumn("org_id", F.col("user_id"))
    streams.stream_usage_upsert(stream, out + "/data", out + "/check").awaitTermination()
    return sinks.usage_view(spark, out + "/data").select("user_id", F.col("date").cast("string").alias("date"),
                                                         "request_count")


@query
def sink_latest_state(spark, d):
    return sinks.sink_latest_state(view(spark, d, "v_tasks"))


@query
def sink_append_log(spark, d):
    out = scratch_folder(spark)
    sinks.sink_append_log(audit(spark, d), out)
    return spark.read.parquet(out).select("id", "user_id", "action", "resource",
                                          F.char_length("metadata").alias("metadata_chars"))


# ---- secrets ------------------------------------------------------------------------

def scan_lines(spark, d):
    return src.src_lines(src.scan_files(tree(spark, d)).select("repo", "path", "content"), hints=secrets.rule_hints())


@query
def secret_match(spark, d):
    return secrets.secret_match(scan_lines(spark, d)).select("repo", "path", "line", "label", "match_pos", "raw")


@query
def env_file_match(spark, d):
    return secrets.env_file_match(src.scan_files(tree(spark, d))).select(
        "repo", "path", "type", "line", "severity", "match", "category")


@query
def dedup_matches(spark, d):
    return secrets.dedup_matches(secrets.secret_match(scan_lines(spark, d))).select(
        "repo", "path", "label", "raw", "line", "match_pos")


@query
def sort_findings(spark, d):
    return secrets.sort_findings(findings(spark, d), ["repo"]).drop("rule_ord", "match_pos")


@query
def redact(spark, d):
    return snippets(spark, d).select("text_id", T.redact(F.col("text")).alias("redacted"),
                                     T.redact(F.substring("text", 1, 8)).alias("short"))


@query
def literal_rule_match_query(spark, d):
    return literal_rule_match(texts(spark, d)).drop("rule_ord", "match_pos")


@query
def entropy_secrets_query(spark, d):
    return entropy_secrets(texts(spark, d)).drop("rule_ord", "match_pos")


@query
def analyze_text_query(spark, d):
    return paste(spark, d).drop("rule_ord", "match_pos")


for _n in ("literal_rule_match", "entropy_secrets", "analyze_text"):
    QUERIES[_n] = QUERIES.pop(f"{_n}_query")


# ---- requests --------------------------------------------------------------------------

@query
def injection_filter(spark, d):
    return req.injection_filter(requests(spark, d)).select("req_id", "query", "flagged")


@query
def request_bucket(spark, d):
    return requests(spark, d, only=("req_id", "path")).select("req_id", req.request_bucket(F.col("path")).alias("bucket"))


@query
def client_ip(spark, d):
    rows = requests(spark, d, only=("req_id", "path", "cf_ip", "real_ip", "fwd_for", "peer"))
    return req.with_rate_key(rows).select("req_id", "ip")


@query
def content_type_guard(spark, d):
    rows = requests(spark, d, only=("req_id", "method", "path", "content_type"))
    return req.content_type_guard(rows).select("req_id", "reject")


@query
def validate_repo_urls(spark, d):
    return req.validate_repo_urls(view(spark, d, "v_urls")).select("url_id", "ok", "reason")


@query
def validate_registrations(spark, d):
    return req.validate_registrations(view(spark, d, "v_registrations")).select(
        "reg_id", "email", "org_name", "email_error", "password_error", "org_error", "ok")


@query
def validate_text(spark, d):
    return req.validate_text(texts(spark, d)).select(
        "text_id", F.char_length("text").alias("chars"), "ok", "reason")


@query
def archive_guard(spark, d):
    return guards.archive_guard(members(spark, d))


@query
def repo_size_guard(spark, d):
    return guards.repo_size_guard(tree(spark, d))


@query
def rate_limit_batch(spark, d):
    out = req.rate_limit_batch(burst(spark, d))
    return out.withColumn("ts", stamp("ts"))


@query
def rate_limit_hot_keys(spark, d):
    """The same verdicts from so many slices that keys go on over several."""
    out = req.rate_limit_batch(burst(spark, d), slices=64)
    return out.withColumn("ts", stamp("ts"))


# ---- users, usage, audit ------------------------------------------------------------------

@query
def audit_search(spark, d):
    return usage.audit_search(audit(spark, d), org_id="org3", limit=60, action_filter="S_a").select(
        "id", "user_id", "action", stamp("created_at").alias("created_at"))


@query
def plan_gate(spark, d):
    return usage.plan_gate(users(spark, d), "pdf_download").select("id", "plan", "allowed")


@query
def expired_trials(spark, d):
    return billing.expired_trials(users(spark, d), TODAY)


@query
def team_members(spark, d):
    return usage.team_members(users(spark, d)).withColumn("created_at", F.col("created_at").cast("string"))


@query
def user_org_limits(spark, d):
    return usage.user_org_limits(users(spark, d), view(spark, d, "v_orgs")).select(
        "id", "email", "org_name", "plan_label", "daily_scans", "history_limit", "ai_depth", "pdf_download")


@query
def dashboard_bundle(spark, d):
    out = usage.dashboard_bundle(users(spark, d), usage_rows(spark, d), scans(spark, d), "2024-01-15")
    return out.select(
        "user_id", "plan", "usage_limit", "usage_today", "team_size",
        joined(F.transform("usage_series", lambda u: F.concat(u["date"].cast("string"), F.lit("="),
                                                              u["request_count"].cast("string")))).alias("series"),
        joined(F.transform("history", lambda h: h["id"])).alias("history"))


@query
def usage_daily(spark, d):
    return usage.usage_daily(requests(spark, d, only=("user_id", "ts"))).withColumn("date", F.col("date").cast("string"))


@query
def quota_check(spark, d):
    return usage.quota_check(requests(spark, d, only=("req_id", "user_id", "ts")), users(spark, d)).select(
        "req_id", "user_id", "plan", "usage_count", "daily_scans", "allowed")


@query
def usage_meter(spark, d):
    u = usage_rows(spark, d).join(users(spark, d).select(F.col("id").alias("user_id"), "plan"), "user_id")
    capped = usage._with_limits(u, usage.plan_limits_table(spark))
    return usage.usage_meter(capped).select("user_id", F.col("date").cast("string").alias("date"), "request_count",
                                            "unlimited", "pct", "band")


@query
def usage_history(spark, d):
    return usage.usage_history(usage_rows(spark, d), 7).select(
        "user_id", F.col("date").cast("string").alias("date"), "request_count", "rank")


@query
def usage_7day_series(spark, d):
    return usage.usage_7day_series(usage_rows(spark, d), users(spark, d), "2024-01-20").withColumn(
        "date", F.col("date").cast("string"))


@query
def recent_scans(spark, d):
    return usage.recent_scans_by_plan(scans(spark, d), users(spark, d)).select("user_id", "id", "risk_level", "rank")


@query
def security_trend(spark, d):
    return usage.security_trend(scans(spark, d), NOW, users=users(spark, d))


@query
def trend_points(spark, d):
    return usage.trend_points(scans(spark, d), NOW).select("user_id", "id", F.col("date").cast("string").alias("date"),
                                                           "score")


@query
def sort_history(spark, d):
    return usage.sort_history(scans(spark, d), 100).select("id", stamp("created_at").alias("created_at"))


@query
def sort_audit(spark, d):
    return usage.sort_audit(audit(spark, d), 100).select("id", stamp("created_at").alias("created_at"))


@query
def sort_trend(spark, d):
    return usage.sort_trend(scans(spark, d), 500).select("id", stamp("created_at").alias("created_at"))


@query
def trial_status(spark, d):
    return billing.trial_status(users(spark, d), TODAY).select(
        "id", "eff_plan", "eff_is_pro", "in_trial", "trial_expired", "days_left", "trial_end", "can_start_trial",
        "can_cancel", "plan_label")


# ---- dependencies ---------------------------------------------------------------------------

@query
def dedup_in_manifest(spark, d):
    return dep.dedup_in_manifest(declared(spark, d)).select("repo", "path", "name", "version", "pos")


@query
def dedup_packages(spark, d):
    return deps(spark, d).select("repo", "name", "version", "path", "manifest", "pos")


@query
def dependency_count(spark, d):
    return dep.dependency_count(declared(spark, d))


@query
def distinct_deps(spark, d):
    parsed = man.declared_packages(src.src_manifests(manifests(spark, d)))
    return dep.distinct_deps(declared(spark, d), parsed)


def _dep_columns(df):
    return df.select("repo", *dep.FIELDS)


@query
def advisory_match(spark, d):
    return _dep_columns(dep.advisory_match(deps(spark, d), dep.advisories_table(spark)))


@query
def advisory_match_many(spark, d):
    """Packages against a large advisory table, a third of which names one package."""
    return _dep_columns(advisory_sweep.advisory_match_many(deps(spark, d), view(spark, d, "v_advisories").withColumnRenamed("detail", "description")))


@query
def eol_match(spark, d):
    packages = deps(spark, d)
    found = dep.advisory_match(packages, dep.advisories_table(spark))
    return _dep_columns(dep.eol_match(packages, dep.eol_table(spark), found))


@query
def version_parse(spark, d):
    return declared(spark, d).select("repo", "name", "version",
                                     joined(F.transform(T.version_parse(F.col("version")), lambda n: n["number"])).alias("parts"))


@query
def dep_risk_top20(spark, d):
    return reports.dep_risk_top20(dep.dependency_findings(deps(spark, d)), dep.DEP_ORDER)


@query
def dependency_report(spark, d):
    return _dep_columns(composites.dependency_report(tree(spark, d)))


# ---- scores ----------------------------------------------------------------------------------

@query
def severity_summary(spark, d):
    return scoring.severity_summary(findings(spark, d), repos(spark, d))


@query
def severity_distribution(spark, d):
    return scoring.severity_distribution(findings(spark, d))


@query
def risk_level(spark, d):
    return scoring.risk_level(findings(spark, d), repos(spark, d))


@query
def security_score(spark, d):
    all_found = scoring.union_findings(paste(spark, d).select("text_id", "severity"))
    return scoring.security_score(all_found, texts(spark, d), "text_id")


@query
def legacy_score(spark, d):
    return scoring.legacy_score(paste(spark, d), texts(spark, d))


@query
def status_label(spark, d):
    return scoring.status_label(paste(spark, d), texts(spark, d), "text_id")


@query
def finding_summary_text(spark, d):
    return scoring.finding_summary_text(paste(spark, d)).withColumn("fixes", joined("fixes"))


@query
def repo_health(spark, d):
    return scoring.repo_health(findings(spark, d), dep.dependency_findings(deps(spark, d)),
                               dep.dependency_count(declared(spark, d)), repos(spark, d))


@query
def owasp_coverage(spark, d):
    return scoring.owasp_coverage(compliance_map(findings(spark, d)), secrets.finding_order(), "repo")


@query
def free_tier_topk(spark, d):
    return scoring.free_tier_topk(findings(spark, d), secrets.finding_order(), repos(spark, d), FREE_FINDINGS).select(
        "repo", "path", "line", "type", "severity", "match")


@query
def sort_cards(spark, d):
    return scoring.sort_cards(paste(spark, d), ["text_id"]).select("text_id", "title", "match", "severity")


@query
def union_findings(spark, d):
    both = scoring.union_findings(findings(spark, d), dep.dependency_findings(deps(spark, d)))
    return both.select("repo", "type", "severity", "package", "file" if "file" in both.columns else "path", "match")


@query
def report_sections(spark, d):
    both = scoring.union_findings(findings(spark, d), dep.dependency_findings(deps(spark, d)))
    return reports.report_sections(both).select("repo", "type", "severity", "category", "match", "in_serious", "in_secrets", "in_dependencies")


@query
def compliance_map_query(spark, d):
    return compliance_map(paste(spark, d)).select("text_id", "title", "match", "owasp", "nist")


QUERIES["compliance_map"] = QUERIES.pop("compliance_map_query")


@query
def auto_fix_query(spark, d):
    return auto_fix(snippets(spark, d), snippet=F.col("text")).select("text_id", "auto_fix.*")


QUERIES["auto_fix"] = QUERIES.pop("auto_fix_query")


# ---- scalar functions ----------------------------------------------------------------------

@query
def redact_entropy(spark, d):
    return snippets(spark, d).select("text_id", T.redact_entropy(F.col("text")).alias("redacted"))


@query
def shannon_entropy(spark, d):
    return texts(spark, d).select("text_id", F.round(T.shannon_entropy(F.col("text")), 6).alias("bits"))


@query
def file_ext(spark, d):
    return tree(spark, d).select("repo", "path", T.file_ext(F.col("path")).alias("ext"))


@query
def cvss_severity(spark, d):
    score = F.coalesce("v31", "v30", "v2")
    return view(spark, d, "v_cve_flat").select("id", T.cvss_severity(score).alias("severity"),
                                               T.cvss_badge(score).alias("badge"))


@query
def key_hash(spark, d):
    return snippets(spark, d).select("text_id", T.key_hash(F.col("text")).alias("key_hash"))


@query
def html_escape(spark, d):
    return texts(spark, d).select("text_id", F.md5(T.html_escape(F.col("text"))).alias("escaped_md5"),
                                  F.char_length(T.html_escape(F.col("text"), quote=False)).alias("chars_without_quote"))


# ---- CVE --------------------------------------------------------------------------------------

@query
def cve_flatten(spark, d):
    return flat_cves(cve.cve_flatten(cves_raw(spark, d)))


@query
def epss_enrich(spark, d):
    flat = cve.cve_flatten(cves_raw(spark, d)).select("id", "severity")
    return cve.epss_enrich(flat, view(spark, d, "v_epss"))


@query
def cve_keyword_search(spark, d):
    return cve.cve_keyword_search(cve.cve_flatten(cves_raw(spark, d), None), " SQL Injection ", 5).select(
        "id", "published", "severity")


def _cve_index(spark, d):
    path = scratch_folder(spark)
    cve_index.write_cve_index(cve.cve_flatten(cves_raw(spark, d), None, cve.METRICS[:1]), path)
    return path


@query
def cve_search_v1(spark, d):
    """The older search, through the stored index."""
    return cve_index.v1_result(cve_index.search_cve_index(spark, _cve_index(spark, d), " SQL Injection ")).select("id", "description", "cvss")


@query
def cve_search_many(spark, d):
    """Every part's name, brand and brand number, and each two letters that begin a name, searched at once."""
    parts = src_tables(spark, d, "part")
    asked = parts.select(F.explode(F.array("p_name", F.concat(F.lit(" "), F.upper("p_brand")), F.substring_index("p_brand", "#", -1),
                                           F.substring("p_name", 1, 2), F.concat("p_name", F.lit(" "), "p_brand"))).alias("query"))
    return cve_index.v1_result(cve_index.search_cves(_cve_index(spark, d), asked))


@query
def finding_cve_lookup(spark, d):
    known = cve.cve_flatten(cves_raw(spark, d), None, cve.METRICS[:1])
    out = cve.finding_cve_lookup(paste(spark, d), known, ["rule_ord", "match_pos"])
    return out.select("text_id", "title", "match", "top_cve", "top_cvss")


@query
def cve_report(spark, d):
    return flat_cves(composites.cve_report(cves_raw(spark, d), view(spark, d, "v_epss")))


# ---- reports ------------------------------------------------------------------------------------

@query
def llm_reply_parse(spark, d):
    return reports.llm_reply_parse(view(spark, d, "v_replies")).select("reply_id", "explanation",
                                                                       joined("fixes").alias("fixes"))


def _summary(spark, d):
    s = composites.scan_report(tree(spark, d), repos(spark, d), findings(spark, d))
    exposed = findings(spark, d).filter(F.col("category") == "Secrets Exposure").groupBy("repo").agg(F.count(F.lit(1)).alias("secrets"))
    return (s.join(exposed, "repo", "left").withColumn("secrets", F.coalesce("secrets", F.lit(0)))
            .withColumn("dep_findings", F.col("outdated_packages")))


@query
def recommendations(spark, d):
    return reports.recommendations(_summary(spark, d)).select("repo", joined("recommendations").alias("recommendations"))


@query
def exec_summary(spark, d):
    return reports.exec_summary(_summary(spark, d)).select("repo", "exec_summary")


@query
def scan_report(spark, d):
    return composites.scan_report(tree(spark, d), repos(spark, d), findings(spark, d)).drop("source")


@query
def analyze_report(spark, d):
    return composites.analyze_report(texts(spark, d))


@query
def executive_report(spark, d):
    """Rows of all the report's tables."""
    tables = composites.executive_report(tree(spark, d), repos(spark, d), names=names(spark, d))
    finding = ("type", "path", "severity", "line")
    shown = {"summary": ("exec_summary", joined("recommendations"), "risk_level", "security_score"), "serious": finding, "secrets": finding,
             "dependencies": ("package", "cve", "severity", "rank"), "owasp": ("owasp", F.lit(""), F.lit(""), "findings"), "shown": finding}
    parts = [tables[name].select("repo", F.lit(name).alias("section"), *[
        (F.col(c) if isinstance(c, str) else c).cast(kind).alias(to) for c, to, kind in zip(
            columns, ("title", "detail", "level", "number"), ("string", "string", "string", "bigint"))]) for name, columns in shown.items()]
    return functools.reduce(DataFrame.unionByName, parts)


# ---- billing -------------------------------------------------------------------------------------

@query
def subscription_lookup(spark, d):
    matched, unmatched = billing.subscription_lookup(billing.event_keys(payment_events(spark, d)), users(spark, d))
    return matched.select("seq", "subscription_id", "user_id").unionByName(
        unmatched.select("seq", "subscription_id"), allowMissingColumns=True)


@query
def subscription_state(spark, d):
    return billing.subscription_state(payment_events(spark, d), users(spark, d))


@query
def revenue_monthly(spark, d):
    return billing.revenue_monthly(view(spark, d, "v_payments")).withColumn("revenue", F.col("revenue").cast("double"))


# ---- streaming -------------------------------------------------------------------------------------

def stream_of(spark, d, name: str, base: str) -> DataFrame:
    """A derived view over a base table that is read as a file stream."""
    schema = spark.read.parquet(f"{d}/{base}.parquet").schema
    sql = with_views(f"SELECT * FROM {name}", "spark")
    source = spark.readStream.schema(schema).parquet(f"{d}/{base}*.parquet")
    others = {b: spark.read.parquet(f"{d}/{b}.parquet") for b in BASE if b != base and "{" + b + "}" in sql}
    return settled(spark.sql(sql, **{base: source}, **others))


def drained(spark, stream: DataFrame) -> DataFrame:
    """Run a stream over what is there, into files, and read them back."""
    out = scratch_folder(spark)
    (stream.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/check")
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(out + "/data")


@query
def stream_rate_limit(spark, d):
    return drained(spark, streams.stream_rate_limit(stream_of(spark, d, "v_burst", "events"))).withColumn(
        "ts", stamp("ts"))


@query
def stream_usage_daily(spark, d):
    out = scratch_folder(spark)
    streams.stream_usage_open(stream_of(spark, d, "v_requests", "events"), out + "/data", out + "/check").awaitTermination()
    return streams.usage_now(spark, out + "/data").withColumn("date", F.col("date").cast("string"))


@query
def stream_secret_scan(spark, d):
    found = drained(spark, streams.stream_secret_scan(stream_of(spark, d, "v_files", "orders")))
    return found.select("repo", "path", "label", "line", "match_pos", "match")


@query
def stream_injection_alerts(spark, d):
    return drained(spark, streams.stream_injection_alerts(stream_of(spark, d, "v_requests", "events"))).select(
        "req_id", "path", "query")


@query
def stream_audit_append(spark, d):
    out = scratch_folder(spark)
    streams.stream_audit_append(stream_of(spark, d, "v_audit", "events"), out + "/data", out + "/check").awaitTermination()
    return spark.read.parquet(out + "/data").select("id", "user_id", "action",
                                                    F.char_length("metadata").alias("metadata_chars"))


@query
def stream_subscription_state(spark, d):
    nested = nested_events(stream_of(spark, d, "v_payment_events", "orders"))
    out = scratch_folder(spark)
    streams.stream_subscription_state(nested, users(spark, d), out + "/state", out + "/check").awaitTermination()
    return streams.state_now(spark, out + "/state", users(spark, d))


# ---- one width for counts and positions ----------------------------------------------------------------

_WIDE = {
    "src_lines": ("line",),
    "src_cve_feed": ("n_references",),
    "sink_append_log": ("metadata_chars",),
    "secret_match": ("line", "match_pos",),
    "dedup_matches": ("line", "match_pos",),
    "sort_findings": ("line",),
    "validate_text": ("chars",),
    "usage_history": ("rank",),
    "recent_scans": ("rank",),
    "trial_status": ("days_left",),
    "dep_risk_top20": ("rank",),
    "free_tier_topk": ("line",),
    "html_escape": ("chars_without_quote",),
    "stream_secret_scan": ("line", "match_pos",),
    "stream_audit_append": ("metadata_chars",),
    "cve_search_many": ("rank",),
}


def _widened(fn: Query, names) -> Query:
    return lambda spark, d: wide(fn(spark, d), *names)


for _n, _cols in _WIDE.items():
    QUERIES[_n] = _widened(QUERIES[_n], _cols)
