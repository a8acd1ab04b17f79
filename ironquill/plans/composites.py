"""End-to-end reports, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEVERITIES
from ..operators.billing import subscription_state
from ..operators.cve import cve_flatten, epss_enrich
from ..operators.dependencies import DEP_ORDER, checked_packages, dedup_packages, dependency_findings
from ..operators.enrich import enrich
from ..operators.paste import analyzed_texts
from ..operators.reports import dep_risk_top20, exec_summary, recommendations, report_sections
from ..operators.scoring import (
    _clamped, _legacy, _points, _worst, free_tier_topk, is_secret, known_severity, owasp_coverage, score_band,
    severity_counts, truncation, union_findings)
from ..operators.secrets import finding_order, secret_findings
from ..session import keep_result
from ..rules.compliance_rules import LEGACY_WEIGHTS, SCORE_WEIGHTS
from ..rules.scan_limits import FREE_FINDINGS
from ..sources.manifests import declared_packages
from ..sources.files import src_manifests

__all__ = ["scan_findings", "dependency_report", "scan_report", "analyze_report", "cve_report", "executive_report",
           "subscription_state"]


def scan_findings(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Secret findings with compliance mapping and suggested fix; ``names`` as for :func:`secret_findings`."""
    return enrich(secret_findings(files, names=names))


def packages(files: DataFrame) -> DataFrame:
    """One version per (repo, package) over all manifests."""
    return dedup_packages(declared_packages(src_manifests(files)))


def dependency_report(files: DataFrame) -> DataFrame:
    """Advisory and end-of-life findings of every repository."""
    return dependency_findings(packages(files))


def scan_report(files: DataFrame, repos: DataFrame, findings: DataFrame | None = None,
                deps: DataFrame | None = None) -> DataFrame:
    """One summary row per repository (``repo, is_pro``).

    Findings stay in their own table (:func:`scan_findings`,
    :func:`dependency_report`; :func:`free_tier_topk` for what a plan shows), so
    no repository has to fit in one row.  All figures come from one aggregation
    by repository over narrow mark rows.
    """
    findings = secret_findings(files) if findings is None else findings
    deps = packages(files) if deps is None else deps
    checked = checked_packages(deps) if "finding" not in deps.columns else deps
    sev, dep_sev = F.col("severity"), F.col("finding.severity")
    marks = union_findings(
        findings.select("repo", sev.alias("raw"), known_severity(sev).alias("sev"), F.lit(1).alias("own"),
                        is_secret(findings).cast("int").alias("secret")),
        checked.select("repo", F.when(F.col("finding").isNotNull(), known_severity(dep_sev)).alias("sev"),
                       F.col("finding").isNotNull().cast("int").alias("dep"), F.lit(1).alias("package")))
    agg = marks.groupBy("repo").agg(
        *severity_counts(F.col("raw")), F.sum("own").alias("total_secrets"),
        F.sum(F.when(F.col("sev").isNotNull(), _points(F.col("sev"), SCORE_WEIGHTS))).alias("_p"),
        *[F.count_if(F.col("sev") == s).alias(f"health_{s.lower()}") for s in SEVERITIES],
        F.sum("secret").alias("secret_count"), F.sum("package").alias("dependency_count"),
        F.sum("dep").alias("outdated_packages"))
    counts = [s.lower() for s in SEVERITIES] + ["total_secrets"] + [f"health_{s.lower()}" for s in SEVERITIES] + [
        "secret_count", "dependency_count", "outdated_packages"]
    out = repos.join(agg, "repo", "left").select(
        *repos.columns, _worst(F.col("critical"), F.col("high"), F.col("medium"), F.col("total_secrets")).alias(
            "risk_level"),
        _clamped(F.col("_p")).alias("security_score"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    return truncation(out.withColumn("score_risk_level", score_band(F.col("security_score"))), FREE_FINDINGS)


def analyze_report(texts: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Both scores and the counts per text (``text_id, text``); texts without findings included.

    Without given findings each text is scored where it is read.
    """
    if findings is None:
        found = analyzed_texts(texts.select("text_id", "text"))
        of = F.transform("hits", lambda h: h["severity"])

        def total(weights):
            return F.aggregate(of, F.lit(0).cast("bigint"), lambda acc, s: acc + _points(s, weights))

        return _scored(found.select(
            "text_id", F.size("hits").cast("bigint").alias("findings"),
            F.size(F.filter(of, lambda s: s.isin("CRITICAL", "HIGH"))).cast("bigint").alias("_hi"),
            total(LEGACY_WEIGHTS).alias("_old"), total(SCORE_WEIGHTS).alias("_new")))
    sev = F.col("severity")
    agg = findings.groupBy("text_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(sev.isin("CRITICAL", "HIGH")).alias("_hi"),
        F.sum(_points(sev, LEGACY_WEIGHTS)).alias("_old"), F.sum(_points(sev, SCORE_WEIGHTS)).alias("_new"))
    return _scored(texts.select("text_id").join(agg, "text_id", "left"))


def _scored(sums: DataFrame) -> DataFrame:
    return sums.select(
        "text_id", F.coalesce("findings", F.lit(0)).alias("findings"),
        *_legacy(F.col("_old"), F.col("_hi"), F.col("findings")),
        _clamped(F.col("_new")).alias("security_score")).withColumn(
        "score_risk_level", score_band(F.col("security_score")))


def cve_report(raw: DataFrame, epss: DataFrame) -> DataFrame:
    return epss_enrich(cve_flatten(raw), epss)


def executive_report(files: DataFrame, repos: DataFrame, product: str = "security",
                     keep=keep_result, names: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of the executive report; ``repos`` has ``repo, source, is_pro``.

    Six tables read the same findings, so ``keep`` stores those once.
    """
    findings = keep(report_sections(scan_findings(files, names)))
    checked = keep(checked_packages(packages(files)))
    dep_found = checked.filter(F.col("finding").isNotNull()).select("repo", "path", "priority", "pos", "finding.*")
    summary = scan_report(files, repos, findings, checked)
    secrets = findings.filter("in_secrets").groupBy("repo").agg(F.count(F.lit(1)).alias("secrets"))
    summary = (summary.join(secrets, "repo", "left").withColumn("secrets", F.coalesce("secrets", F.lit(0)))
               .withColumn("dep_findings", F.col("outdated_packages")))
    return {
        "summary": recommendations(exec_summary(summary), product),
        "serious": findings.filter("in_serious"),
        "secrets": findings.filter("in_secrets"),
        "dependencies": dep_risk_top20(dep_found, DEP_ORDER),
        "owasp": owasp_coverage(findings, finding_order(), "repo"),
        "shown": free_tier_topk(findings, finding_order(), repos, keep=lambda kept: kept),
    }
