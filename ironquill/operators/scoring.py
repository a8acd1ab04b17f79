"""Scores, labels and counts per scan.

``findings`` carry the scan key (``repo`` by default) and ``severity``;
``scans`` is the table of scan keys, so that scans without findings appear.
Everything is a map-side-combined aggregate: a scan that owns a third of all
findings costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sqltext import any_contains
from ..functions.text import SEVERITIES, first_match
from ..rules.compliance_rules import LEGACY_WEIGHTS, SCORE_BANDS, SCORE_FLOOR_LABEL, SCORE_WEIGHTS, SECRET_TERMS
from ..session import keep_result
from .sliced import first_rows


def known_severity(col: Column) -> Column:
    """Upper case, with anything unknown or missing counted as LOW."""
    up = F.upper(col)
    return F.when(up.isin(*SEVERITIES), up).otherwise("LOW")


def _points(col: Column, weights: dict[str, int]) -> Column:
    return first_match([(col == s, F.lit(w)) for s, w in weights.items()], F.lit(weights["LOW"]))


def score_band(score: Column) -> Column:
    return first_match([(score >= low, F.lit(label)) for low, label in SCORE_BANDS], F.lit(SCORE_FLOOR_LABEL))


def _clamped(points: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.coalesce(points, F.lit(0)))).cast("bigint")


def _per_scan(findings: DataFrame, scans: DataFrame | None, key: str, *aggs: Column) -> DataFrame:
    out = findings.groupBy(key).agg(*aggs)
    return out if scans is None else scans.select(key).join(out, key, "left")


def severity_counts(col: Column) -> list[Column]:
    return [F.count_if(col == s).alias(s.lower()) for s in SEVERITIES]


def severity_summary(findings: DataFrame, scans: DataFrame | None = None, key: str = "repo") -> DataFrame:
    """critical, high, medium, low (exact names only) and the total."""
    names = [s.lower() for s in SEVERITIES] + ["total_secrets"]
    out = _per_scan(findings, scans, key, *severity_counts(F.col("severity")),
                    F.count(F.lit(1)).alias("total_secrets"))
    return out.select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def severity_distribution(findings: DataFrame) -> DataFrame:
    """Chart rows over all findings: Critical, High, Medium, Low, each with its count."""
    totals = findings.agg(*severity_counts(known_severity(F.col("severity"))))
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(s.capitalize()).alias("label"), F.col(s.lower()).alias("findings"))
        for i, s in enumerate(SEVERITIES)])))


def _worst(critical, high, medium, total) -> Column:
    return (F.when(F.coalesce(total, F.lit(0)) == 0, "NONE").when(critical > 0, "CRITICAL")
            .when(high > 0, "HIGH").when(medium > 0, "MEDIUM").otherwise("LOW"))


def risk_level(findings: DataFrame, scans: DataFrame | None = None, key: str = "repo") -> DataFrame:
    s = severity_summary(findings, scans, key)
    return s.select(key, _worst(F.col("critical"), F.col("high"), F.col("medium"), F.col("total_secrets")).alias(
        "risk_level"))


def security_score(findings: DataFrame, scans: DataFrame | None = None, key: str = "repo") -> DataFrame:
    points = F.sum(_points(F.upper(F.col("severity")), SCORE_WEIGHTS))
    out = _per_scan(findings, scans, key, points.alias("_p")).select(key, _clamped(F.col("_p")).alias("security_score"))
    return out.withColumn("score_risk_level", score_band(F.col("security_score")))


def legacy_score(findings: DataFrame, texts: DataFrame | None = None, key: str = "text_id") -> DataFrame:
    """The older upward score and its risk label."""
    sev = F.col("severity")
    out = _per_scan(findings, texts, key, F.sum(_points(sev, LEGACY_WEIGHTS)).alias("_p"),
                    F.count_if(sev.isin("CRITICAL", "HIGH")).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    return out.select(key, *_legacy(F.col("_p"), F.col("_hi"), F.col("_n")))


def _legacy(points: Column, serious: Column, total: Column) -> list[Column]:
    return [F.least(F.lit(100), F.coalesce(points, F.lit(0))).cast("bigint").alias("score"),
            F.when(serious >= 3, "CRITICAL").when(serious >= 1, "HIGH").when(total > 0, "MEDIUM")
            .otherwise("LOW").alias("risk")]


def status_label(findings: DataFrame, scans: DataFrame | None = None, key: str = "repo") -> DataFrame:
    sev = F.col("severity")
    out = _per_scan(findings, scans, key, F.bool_or(sev.isin("CRITICAL", "HIGH")).alias("_bad"),
                    F.bool_or(sev == "MEDIUM").alias("_mid"))
    return out.select(key, F.when(F.col("_bad"), "Vulnerable").when(F.col("_mid"), "Caution")
                      .otherwise("Secure").alias("status"))


def finding_summary_text(findings: DataFrame, key: str = "text_id", order=("rule_ord", "match_pos")) -> DataFrame:
    """Sentence with the counts per severity in order of first sight, and the first three fixes."""
    place = F.struct(*[F.col(c) for c in order])
    per_sev = findings.groupBy(key, "severity").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    # One entry per distinct severity, so the list stays short.
    listed = (per_sev.groupBy(key).agg(F.sum("n").alias("total"),
                                       F.array_sort(F.collect_list(F.struct("at", "n", "severity"))).alias("_l"))
              .select(key, "total", F.transform("_l", lambda p: F.concat(
                  p["n"].cast("string"), F.lit(" "), F.lower(p["severity"]), F.lit("-severity issue"),
                  F.when(p["n"] > 1, "s").otherwise(""))).alias("_parts")))
    fixes = (first_rows(findings.select(key, *order, "fix"), [key], list(order), 3)
             .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "fix"))).alias("_f"))
             .select(key, F.transform("_f", lambda f: f["fix"]).alias("fixes")))
    text = F.concat(F.lit("Found "), F.col("total").cast("string"), F.lit(" security issue"),
                    F.when(F.col("total") > 1, "s").otherwise(""), F.lit(": "), F.array_join("_parts", ", "),
                    F.lit(". Review each finding below and apply the suggested fixes."))
    return listed.select(key, text.alias("explanation")).join(fixes, key)


def union_findings(*parts: DataFrame) -> DataFrame:
    """Bag union of findings of any kind; columns a kind lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def is_secret(findings: DataFrame) -> Column:
    cols = [f"coalesce({c}, '')" for c in ("type", "category", "title") if c in findings.columns]
    return F.expr(any_contains(f"lower(concat_ws(' ', {', '.join(cols)}))", SECRET_TERMS))


def repo_health(findings: DataFrame, dep_findings: DataFrame, dep_counts: DataFrame,
                scans: DataFrame | None = None, key: str = "repo") -> DataFrame:
    """Nine figures per repository from one aggregation over all three inputs."""
    sev = known_severity(F.col("severity"))
    marks = (findings.select(key, sev.alias("sev"), is_secret(findings).cast("int").alias("secret"))
             .unionByName(dep_findings.select(key, sev.alias("sev"), F.lit(1).alias("outdated")),
                          allowMissingColumns=True)
             .unionByName(dep_counts.select(key, F.col("dependency_count").alias("deps")), allowMissingColumns=True))
    agg = marks.groupBy(key).agg(
        F.sum(F.when(F.col("sev").isNotNull(), _points(F.col("sev"), SCORE_WEIGHTS))).alias("_p"),
        *[F.count_if(F.col("sev") == s).alias(f"{s.lower()}_count") for s in SEVERITIES],
        F.sum("secret").alias("secret_count"), F.sum("deps").alias("dependency_count"),
        F.sum("outdated").alias("outdated_packages"))
    agg = agg if scans is None else scans.select(key).join(agg, key, "left")
    counts = [f"{s.lower()}_count" for s in SEVERITIES] + ["secret_count", "dependency_count", "outdated_packages"]
    out = agg.select(key, _clamped(F.col("_p")).alias("security_score"),
                     *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    return out.select(key, "security_score", score_band(F.col("security_score")).alias("risk_level"), *counts)


def owasp_coverage(findings: DataFrame, order, key: str | None = None) -> DataFrame:
    """Findings per OWASP category with their ``rank``: most first, ties by first sight in ``order`` (columns of findings)."""
    keys = [key] if key else []
    counted = findings.filter(F.col("owasp").isNotNull()).groupBy(*keys, "owasp").agg(
        F.count(F.lit(1)).alias("findings"), F.min(F.struct(*order)).alias("_at"))
    place = Window.partitionBy(*keys).orderBy(F.col("findings").desc(), "_at")  # a row per category
    return counted.withColumn("rank", F.row_number().over(place)).drop("_at")


def free_tier_topk(findings: DataFrame, order, scans: DataFrame, k: int = 5, key: str = "repo", keep=keep_result) -> DataFrame:
    """Findings a scan shows: all if ``is_pro``, else the first ``k`` in ``order``.

    Both kinds read the findings, so ``keep`` stores them: they are computed once.
    """
    shown, findings = scans.select(key, "is_pro"), keep(findings)
    pro = findings.join(shown.filter("is_pro"), key, "left_semi")
    free = first_rows(findings.join(shown.filter(~F.coalesce("is_pro", F.lit(False))), key, "left_semi"),
                      [key], order, k)
    return pro.unionByName(free.drop("rank"))


def truncation(summary: DataFrame, k: int = 5) -> DataFrame:
    """Add ``truncated`` and ``upgrade_message`` to rows with ``is_pro`` and ``total_secrets``."""
    cut = ~F.coalesce(F.col("is_pro"), F.lit(False)) & (F.col("total_secrets") > k)
    return summary.withColumn("truncated", cut).withColumn("upgrade_message", F.when(cut, F.concat(
        F.lit("Upgrade to Pro to see all "), F.col("total_secrets").cast("string"),
        F.lit(" findings and download the PDF report."))).otherwise(""))


def sort_cards(findings: DataFrame, lead=(), order=("rule_ord", "match_pos")) -> DataFrame:
    """Worst first, unknown severities last, otherwise in finding order.

    The findings are kept first: a sort reads its input twice, once to choose its ranges.
    """
    rank = first_match([(F.col("severity") == s, F.lit(4 - i)) for i, s in enumerate(SEVERITIES)], F.lit(0))
    return keep_result(findings).orderBy(*lead, rank.desc(), *order)
