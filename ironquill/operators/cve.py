"""CVE records: flattening, severity, exploit probability, keyword search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cvss_severity
from ..rules.plan_limits import CVE_QUERY_MAX_CHARS, CVE_QUERY_MIN_CHARS, EPSS_EXPLOIT_THRESHOLD
from ..session import keep_result
from .sliced import first_rows

WORDS = r"[^\p{L}\p{N}]+"


#: Score lists of a record, in precedence order.
METRICS = ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
DESCRIPTION_CHARS = 500
V1_DESCRIPTION_CHARS = 300


def _first_metric(metrics=METRICS) -> Column:
    m = F.col("cve.metrics")
    lists = [m[v] for v in metrics]
    return F.get(F.coalesce(*[F.when(F.size(v) > 0, v) for v in lists]), 0)["cvssData"]["baseScore"]


def cve_flatten(raw: DataFrame, description_chars: int | None = DESCRIPTION_CHARS, metrics=METRICS) -> DataFrame:
    """Nested feed documents -> one flat row per CVE.

    Descriptions are cut for output; searches take them whole (None) and cut afterwards.
    """
    cve = F.col("cve")
    matches = F.flatten(F.transform(cve["configurations"], lambda c: F.flatten(
        F.transform(c["nodes"], lambda n: n["cpeMatch"]))))
    affected = F.slice(F.transform(F.filter(matches, lambda m: m["vulnerable"]), lambda m: m["criteria"]), 1, 5)
    empty = F.array().cast("array<string>")
    text = F.coalesce(F.get(cve["descriptions"], 0)["value"], F.lit(""))
    return raw.select(
        cve["id"].alias("id"), _first_metric(metrics).alias("cvss_score"), cvss_severity(_first_metric(metrics)).alias("severity"),
        F.coalesce(cve["published"], F.lit("")).alias("published"),
        (text if description_chars is None else F.substring(text, 1, description_chars)).alias("description"),
        F.coalesce(affected, empty).alias("affected_products"),
        F.concat(F.lit("Review the references for "), cve["id"],
                 F.lit(" and apply the vendor's recommended patch or upgrade affected packages to a "
                       "non-vulnerable version.")).alias("remediation"),
        F.coalesce(F.slice(F.transform(cve["references"], lambda r: r["url"]), 1, 5), empty).alias("references"))


def epss_enrich(cves: DataFrame, epss: DataFrame, threshold: float = EPSS_EXPLOIT_THRESHOLD) -> DataFrame:
    """Add ``epss_score`` (4 decimals) and ``exploit_available``; null if there is no usable score."""
    scores = epss.select(F.col("cve").alias("id"), F.col("epss").try_cast("double").alias("_e"))
    return (cves.join(scores, "id", "left")
            .withColumn("epss_score", F.bround("_e", 4)).withColumn("exploit_available", F.col("_e") >= threshold)
            .drop("_e"))


def clean_query(query: str | None) -> str | None:
    """The search text as used, or None if it is too short."""
    q = (query or "").strip()[:CVE_QUERY_MAX_CHARS]
    return q if len(q) >= CVE_QUERY_MIN_CHARS else None


def cve_keyword_search(cves: DataFrame, query: str, k: int = 3) -> DataFrame:
    """The ``k`` newest CVEs whose whole description contains the query; it is cut for output."""
    q = clean_query(query)
    if q is None:
        return cves.filter(F.lit(False))
    return (cves.filter(F.contains(F.lower("description"), F.lit(q.lower())))
            .orderBy(F.col("published").desc(), "id").limit(k)
            .withColumn("description", F.substring("description", 1, DESCRIPTION_CHARS)))


def _words(col: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(col), WORDS)), lambda w: w != "")


def finding_cve_lookup(findings: DataFrame, cves: DataFrame, order, key: str = "text_id", k: int = 5) -> DataFrame:
    """For the first ``k`` findings of each text without a CVE: the newest CVE with all words of the title.

    The findings asked about and the words of each description are computed
    once and kept as tables.  Distinct titles meet the CVEs on the rarest of
    their words (an equi-join); the other words are then checked in place.
    """
    asked = keep_result(first_rows(findings, [key], order, k).filter(
        F.coalesce(F.col("title") != "", F.lit(False)) & F.coalesce(F.col("cve") == "N/A", F.lit(True))))
    known = keep_result(cves.select("id", "published", "cvss_score", _words(F.col("description")).alias("_have")))
    titles = asked.select("title").distinct().select("title", _words(F.col("title")).alias("_words"))
    wanted = titles.select("title", "_words", F.explode("_words").alias("_word"))
    spread_out = known.select("id", "published", "cvss_score", "_have", F.explode("_have").alias("_word"))
    often = spread_out.select("_word").join(wanted.select("_word").distinct(), "_word", "left_semi").groupBy("_word").agg(
        F.count(F.lit(1)).alias("_n"))
    # A word that no description holds is the rarest: it meets nothing.
    rarest = wanted.join(often, "_word", "left").groupBy("title", "_words").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("w"))).alias("_a")).select("title", "_words", F.col("_a.w").alias("_word"))
    newest = F.struct(F.col("published"), F.col("id"))
    best = (spread_out.join(rarest, "_word").filter(F.size(F.array_except("_words", "_have")) == 0)
            .groupBy("title").agg(F.max_by(F.struct("id", "cvss_score"), newest).alias("_b")))
    return asked.join(best, "title", "left").select(
        *findings.columns, F.col("_b.id").alias("top_cve"), F.col("_b.cvss_score").alias("top_cvss"))
