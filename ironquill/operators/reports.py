"""Report tables and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..rules.secret_rules import SE
from .sliced import first_rows


def llm_reply_parse(replies: DataFrame, content: str = "content") -> DataFrame:
    """Stored model replies -> ``explanation`` and ``fixes``.

    With a ``FIXES:`` marker, the dash lines before it are the explanation and
    those after it the fixes; else the whole reply is the explanation.
    """
    text, marker = F.col(content), "FIXES:"
    at = F.instr(text, marker)

    def bullets(part):
        lines = F.transform(F.split(part, "\n"), strip)
        chosen = F.filter(lines, lambda ln: F.startswith(ln, F.lit("-")) & (F.char_length(ln) > 2))
        return F.transform(chosen, lambda ln: strip(F.ltrim(ln, F.lit("- "))))

    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(marker), F.char_length(text))
    return replies.withColumn(
        "explanation", F.when(at > 0, F.array_join(bullets(before), "\n")).otherwise(strip(text))).withColumn(
        "fixes", F.when(at > 0, bullets(after)).otherwise(F.array().cast("array<string>")))


def report_sections(findings: DataFrame) -> DataFrame:
    """Mark the sections a finding appears in; a finding may be in several."""
    category = F.lower(F.coalesce("category", F.lit("")))
    return findings.withColumns({
        "in_serious": F.coalesce(F.upper("severity").isin("CRITICAL", "HIGH"), F.lit(False)),
        "in_secrets": category == SE.lower(),
        "in_dependencies": category == "dependency vulnerability"})


def dep_risk_top20(dep_findings: DataFrame, order, n: int = 20, key: str = "repo") -> DataFrame:
    """The first ``n`` dependency findings of each repository as table rows."""
    issue = F.substring(F.coalesce(F.nullif("title", F.lit("")), "description", F.lit("")), 1, 50)
    return first_rows(dep_findings, [key], order, n).select(
        key, "rank", F.coalesce("package", F.lit("?")).alias("package"),
        F.coalesce("version", F.lit("?")).alias("version"), F.coalesce("severity", F.lit("LOW")).alias("severity"),
        F.coalesce("cve", F.lit("N/A")).alias("cve"), issue.alias("issue"))


def recommendations(summary: DataFrame, product: str = "security") -> DataFrame:
    """Add ``recommendations`` to rows with ``critical, high, secrets, dep_findings``."""
    return summary.withColumn("recommendations", F.array_compact(F.array(
        F.when(F.col("critical") > 0, "Rotate all exposed credentials immediately — treat CRITICAL findings as "
                                      "already compromised."),
        F.when(F.col("secrets") > 0, "Move all secrets to environment variables or a secrets manager (e.g. HashiCorp "
                                     "Vault, AWS Secrets Manager, or your platform's secret store)."),
        F.when(F.col("dep_findings") > 0, "Update vulnerable dependencies to the versions specified in this report, "
                                          "prioritising CRITICAL and HIGH severity packages."),
        F.when(F.col("high") > 0, "Review and remediate HIGH severity findings — these represent significant "
                                  "exploitable risk."),
        F.lit(f"Add automated {product} checks to your CI/CD pipeline to catch new issues before merge."),
        F.lit("Re-run this scan after remediation to confirm your security score has improved."))))


def exec_summary(summary: DataFrame) -> DataFrame:
    """Add ``exec_summary`` to rows with ``source, total_secrets, critical, security_score, score_risk_level``."""
    total, critical = F.col("total_secrets"), F.col("critical")
    scanned = F.when(F.startswith(F.coalesce("source", F.lit("")), F.lit("http")), "repository").otherwise("submission")
    text = F.concat(
        F.lit("This assessment identified "), total.cast("string"), F.lit(" finding(s) across the scanned "), scanned,
        F.lit(", resulting in an overall security score of "), F.col("security_score").cast("string"),
        F.lit("/100 ("), F.col("score_risk_level"), F.lit("). "),
        F.when(critical > 0, F.concat(
            critical.cast("string"), F.lit(" CRITICAL finding(s) require immediate attention as they represent direct "
                                           "exposure of credentials or code-execution risks. "))).otherwise(""))
    none = ("No security findings were detected in this scan. The codebase appears to follow secure coding practices "
            "for the patterns checked.")
    return summary.withColumn("exec_summary", F.when(total == 0, none).otherwise(text))
