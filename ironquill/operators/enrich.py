"""Compliance mapping and suggested fixes, added as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.regex import WHITESPACE, jvm, jvm_replacement
from ..functions.sqltext import case, quote
from ..rules.compliance_rules import AUTOFIX_RULES, COMPLIANCE_RULES, DEFAULT_NIST, DEFAULT_OWASP

HAYSTACK = ("type", "title", "category", "description", "match")
FIX_TYPE = "struct<before:string,after:string,explanation:string,confidence:int>"


def _or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def compliance_map(findings: DataFrame, rules=COMPLIANCE_RULES) -> DataFrame:
    """Add ``owasp`` and ``nist``: the first needle found in the finding's text decides."""
    hay = F.lower(F.concat_ws(" ", *[_or_empty(findings, c) for c in HAYSTACK]))
    rank = F.expr(case([(f"contains(_hay, {quote(n)})", str(i)) for i, (n, _, _) in enumerate(rules)],
                       str(len(rules))))
    owasp = ", ".join([quote(o) for _, o, _ in rules] + [quote(DEFAULT_OWASP)])
    nist = ", ".join([quote(n) for _, _, n in rules] + [quote(DEFAULT_NIST)])
    return (bind(findings, _hay=hay).withColumn("_rule", rank).withColumns(
        {"owasp": F.expr(f"get(array({owasp}), _rule)"), "nist": F.expr(f"get(array({nist}), _rule)")})
        .drop("_hay", "_rule"))


def auto_fix_sql(text: str, rules=AUTOFIX_RULES) -> str:
    """Nullable struct from the first rule found; its first occurrence is replaced."""
    blank = quote(WHITESPACE)
    branches = []
    for r in rules:
        pattern = jvm(r.regex)
        flags, body = pattern[:pattern.index(")") + 1], pattern[pattern.index(")") + 1:]
        first = (f"regexp_replace({text}, {quote(flags + chr(92) + 'A((?s:.*?))' + body)}, "
                 f"{quote('$1' + jvm_replacement(r.replacement, 1))})")
        branches.append((f"{text} RLIKE {quote(pattern)}",
                         f"named_struct('before', btrim({text}, {blank}), 'after', btrim({first}, {blank}), "
                         f"'explanation', {quote(r.explanation)}, 'confidence', {r.confidence})"))
    return case(branches, f"CAST(NULL AS {FIX_TYPE})")


def auto_fix(findings: DataFrame, rules=AUTOFIX_RULES, snippet: Column | None = None) -> DataFrame:
    """Add ``auto_fix``.  By default the snippet is the match, else the title."""
    if snippet is None:
        match = F.nullif(_or_empty(findings, "match"), F.lit(""))
        snippet = F.coalesce(match, _or_empty(findings, "title"))
    return (bind(findings, _snip=snippet).withColumn("auto_fix", F.expr(auto_fix_sql("_snip", rules)))
            .drop("_snip"))


def enrich(findings: DataFrame) -> DataFrame:
    return auto_fix(compliance_map(findings))
