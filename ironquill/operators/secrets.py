"""Secret scan of files: lines -> rule matches -> deduplicated findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.regex import jvm
from ..functions.small import small_table
from ..functions.sqltext import any_contains, case, quote
from ..functions.text import basename, fold, redact, severity_rank
from ..rules.secret_rules import ENV_FILE_RULE, SECRET_RULES
from ..session import keep_result
from ..sources.files import scan_files, src_lines

# Where a match stands in its file, packed into one sortable number: 31, 12 and 20 bits of a bigint, or, for
# a rule or position beyond those, a decimal of which each part is an int, below this.
_PART = 10**10
_RULE_BITS, _POS_BITS = 12, 20


def rule_hints(rules=SECRET_RULES):
    """Literals of which every match needs one; None if some rule names none."""
    if any(not r.hints for r in rules):
        return None
    return tuple(dict.fromkeys(h for r in rules for h in r.hints))


def rules_table(spark: SparkSession, rules=SECRET_RULES) -> DataFrame:
    return small_table(
        spark, [(i, r.label, r.regex, r.severity, r.description, r.fix, r.category) for i, r in enumerate(rules)],
        "rule_ord int, label string, regex string, severity string, description string, "
        "fix string, category string")


def secret_match(lines: DataFrame, rules=SECRET_RULES) -> DataFrame:
    """Every non-overlapping match of every rule: line keys + rule_ord, label, match_pos, raw.

    Patterns are literals of the plan, so each is compiled once per task, and a
    rule's regex only runs on lines that hold one of its hints.
    """
    keys = [c for c in lines.columns if c != "text"]
    per_rule = []
    for i, r in enumerate(rules):
        hit = (f"named_struct('rule_ord', {i}, 'label', {quote(r.label)}, "
               f"'raws', regexp_extract_all(text, {quote(jvm(r.regex))}, 0))")
        per_rule.append(case([(any_contains("_fold", r.hints), hit)], "NULL") if r.hints else hit)
    found = bind(lines, text=F.col("text"), _fold=fold(F.col("text"))).select(
        *keys, F.expr(f"explode(array_compact(array({', '.join(per_rule)}))) AS _h"))
    return found.select(*keys, "_h.rule_ord", "_h.label", F.posexplode("_h.raws").alias("match_pos", "raw"))


def dedup_matches(matches: DataFrame, keys=("repo", "path")) -> DataFrame:
    """First place of each (file, label, raw match).

    The place is one packed number, so the shuffle carries hash-aggregated
    partial minima instead of rows.  It holds any three ints: nearly all fit
    a bigint, the others are decimals, which cost several times as much.
    """
    fits = F.coalesce(F.col("rule_ord").between(0, (1 << _RULE_BITS) - 1) & F.col("match_pos").between(0, (1 << _POS_BITS) - 1)
                      & (F.col("line") >= 0), F.lit(False))
    near = F.expr(f"shiftleft(cast(line as bigint), {_RULE_BITS + _POS_BITS}) | shiftleft(cast(rule_ord as bigint), {_POS_BITS}) | match_pos")
    far = F.expr(f"cast(line as decimal(10,0)) * {_PART}0000000000BD + cast(rule_ord as decimal(10,0)) * {_PART}BD "
                 "+ cast(match_pos as decimal(10,0))").cast("decimal(38,0)")
    firsts = matches.groupBy(*keys, "label", "raw").agg(F.min(F.when(fits, near)).alias("_near"), F.min(F.when(~fits, far)).alias("_far"))
    at = F.expr(f"""least(
        CASE WHEN _near IS NOT NULL THEN named_struct(
            'line', cast(shiftright(_near, {_RULE_BITS + _POS_BITS}) AS int),
            'rule_ord', cast(shiftright(_near, {_POS_BITS}) & {(1 << _RULE_BITS) - 1} AS int),
            'match_pos', cast(_near & {(1 << _POS_BITS) - 1} AS int)) END,
        CASE WHEN _far IS NOT NULL THEN named_struct(
            'line', cast(_far div {_PART}0000000000BD AS int),
            'rule_ord', cast((_far % {_PART}0000000000BD) div {_PART}BD AS int),
            'match_pos', cast(_far % {_PART}BD AS int)) END)""")
    return firsts.select(*keys, "label", "raw", at.alias("_at")).select(*keys, "label", "raw", "_at.line", "_at.rule_ord", "_at.match_pos")


def env_file_match(files: DataFrame, keys=("repo", "path"), rule=ENV_FILE_RULE) -> DataFrame:
    """A finding at line 0 for each ``.env`` or ``.env.*`` file but ``.env.example``."""
    name = basename(F.col("path"))
    hit = (name == ".env") | (name.startswith(".env.") & (name != ".env.example"))
    return files.filter(hit).select(
        *keys, F.lit(rule.label).alias("type"), F.lit(0).alias("line"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.description).alias("description"),
        F.lit(rule.fix).alias("fix"), name.alias("match"), F.lit(rule.category).alias("category"),
        F.lit(-1).alias("rule_ord"), F.lit(0).alias("match_pos"))


def secret_findings(files: DataFrame, rules=SECRET_RULES, keys=("repo", "path"), names: DataFrame | None = None) -> DataFrame:
    """All findings of the scannable files (unsorted); raw matches do not leave here.

    ``names``: the same files without content, where they can be read so for less.
    """
    chosen, named = scan_files(files), scan_files(files if names is None else names)
    lines = src_lines(chosen.select(*keys, "content"), hints=rule_hints(rules))
    firsts = dedup_matches(secret_match(lines, rules), keys)
    described = firsts.join(rules_table(files.sparkSession, rules).drop("label", "regex"), "rule_ord")
    content = described.select(
        *keys, F.col("label").alias("type"), "line", "severity", "description", "fix",
        redact(F.col("raw")).alias("match"), "category", "rule_ord", "match_pos")
    return content.unionByName(env_file_match(named, keys))


FINDING_ORDER = ("path", "line", "rule_ord", "match_pos")


def finding_order(*lead):
    """Worst severity first, then file, line, rule and position."""
    return [*lead, severity_rank(F.col("severity")), *FINDING_ORDER]


def sort_findings(findings: DataFrame, lead=()) -> DataFrame:
    """The findings are kept first: a sort reads its input twice, once to choose its ranges."""
    return keep_result(findings).orderBy(*finding_order(*lead))
