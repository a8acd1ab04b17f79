"""Secrets by rules whose candidates come from a trigram index, in Spark expressions only.

Each rule's pattern implies a Boolean query of trigrams. The index holds, for
each trigram of any query, the documents that have it; intersecting these
postings gives a rule's candidates, and only they are matched. A rule whose
pattern implies no trigram is matched against every document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironquill.llm.shared import whole
from ironquill.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """Leftmost matches that do not overlap count if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The kinds and patterns that results must equal. A run of hex digits, or of what may follow
# AKIA, is matched as a whole or not at all, so its length stands in the pattern.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("login", r"[a-z]{3,10}://[A-Za-z0-9._-]{1,64}:[^ \t\r\n/@:]{3,64}@[A-Za-z0-9.-]+"),
)
RULES = (*BASE_RULES, *MORE_RULES)


def query_trigrams(rules: Sequence[Rule]) -> list[str]:
    return sorted({t for r in rules for part in trigram_query(r.pattern) for t in part})


def trigram_postings(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: ``_trigram`` (its number), ``_id``, one row for each document that has it, in either case."""
    folded = docs.select(F.col(id_col).alias("_id"), F.lower(whole(text_col)).alias("_low"))
    have = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(t)), n) for n, t in enumerate(trigrams)])) if trigrams else F.array().cast("array<int>")
    return folded.select("_id", F.explode(have).alias("_trigram")).select("_trigram", "_id")


def candidates(postings: DataFrame, rules: Sequence[Rule], trigrams: Sequence[str]) -> DataFrame:
    """``_id, _rules``: numbers of the rules whose query the document's trigrams satisfy.

    Rows that share an id share their candidates, which verification settles.
    """
    number = {t: n for n, t in enumerate(trigrams)}

    def holds(rule: Rule) -> Column:
        parts = [F.lit(True) if not part else _all([F.array_contains("_has", number[t]) for t in sorted(part)]) for part in trigram_query(rule.pattern)]
        out = parts[0]
        for part in parts[1:]:
            out = out | part
        return out

    sets = postings.groupBy("_id").agg(F.collect_set("_trigram").alias("_has"))
    listed = F.array_compact(F.array(*[F.when(holds(r), n) for n, r in enumerate(rules)]))
    return sets.select("_id", listed.alias("_rules")).filter(F.size("_rules") > 0)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def rule_spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, in code points, end exclusive.

    What lies between matches is what the text splits into at them, so
    positions are running sums of lengths.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    lengths = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else matches
    both = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("match"), lengths.alias("part"))
    nothing = F.array().cast("array<struct<s:int,e:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        good = F.when(x["match"].isNotNull() & (F.length(x["part"]) >= rule.least), F.array(F.struct(start.alias("s"), end.alias("e")))).otherwise(nothing)
        return F.struct(end.alias("at"), F.concat(acc["out"], good).alias("out"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), nothing.alias("out")), step, lambda acc: acc["out"])


def secret_spans(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _spans`` for every row: spans (start, rule number, end) in order. A null text is empty.

    Rules without mandatory trigrams are matched where the text is read; the
    others after the join with their candidates.
    """
    free = [n for n, r in enumerate(rules) if frozenset() in trigram_query(r.pattern)]
    bound = [n for n in range(len(rules)) if n not in free]
    trigrams = query_trigrams([rules[n] for n in bound])
    wanted = candidates(trigram_postings(docs, trigrams, id_col, text_col), [rules[n] for n in bound], trigrams)
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")

    def found(n: int) -> Column:
        rule = rules[n]
        spans = F.transform(rule_spans(F.col("_text"), rule), lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e")))
        return F.when(F.rlike(F.col("_text"), F.lit(rule.pattern)), spans).otherwise(none)

    read = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    read = read.withColumn("_free", F.concat(none, *[found(n) for n in free]))
    joined = read.alias("d").join(wanted.alias("w"), F.col("d._id").eqNullSafe(F.col("w._id")), "left").select("d.*", "_rules")
    verified = [F.when(F.array_contains("_rules", i), found(n)).otherwise(none) for i, n in enumerate(bound)]
    return joined.select("_id", F.sort_array(F.concat(F.col("_free"), *verified)).alias("_spans"))


def span_text(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
