"""Checks of pasted text: literal rules and high-entropy tokens.

A *texts* DataFrame has ``text_id, text`` (and any further columns to keep).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind
from ..functions.regex import jvm
from ..functions.sqltext import case, quote
from ..functions.text import let, redact_entropy, shannon_entropy, two_decimals
from ..rules.literal_rules import (
    ENTROPY_CVSS, ENTROPY_FIX, ENTROPY_MIN_CHARS, ENTROPY_THRESHOLD, ENTROPY_TITLE, ENTROPY_TOKEN_REGEX,
    LITERAL_RULES)

FIELDS = ("title", "match", "severity", "description", "fix", "cve", "cvss", "rule_ord", "match_pos")


def _finding(title, match, severity, description, fix, cvss, rule_ord, match_pos) -> Column:
    values = (title, match, severity, description, fix, F.lit("N/A"), cvss, rule_ord, match_pos)
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(FIELDS, values)])


#: Punctuation of literals, seldom in plain text first.
MARKS = "([*=\"'_-."


def _marks(rules) -> dict[str, str]:
    """Literal -> the mark that its text must hold; only marks that several literals share, so that a test spares some."""
    of = {r.literal.lower(): next((m for m in MARKS if m in r.literal), "") for r in rules}
    shared = [m for m in MARKS if list(of.values()).count(m) > 2]
    return {literal: m for literal, m in of.items() if m in shared}


def _lowered(texts: DataFrame, rules) -> DataFrame:
    """``text``, ``_lower`` and which marks it holds (``_m0``, ``_m1``, ...), each computed once."""
    marks = sorted(set(_marks(rules).values()))
    return bind(bind(texts, text=F.col("text"), _lower=F.lower("text")), **{
        f"_m{i}": F.contains("_lower", F.lit(m)) for i, m in enumerate(marks)})


def _literal_hits(rules) -> Column:
    """Array of one finding per rule whose literal occurs in ``_lower``; see :func:`_lowered`."""
    hits, mark_of = [], _marks(rules)
    marks = sorted(set(mark_of.values()))
    for i, r in enumerate(rules):
        values = (quote(r.title), quote(r.literal), quote(r.severity), quote(r.description), quote(r.fix), "'N/A'",
                  f"{r.cvss}D", str(i), "0")
        fields = ", ".join(f"'{n}', {v}" for n, v in zip(FIELDS, values))
        found = f"contains(_lower, {quote(r.literal.lower())})"
        if mark := mark_of.get(r.literal.lower()):
            found = f"_m{marks.index(mark)} AND {found}"
        hits.append(case([(found, f"named_struct({fields})")], "NULL"))
    return F.expr(f"array_compact(array({', '.join(hits)}))")


def _entropy_hits(text: Column, threshold: float, rule_ord: int) -> Column:
    """Array of one finding per distinct redacted high-entropy token, in text order."""
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(jvm(ENTROPY_TOKEN_REGEX)), F.lit(1)))
    scored = F.transform(
        # Tokens with - or _ are outside both the base64 and the hex alphabet.
        F.filter(tokens, lambda t: (F.char_length(t) >= ENTROPY_MIN_CHARS)
                 & ~F.contains(t, F.lit("-")) & ~F.contains(t, F.lit("_"))),
        lambda t: F.struct(redact_entropy(t).alias("match"), shannon_entropy(t).alias("bits")))
    # Named twice below, so it is bound: the tokens are found and scored once.
    firsts = let(F.filter(scored, lambda s: s["bits"] >= threshold), lambda strong: F.transform(
        F.array_distinct(F.transform(strong, lambda s: s["match"])),
        lambda m: F.filter(strong, lambda s: s["match"] == m)[0]))
    return F.transform(firsts, lambda s, i: _finding(
        ENTROPY_TITLE, s["match"], "HIGH",
        F.concat(F.lit("A high-entropy string (entropy="), two_decimals(s["bits"]),
                 F.lit(" bits/char) was found embedded in code. This pattern is consistent with "
                       "API keys, auth tokens, or passwords.")),
        ENTROPY_FIX, F.lit(ENTROPY_CVSS), F.lit(rule_ord), i))


def _explode(texts: DataFrame, hits: Column, rules=()) -> DataFrame:
    keys = [c for c in texts.columns if c != "text"]
    return _lowered(texts, rules).select(*keys, F.inline(hits))


def analyzed_texts(texts: DataFrame, rules=LITERAL_RULES, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """Every text's keys with its findings as an array column ``hits``: one row per text, nothing is shuffled."""
    keys = [c for c in texts.columns if c != "text"]
    hits = F.concat(_literal_hits(rules), _entropy_hits(F.col("text"), threshold, len(rules)))
    return bind(_lowered(texts, rules), hits=hits).select(*keys, "hits")


def literal_rule_match(texts: DataFrame, rules=LITERAL_RULES) -> DataFrame:
    return _explode(texts, _literal_hits(rules), rules)


def entropy_secrets(texts: DataFrame, threshold: float = ENTROPY_THRESHOLD, rules=LITERAL_RULES) -> DataFrame:
    return _explode(texts, _entropy_hits(F.col("text"), threshold, len(rules)))


def analyze_text(texts: DataFrame, rules=LITERAL_RULES, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    """Literal and entropy findings of each text in one pass, in rule order.

    The two kinds never share a match, so no exchange is needed to
    deduplicate: each is already unique within its text.
    """
    return _explode(texts, F.concat(_literal_hits(rules), _entropy_hits(F.col("text"), threshold, len(rules))), rules)
