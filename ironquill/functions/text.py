"""Column functions on text.  All are built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import WHITESPACE
from .sqltext import any_contains

# Dotted and dotless i, long s and the Kelvin sign.
CASE_TWINS = "".join(chr(c) for c in (0x130, 0x131, 0x17F, 0x212A))
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def unify_newlines(col: Column) -> Column:
    """Universal newlines: CRLF and lone CR become LF."""
    return F.replace(F.replace(col, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def fold(col: Column) -> Column:
    """Lower case in which the letters that match i, s and k without case are i, s and k.

    A text matched by a case-insensitive ASCII literal always contains that
    literal in lower case after folding.
    """
    plain = F.lower(col)
    return F.when(F.octet_length(col) == F.char_length(col), plain).otherwise(
        F.lower(F.translate(col, CASE_TWINS, "iisk")))


def contains_any(name: str, needles) -> Column:
    """True if the column ``name`` holds one of the needles."""
    return F.expr(any_contains(f"`{name}`", needles))


def redact(col: Column) -> Column:
    """First six characters, up to eight stars, a marker; short values vanish."""
    n = F.char_length(col)
    return F.when(n <= 6, F.lit("***")).otherwise(F.concat(
        F.substring(col, 1, 6), F.repeat(F.lit("*"), F.least(F.lit(8), n - 6)), F.lit("  (redacted)")))


def redact_entropy(col: Column) -> Column:
    return F.concat(F.substring(col, 1, 6), F.lit("···"), F.substring(col, -4, 4))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it; also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def shannon_entropy(col: Column) -> Column:
    """Bits per character; 0 for the empty string.

    Each distinct character is taken out of what the ones before it have left,
    so that the frequent ones, which come early, shorten the text for the rest.
    """
    def total(n):
        start = F.struct(col.alias("rest"), n.alias("left"), F.lit(0.0).alias("bits"))

        def part(acc, c):
            def removed(rest):
                return let(F.char_length(rest), lambda left: let(
                    (acc["left"] - left) / n.cast("double"),
                    lambda p: F.struct(rest.alias("rest"), left.alias("left"), (acc["bits"] - p * F.log2(p)).alias("bits"))))

            return let(F.replace(acc["rest"], c, F.lit("")), removed)

        return F.aggregate(F.array_distinct(F.split(col, "")), start, part, lambda acc: acc["bits"])

    return F.when(F.char_length(col) == 0, F.lit(0.0)).otherwise(let(F.char_length(col), total))


def two_decimals(col: Column) -> Column:
    """Text with two decimals, ties to even."""
    return F.bround(col.cast("decimal(20,15)"), 2).cast("decimal(20,2)").cast("string")


def html_escape(col: Column, quote: bool = True) -> Column:
    """Escape & < > " and (unless ``quote`` is false) the apostrophe."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return F.replace(col, F.lit("'"), F.lit("&#x27;")) if quote else col


def key_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_ext(path: Column) -> Column:
    """Lower-case extension with its dot; leading dots of a name are not one."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)$", 1))


def in_dirs(path: Column, dirs) -> Column:
    """True if some directory of the path (not its last part) is one of ``dirs``."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
                            F.array(*[F.lit(d) for d in dirs]))


def version_parse(col: Column) -> Column:
    """Every run of digits as a number of any length (see ``number_key``); no digits at all give [0]."""
    nums = F.transform(F.regexp_extract_all(col, F.lit(r"\p{Nd}+"), F.lit(0)), number_key)
    return F.when(F.size(nums) > 0, nums).otherwise(F.array(number_key(F.lit("0"))))


def number_key(digits: Column) -> Column:
    """A number as its digits, which sort by how many there are and then as text."""
    bare = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.struct(F.char_length(bare).alias("digits"), bare.alias("number"))


def cvss_severity(col: Column) -> Column:
    score = col.cast("string").try_cast("double")
    return (F.when(score.isNull(), "UNKNOWN").when(F.isnan(score), "NONE")
            .when(score >= 9, "CRITICAL").when(score >= 7, "HIGH")
            .when(score >= 4, "MEDIUM").when(score > 0, "LOW").otherwise("NONE"))


def cvss_badge(col: Column) -> Column:
    """The dashboard's variant: lower case, and nothing below low."""
    score = col.cast("double")
    return (F.when(score >= 9, "critical").when(score >= 7, "high")
            .when(score >= 4, "medium").otherwise("low"))


def severity_rank(col: Column) -> Column:
    """0 for CRITICAL to 3 for LOW, 9 for anything else."""
    return (F.when(col == "CRITICAL", 0).when(col == "HIGH", 1)
            .when(col == "MEDIUM", 2).when(col == "LOW", 3).otherwise(9))


def first_match(cases, default) -> Column:
    """CASE over (condition, value) pairs: the first true condition decides."""
    chain = None
    for cond, value in cases:
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return default if chain is None else chain.otherwise(default)
