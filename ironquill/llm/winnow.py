"""Document fingerprints by winnowing, in Spark expressions only.

A text is read as tokens: runs of up to TOKEN code points without white space,
so that a text without any has tokens too. Every run of GRAM tokens, with the
white space in it, is hashed; of each WINDOW successive hashes the smallest is
kept with its position, of equal ones the rightmost. Two texts that share
GRAM + WINDOW - 1 tokens in a row share a fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ironquill.llm.shared import hexed, whole

TOKEN = 6
GRAM = 3
WINDOW = 4
#: Low half of a mark: the complement of the position, so that of equal hashes the rightmost is the smallest.
_LOW = 0xFFFFFFFF


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Marks of a text in order of position: array of long, each a hash and a position (``mark_hash``, ``mark_place``).

    A text of fewer than ``gram`` tokens is one run; one with fewer runs than
    ``window`` has one window; an empty or null text has no marks. Memory
    follows the longest text: some 50 bytes a code point.
    """
    text = F.coalesce(text, F.lit(""))
    token = f"\\S{{1,{TOKEN}}}+"
    run = r"\s*+".join([token] * gram)
    found = F.regexp_extract_all(text, F.lit(f"(?=({run})){token}"), F.lit(1))
    runs = F.when(F.size(found) > 0, found).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))

    def pack(run: Column, at: Column) -> Column:
        return F.xxhash64(run).bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.lit(_LOW) - at)

    def least(h: Column) -> Column:
        windows = F.greatest(F.size(h) - window + 1, F.least(F.size(h), F.lit(1)))
        return F.array_distinct(F.slice(_least(h, window), F.lit(1), windows))

    return _let(F.transform(runs, pack), least)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _least(values: Column, window: int) -> Column:
    """Minimum of each value and the window - 1 after it, by doubling; at the end, of those there are."""
    done, out = 1, values
    while done < window:
        step = min(done, window - done)
        out = _let(out, _pairwise(step))
        done += step
    return out


def _pairwise(step: int) -> Callable[[Column], Column]:
    return lambda m: F.zip_with(m, F.slice(m, F.lit(step + 1), F.size(m)), lambda a, b: F.least(a, b))


def mark_hash(mark: Column) -> Column:
    return F.shiftright(mark, 32).cast("int")


def mark_place(mark: Column) -> Column:
    """Position of the run's first token, from 0."""
    return F.lit(_LOW) - mark.bitwiseAND(F.lit(_LOW))


def hashes(marks: Column) -> Column:
    return F.array_distinct(F.transform(marks, mark_hash))


def digest(marks: Column) -> Column:
    """One string for all marks with their positions: equal for equal texts."""
    return F.sha2(F.encode(F.concat_ws(",", marks.cast("array<string>")), "UTF-8"), 256)


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of both; 1 if neither text has any."""
    return _let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(
        both / (F.size(a) + F.size(b) - both)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``_id, _hash, _place``: one row per mark."""
    marks = docs.select(F.col(id_col).alias("_id"), F.explode(winnowed(F.col(text_col), gram, window)).alias("_mark"))
    return marks.select("_id", mark_hash(F.col("_mark")).alias("_hash"), mark_place(F.col("_mark")).alias("_place"))


def with_next(docs: DataFrame, columns: list[str], order_col: str) -> DataFrame:
    """``docs`` with a struct ``_next`` of ``columns`` of the row that follows by ``order_col``, a whole number.

    After the last row comes the first. A null stands before all numbers; of
    rows that share a number the smaller text digest (``_sha``) comes first.
    The rows are cut into some four ranges to a shuffle partition; each range
    also gets the first row of the one after it, so no window spans the table.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(order_col).cast("long"), F.lit(-(1 << 63)))
    # Several ranges to a partition, so that partitions differ little in size.
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = docs.select(key.alias("_key")).agg(
        F.min("_key"), F.percentile_approx("_key", [i / parts for i in range(1, parts)] or [0.5], 10 * parts + 100)).first()
    if bounds[0] is None:
        return docs.withColumn("_next", F.struct(*columns))
    # Numbers that occur: each begins a range; the smallest begins the first, and follows the last.
    starts = sorted({bounds[0], *bounds[1]})
    begin = F.array(*[F.lit(x) for x in starts])
    ranged = docs.withColumn("_key", key).withColumn("_range", F.size(F.filter(begin, lambda b: b <= F.col("_key"))) - 1)
    before = F.pmod(F.col("_range") - 1, F.lit(len(starts)))
    places = F.when(F.array_contains(begin, F.col("_key")), F.array(
        F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest")), F.struct(before.alias("range"), F.lit(1).alias("guest")))
    ).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))))
    spread = ranged.withColumn("_place", F.explode(places)).withColumns({"_range": F.col("_place.range"), "_guest": F.col("_place.guest")})
    order = Window.partitionBy("_range").orderBy("_guest", "_key", "_sha")
    return spread.withColumn("_next", F.lead(F.struct(*columns)).over(order)).filter("_guest = 0").drop("_range", "_guest", "_place", "_key")


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each row's text, of its edited text and of the next row's, compared.

    The edited text has its last floor(n / 2) code points replaced by the
    first as many (or all) of the next row's text. Columns: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_marks, edited_n_marks``. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("_text"))
    own = own.withColumn("_marks", winnowed(F.col("_text"), gram, window))
    own = own.select("_id", "_text", hexed(F.col("_text")).alias("_sha"), hashes(F.col("_marks")).alias("_hashes"),
                     digest(F.col("_marks")).alias("_digest"), F.size("_marks").alias("_n_marks"))
    paired = with_next(own, ["_text", "_hashes"], "_id")
    n = F.length("_text")
    half = F.floor(n / 2).cast("int")
    paired = paired.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), n - half), F.substring(F.col("_next._text"), F.lit(1), half)))
    paired = paired.withColumn("_edited_marks", winnowed(F.col("_edited"), gram, window))
    return paired.select(
        F.col("_id").alias("doc_id"), n.cast("long").alias("n_chars"), hexed(F.col("_edited")).alias("edited_sha256"),
        F.col("_digest").alias("fingerprint"), digest(F.col("_edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("_hashes"), hashes(F.col("_edited_marks"))).alias("near_edited"),
        likeness(F.col("_hashes"), F.col("_next._hashes")).alias("near_next"),
        F.col("_n_marks").alias("n_marks"), F.size("_edited_marks").alias("edited_n_marks"))
