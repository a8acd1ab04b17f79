"""Mixing sources to target weights by Poisson replication.

A source with weight w of a mixture of T units, and with S units of its own,
is to be repeated w * T / S times on average. Each document's count is drawn
from the Poisson distribution with that mean by inverting it at a uniform
number hashed from a seed and the document's id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = "mix-1"
#: More target weights than this are refused, as their table is broadcast.
MOST_WEIGHTS = 10_000
ADDED = ("_copy", "_copies", "_rate", "_place")


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from 52 hashed bits."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_steps(mean: Column) -> Column:
    """The distribution function at 0, 1, 2, ... up to where it is 1 in double precision.

    In logarithms, so that large means do not underflow.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    zero = F.struct((-mean).alias("lp"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("steps"))

    def add(acc: Column, k: Column) -> Column:
        lp = acc["lp"] + F.log(mean / k)
        total = acc["sum"] + F.exp(lp)
        return F.struct(lp.alias("lp"), total.alias("sum"), F.concat(acc["steps"], F.array(total)).alias("steps"))

    return F.when(mean <= 0, F.array(F.lit(1.0))).otherwise(F.aggregate(F.sequence(F.lit(1), last), zero, add, lambda acc: acc["steps"]))


def rates(docs: DataFrame, weights: Mapping[str, float], source_col: str = "source", size: Column | None = None,
          total: float | None = None, rest: float | None = None) -> DataFrame:
    """``_source, _rate, _steps``: one row per target weight and one (null) for all other sources together.

    ``size``: units of a row, 1 each unless given. ``total``: units of the
    mixture, those of the input unless given. ``rest``: the weight that the
    sources without a target share, what is left of 1 unless given.
    """
    if len(weights) > MOST_WEIGHTS or any(w < 0 for w in weights.values()):
        raise ValueError("weights must be few and not negative")
    rest = max(0.0, 1.0 - sum(weights.values())) if rest is None else rest
    units = F.lit(1.0) if size is None else size.cast("double")
    # At most one row per target weight and one more, whatever the documents hold.
    sums = docs.select(_listed(source_col, weights).alias("_of"), units.alias("_units")).groupBy("_of").agg(F.sum("_units").alias("_units"))
    targets = F.lit(rest)
    if weights:
        listed = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))])
        targets = F.when(F.col("_of").isNull(), rest).otherwise(F.element_at(listed, F.col("_of")))
    mixture = F.sum("_units").over(Window.partitionBy(F.lit(0))) if total is None else F.lit(float(total))
    rate = F.when(F.col("_units") > 0, targets * mixture / F.col("_units")).otherwise(0.0)
    return sums.select(F.col("_of").alias("_source"), rate.alias("_rate")).withColumn("_steps", poisson_steps(F.col("_rate")))


def _listed(source_col: str, weights: Mapping[str, float]) -> Column:
    """The source if it has a target weight, else null."""
    return F.when(F.col(source_col).isin(list(weights)), F.col(source_col)) if weights else F.lit(None).cast("string")


def replicate(docs: DataFrame, weights: Mapping[str, float], id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
              total: float | None = None, rest: float | None = None, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` as often as drawn, with ``_copy`` (1, 2, ...), ``_copies``, ``_rate``, shuffled globally.

    Null and unknown sources share the rest weight. Rows that repeat an id
    share its draw; rows with a null id are drawn by source. The order is that
    of a hash of seed, id and copy: rows go to random partitions and lie in
    random order there. A source's repetitions spread over all partitions.
    Columns of ``docs`` with one of the four names give way to the new ones.
    """
    table = rates(docs, weights, source_col, size, total, rest)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("_row"), F.col(id_col).alias("_id"),
                         F.col(source_col).alias("_from"), _listed(source_col, weights).alias("_of"))
    drawn = marked.join(F.broadcast(table), F.col("_of").eqNullSafe(F.col("_source")))
    u = uniform(seed, F.col("_id"), F.when(F.col("_id").isNull(), F.col("_from")))
    # As many copies as there are steps below the drawn number.
    counted = drawn.withColumn("_u", u).withColumn("_copies", F.expr("size(filter(_steps, s -> s < _u))"))
    copies = counted.filter("_copies > 0").select("_row", "_id", "_rate", "_copies", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy"))
    place = F.md5(F.concat_ws(":", F.lit(seed), F.lit("place"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.col("_copy").cast("string")))
    shuffled = copies.withColumn("_place", place).repartition("_place").sortWithinPartitions("_place")
    return shuffled.select("_row.*", *ADDED)
