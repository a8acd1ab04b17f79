"""Running counts and carried values that survive one hot key.

A plain window over a key sorts the whole key in one task.  These operators
cut each key into slices of its order (say, minutes): a slice is the unit of
sorting, and only one row per slice goes through the window over the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _null_safe(left: DataFrame, right: DataFrame, cols, how="inner") -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    cond = None
    for c in cols:
        eq = left[c].eqNullSafe(renamed[f"_r_{c}"])
        cond = eq if cond is None else cond & eq
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in cols])


def running_count(df: DataFrame, keys, slice_col: str, order, out: str) -> DataFrame:
    """1-based position of each row within ``keys`` in the order (slice, *order)."""
    keys = list(keys)
    per_slice = df.groupBy(*keys, slice_col).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select(*keys, slice_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*keys, slice_col).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(here))
    return (_null_safe(ranked, base, [*keys, slice_col])
            .withColumn(out, F.col("_rn").cast("bigint") + F.col("_base")).drop("_rn", "_base"))


def carry_last(df: DataFrame, keys, slice_col: str, order_col: str, value_col: str, out: str,
               include_current: bool = False) -> DataFrame:
    """Last non-null ``value_col`` of earlier rows of the same keys.

    ``order_col`` must be unique within the keys and agree with ``slice_col``.
    """
    keys = list(keys)
    per_slice = df.groupBy(*keys, slice_col).agg(
        F.max_by(value_col, F.when(F.col(value_col).isNotNull(), F.col(order_col))).alias("_v"))
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    base = per_slice.select(*keys, slice_col, F.last("_v", ignorenulls=True).over(before).alias("_base"))
    end = 0 if include_current else -1
    here = (Window.partitionBy(*keys, slice_col).orderBy(order_col)
            .rowsBetween(Window.unboundedPreceding, end))
    seen = df.withColumn("_here", F.last(value_col, ignorenulls=True).over(here))
    return (_null_safe(seen, base, [*keys, slice_col])
            .withColumn(out, F.coalesce("_here", "_base")).drop("_here", "_base"))


def first_rows(df: DataFrame, keys, order, k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per key, numbered; rows beyond k are cut before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)
