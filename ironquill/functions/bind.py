"""Evaluate a column once, where it stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read instead of repeating their expressions.

    The optimizer copies an ordinary column's expression into every filter
    that uses it, so a test for fifty literals would lower-case the text fifty
    times.  The output of a generator is never copied; this one makes exactly
    one row per row.
    """
    if not columns:
        return df
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(n) for n, v in columns.items()]))))
