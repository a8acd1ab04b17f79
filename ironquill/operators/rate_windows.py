"""Windows that each open at the first row after the last one has closed, along sorted rows of any number.

Where a window opens depends on where the one before it did.  Sorted rows are
dealt into slices; what a slice does to the window open at its begin is a step
function of that window's start, and such functions compose: the work on the
slices is independent, and a row of slices that one key fills is composed by
doubling spans.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.small import small_table
from ..session import checkpointed, keep_result

State = tuple[int, int]  # start of the open window, rows in it so far


@dataclasses.dataclass
class Steps:
    """What rows of one key do to the window open before them.

    A window that began at ``s`` closes with the first of them later than
    ``s`` + width, and the window that is open at their end depends on that
    row alone.  ``e[i]`` are such rows' times, the last of those that lead to
    the same end, ``x[i]`` and ``c[i]`` the end's start and count.  ``through``:
    a window may outlast them all and then has ``size`` rows more.
    """

    e: np.ndarray
    x: np.ndarray
    c: np.ndarray
    size: int
    through: bool

    @classmethod
    def of(cls, t: np.ndarray, width: int) -> Steps:
        """Of sorted times.  Windows open before them have closed by the first one plus ``width``."""
        n = len(t)
        after, end = np.searchsorted(t, t + width, "right").tolist(), list(range(n))
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                end[i] = end[after[i]]
        k = int(np.searchsorted(t, t[0] + width, "right"))
        last = np.array(end[: k + 1])
        return cls(t[: k + 1], t[last], n - last, n, k == n).merged()

    def merged(self) -> Steps:
        """Equal ends side by side as one step."""
        keep = np.append((self.x[1:] != self.x[:-1]) | (self.c[1:] != self.c[:-1]), True)
        return dataclasses.replace(self, e=self.e[keep], x=self.x[keep], c=self.c[keep])

    def after(self, states: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
        start, count = states
        i = np.searchsorted(self.e, start + width, "right")
        hit = i < len(self.e)
        i = np.minimum(i, len(self.e) - 1)
        return np.where(hit, self.x[i], start), np.where(hit, self.c[i], count + self.size)

    def end(self, state: State | None, width: int) -> State:
        if state is None:
            return int(self.x[0]), int(self.c[0])
        x, c = self.after((np.array([state[0]]), np.array([state[1]])), width)
        return int(x[0]), int(c[0])

    def then(self, later: Steps, width: int) -> Steps:
        x, c = self.after_all(later, width)
        e = self.e
        if self.through:
            e, x, c = np.append(e, later.e), np.append(x, later.x), np.append(c, later.c)
        return Steps(e, x, c, self.size + later.size, self.through and later.through).merged()

    def after_all(self, later: Steps, width: int) -> tuple[np.ndarray, np.ndarray]:
        return later.after((self.x, self.c), width)


_COLUMNS = "no int, start bigint, count bigint, size bigint, through boolean, e array<bigint>, x array<bigint>, c array<bigint>"


def _row(no: int, state: State | None, steps: Steps | None) -> pd.DataFrame:
    """A slice's end: a state where it is known, else steps."""
    row = {"no": no, "start": None, "count": None, "size": None, "through": None, "e": None, "x": None, "c": None}
    if state is not None:
        row |= {"start": state[0], "count": state[1]}
    else:
        row |= {"size": steps.size, "through": steps.through, "e": steps.e.tolist(), "x": steps.x.tolist(), "c": steps.c.tolist()}
    return pd.DataFrame([row]).astype({"start": "Int64", "count": "Int64", "size": "Int64", "through": "boolean"})


def _steps(row) -> Steps:
    return Steps(*(np.asarray(row[n], np.int64) for n in ("e", "x", "c")), int(row["size"]), bool(row["through"]))


def _summaries(width: int):
    """Sorted rows of a slice's last key -> its end: known if the key begins in the slice, else steps."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        no, whole, state, times = None, False, None, []
        for pdf in batches:
            if not len(pdf):
                continue
            no, whole = int(pdf["no"].iat[0]), bool(pdf["whole"].iat[0])
            if whole:
                times.append(pdf["t"].to_numpy())
                continue
            start, count = state or (None, 0)
            for t in pdf["t"].tolist():
                if start is None or t - start > width:
                    start, count = t, 1
                else:
                    count += 1
            state = start, count
        if no is not None:
            yield _row(no, state, Steps.of(np.concatenate(times), width) if whole else None)

    return run


def _composed(width: int):
    """Two neighbours -> the later one's end after the earlier one's."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        steps, no = _steps(row), int(row["no"])
        if pd.isna(row["p_no"]):  # nothing of the key comes before
            return _row(no, steps.end(None, width), None)
        if not pd.isna(row["p_start"]):
            return _row(no, steps.end((int(row["p_start"]), int(row["p_count"])), width), None)
        return _row(no, None, _steps({c: row[f"p_{c}"] for c in ("e", "x", "c", "size", "through")}).then(steps, width))

    return run


def _resolved(ends: DataFrame, width: int) -> DataFrame:
    """``no, start, count``: the state at the end of every slice.  Each round doubles the slices that steps span."""
    known, open_ends, span = ends.filter("start is not null"), ends.filter("start is null"), 1
    while not open_ends.isEmpty():
        before = known.unionByName(open_ends).select(*[F.col(c).alias(f"p_{c}") for c in ends.columns])
        pairs = open_ends.join(before, F.col("p_no") == F.col("no") - span, "left")
        made = keep_result(pairs.groupBy("no").applyInPandas(_composed(width), _COLUMNS))
        known, open_ends, span = known.unionByName(made.filter("start is not null")), made.filter("start is null"), 2 * span
    return known.select("no", "start", "count")


def _numbered(width: int, keys: list[str], entries: dict[int, tuple[tuple, State]]):
    """Sorted rows of a slice -> window start and number of each; only the running state crosses batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, count, fresh = None, None, 0, True
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            if fresh:
                key, (start, count) = entries.get(int(pdf["slice"].iat[0]), (None, (None, 0)))
                fresh = False
            starts, counts = np.empty(n, np.int64), np.empty(n, np.int64)
            for i, (own, t) in enumerate(zip(zip(*(pdf[k] for k in keys), strict=True), pdf["t"].tolist(), strict=True)):
                if own != key:
                    key, start = own, None
                if start is None or t - start > width:
                    start, count = t, 1
                else:
                    count += 1
                starts[i], counts[i] = start, count
            yield pdf.drop(columns="slice").assign(window_start=starts, n=counts)

    return run


def anchored_windows(rows: DataFrame, keys: list[str], tie: str, width: int, slices: int | None = None) -> DataFrame:
    """``rows`` (``keys``, ``t``: long, ``tie``) with ``window_start`` and ``n``, the row's number in its window.

    Rows are sorted into ``slices`` ranges of about as many rows each (the
    session's shuffle partitions if not given) and stay there; keys are
    strings without nulls.  The driver sees the first and last key of each
    slice, and the window open at its end where the key goes on in the next
    one.  A task holds at most one slice's times, and those only of a key that
    fills the slice and its borders.
    """
    spark, order = rows.sparkSession, [*keys, "t", tie]
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.select(*order).repartitionByRange(count, *order).sortWithinPartitions(*order)
                         .withColumn("slice", F.spark_partition_id()))
    key = F.struct(*keys)
    borders = sorted((r["slice"], tuple(r["a"]), tuple(r["z"])) for r in
                     dealt.groupBy("slice").agg(F.min(key).alias("a"), F.max(key).alias("z")).collect())
    # Slices whose last key goes on in the next one; whole: it also came from the one before and fills this one.
    on = [(s, no, no > 0 and a == z and borders[no - 1][2] == a, *z) for no, (s, a, z) in enumerate(borders[:-1]) if z == borders[no + 1][1]]
    entries = {}
    if on:
        wanted = small_table(spark, on, "slice int, no int, whole boolean, " + ", ".join(f"{k} string" for k in keys))
        # The small side is shipped, so rows keep their slices and their order.
        ends = keep_result(dealt.join(F.broadcast(wanted), ["slice", *keys]).select("no", "whole", "t").mapInPandas(_summaries(width), _COLUMNS))
        entries = {borders[r["no"] + 1][0]: (borders[r["no"]][2], (r["start"], r["count"])) for r in _resolved(ends, width).collect()}
    schema = dealt.drop("slice").schema.simpleString()[7:-1] + ",window_start:bigint,n:bigint"
    return dealt.mapInPandas(_numbered(width, keys, entries), schema.replace(":", " "))
