"""Product codes of vectors; the nearest entry is found by slicing and intersecting bit masks.

Of each part position the entries' coordinates are sorted, dimension by
dimension, and each place in that order carries the mask of the entries before
it. A radius selects one range of places per dimension: the two masks at its
ends differ in the entries inside. The AND over all dimensions leaves the
entries in a cube around the part. The nearest of them is the nearest of all
if it is no farther than the radius; if it is, its distance is the next
radius, and if the cube is empty, the radius doubles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironquill.llm.shared import cut

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components stay below this, so that sums of squared differences stay within 64 bits.
LARGEST = 1 << 27
#: Vectors compared at once.
_ROWS = 1024


class Slices:
    """The entries (a row each) of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, dims = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0).T.copy()
        bits = np.zeros((n, (n + 63) // 64), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        self.all = np.bitwise_or.reduce(bits, axis=0)
        self.before = np.zeros((dims, n + 1, bits.shape[1]), np.uint64)
        for j in range(dims):
            self.before[j, 1:] = np.bitwise_or.accumulate(bits[order[:, j]], axis=0)
        self.squares = (entries * entries).sum(axis=1)
        self.largest = int(np.abs(entries).max(initial=0))
        self.first = self._first_radius()

    def _first_radius(self) -> int:
        """The usual largest coordinate difference between an entry and the one next to it."""
        gaps = []
        for e in self.entries:
            apart = np.abs(self.entries - e).max(axis=1, initial=0)
            gaps.append(apart[apart > 0].min(initial=LARGEST))
        return int(np.median(gaps))

    def within(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Of each part the mask of the entries that differ by at most its radius in every dimension."""
        found = np.broadcast_to(self.all, (len(parts), len(self.all))).copy()
        for j, (line, before) in enumerate(zip(self.sorted, self.before, strict=True)):
            low = np.searchsorted(line, parts[:, j] - radius, "left")
            high = np.searchsorted(line, parts[:, j] + radius, "right")
            found &= before[high] ^ before[low]
        return found

    def _closest(self, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part the nearest entry in its mask, the first of equally near ones (-1: none), and its squared distance."""
        n = len(self.entries)
        inside = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
        size = inside.sum(axis=1)
        index, distance = np.full(len(parts), -1), np.zeros(len(parts), np.int64)
        few = np.flatnonzero((size > 0) & (size <= n // 8))
        if few.size:
            row, entry = np.nonzero(inside[few])
            apart = parts[few][row] - self.entries[entry]
            apart = np.einsum("ij,ij->i", apart, apart)
            starts = np.cumsum(size[few]) - size[few]
            least = np.minimum.reduceat(apart, starts)
            index[few] = np.minimum.reduceat(np.where(apart == least[row], entry, n), starts)
            distance[few] = least
        many = np.flatnonzero(size > n // 8)
        if many.size:
            some = parts[many]
            # Products of whole numbers are exact in doubles while their sums stay below 2^53.
            exact = some.shape[1] * max(int(np.abs(some).max(initial=0)), self.largest) ** 2 < 1 << 50
            kind = np.float64 if exact else np.int64
            apart = (some * some).sum(axis=1)[:, None] - 2 * (some.astype(kind) @ self.entries.T.astype(kind)).astype(np.int64) + self.squares
            apart[~inside[many]] = np.iinfo(np.int64).max
            index[many] = apart.argmin(axis=1)
            distance[many] = apart.min(axis=1)
        return index, distance

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each part the index of its nearest entry (ties: the lower) and the squared distance."""
        index, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        left, radius = np.arange(len(parts)), np.full(len(parts), self.first, np.int64)
        while left.size:
            some = parts[left]
            found, apart = self._closest(some, self.within(some, radius))
            sure = (found >= 0) & (apart <= radius * radius)
            index[left[sure]], distance[left[sure]] = found[sure], apart[sure]
            bound = np.ceil(np.sqrt(apart)).astype(np.int64)
            bound += bound * bound < apart
            radius = np.where(found >= 0, bound, 2 * radius + 1)[~sure]
            left = left[~sure]
        return index, distance


def scaled(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as whole numbers, a row each."""
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if np.abs(values).max(initial=0) >= LARGEST:
        raise ValueError(f"a vector has a component beyond {LARGEST // SCALE}")
    return values.astype(np.int64).reshape(len(column), dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _codebooks(vectors: np.ndarray) -> list[np.ndarray]:
    return np.split(vectors, PARTS, axis=1)


def _summed(books: list[np.ndarray], dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each entry the count and the componentwise sum of the parts that a task assigns to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        sums = np.zeros((PARTS, len(books[0]), dims // PARTS), np.int64)
        for batch in _blocks(batches):
            for p, part in enumerate(_codebooks(scaled(batch.column(0), dims))):
                entry, _ = slices[p].nearest(part)
                np.add.at(sums[p], entry, part)
                counts[p] += np.bincount(entry, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["_part", "_entry", "_n", "_sum"])

    return run


def _coded(books: list[np.ndarray], dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in _blocks(batches):
            found = [s.nearest(p) for s, p in zip(slices, _codebooks(scaled(batch.column(0), dims)), strict=True)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(error, pa.int64())],
                ["_id", "_label", "_code", "_error"])

    return run


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``_vector, _id, _label`` of the rows whose vector is there, without null, NaN or infinite components."""
    narrow = vectors.select(F.col(f"`{vec_col}`").cast("array<double>").alias("_vector"), F.col(f"`{id_col}`").alias("_id"),
                            F.col(f"`{label_col}`").alias("_label"))
    return narrow.filter("_vector is not null and forall(_vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def train(kept: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebook of each part position after ``rounds`` rounds, and the vectors' length (no codebook: no vectors).

    The first entries are the vectors with the smallest ids (nulls last, then
    by components). A round is one pass: each task adds up the parts that it
    assigns, so that the shuffle and the driver see codebook-sized sums only.
    """
    first = kept.orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).collect()
    if not first:
        return [], 0
    dims = len(first[0]["_vector"])
    if dims % PARTS:
        raise ValueError(f"vectors of length {dims} have no {PARTS} equal parts")
    rows = [r["_vector"] for r in first if len(r["_vector"]) == dims]
    books = _codebooks(scaled(pa.array(rows, pa.list_(pa.float64())), dims))
    same = kept.filter(F.size("_vector") == dims).select("_vector")
    for _ in range(rounds):
        sums = same.mapInArrow(_summed(books, dims), "_part int, _entry int, _n long, _sum array<long>").groupBy("_part", "_entry").agg(
            F.sum("_n").alias("n"), F.array(*[F.sum(F.col("_sum")[i]) for i in range(dims // PARTS)]).alias("total"))
        books = [b.copy() for b in books]
        for row in sums.collect():
            books[row["_part"]][row["_entry"]] = [x // row["n"] for x in row["total"]]
    return books, dims


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and place, in decimal, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(kept: DataFrame, books: list[np.ndarray], dims: int) -> DataFrame:
    """``_id, _label, _code, _error``: the entry of each part, a byte each, and the summed squared distance."""
    label = kept.schema["_label"].dataType
    schema = T.StructType([kept.schema["_id"], T.StructField("_label", label), T.StructField("_code", T.BinaryType()), T.StructField("_error", T.LongType())])
    if not books:
        return kept.sparkSession.createDataFrame([], schema)
    return kept.filter(F.size("_vector") == dims).mapInArrow(_coded(books, dims), schema)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector that can be coded.

    Vectors that are null or hold null or non-finite components are dropped;
    so are those of another length than the vector with the smallest id, as no
    entry is of their length. Repeated and null ids are rows like any other.
    Fewer than ``entries`` vectors make a smaller codebook; an empty table
    gives no rows. Components beyond 131,072 stop the job: their squares
    would not fit.
    """
    kept = kept_vectors(vectors, id_col, vec_col, label_col)
    books, dims = train(kept, entries, rounds)
    found = cut(coded(kept, books, dims), "codes")
    # One row per label, written so that Spark knows its size and ships it while it is small.
    labels = cut(found.groupBy("_label").agg(F.sum("_error").alias("_label_error")), "label-errors")
    both = F.col("f._label").eqNullSafe(F.col("l._label"))
    return found.alias("f").join(labels.alias("l"), both).select(
        F.col("_id").alias("vec_id"), F.lower(F.hex("_code")).alias("code"), F.col("_error").alias("error"),
        F.col("_label_error").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
