"""Near duplicates by SimHash, found through deletion variants of fingerprint segments.

The 64 bits are cut into so few segments that two fingerprints within the
distance differ by at most one bit in one of them (three for distance 4).
Each segment is indexed under its variants with one bit blanked out, so such
a pair meets under an equal key; the full distance is then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironquill.llm.components import components
from ironquill.llm.shared import cut, hexed, whole

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Shingle hashes counted at once.
_STRIDE = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of the shingles' XXH64 (seed 42); zero without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle_words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle_words - 1 :].tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STRIDE):
        part = np.array(hashes[at : at + _STRIDE], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``_id, _sha, _fp`` for every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array((fingerprint(x.as_py(), shingle_words) for x in batch.column(2)), pa.int64(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["_id", "_sha", "_fp"])

    narrow = docs.select(F.col(id_col).alias("_id"), F.unhex(hexed(whole(text_col))).alias("_sha"), whole(text_col).alias("_text"))
    return narrow.mapInArrow(run, f"_id {narrow.schema['_id'].dataType.simpleString()}, _sha binary, _fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, bits) of as few segments as leave one with at most one differing bit."""
    n = max_bits // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def near_pairs(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b`` (a < b) for distinct fingerprints ``_fp`` that differ by at most ``max_bits`` bits, each pair once.

    Each row is a segment with one blank: 64 rows per fingerprint. A pair meets
    under several keys and is taken under the first one only, so no ``distinct``
    follows. Only pairs that hold leave the join.
    """
    parts = segments(max_bits)
    keys, firsts = [], "null"
    for n, (low, bits) in reversed(list(enumerate(parts))):
        mask = (1 << bits) - 1
        differ = f"(shiftright(a._fp ^ b._fp, {low}) & {mask}L)"
        firsts = f"""if(bit_count({differ}) <= 1, {n * 64}L + if({differ} = 0, 0, bit_count({differ} - 1)), {firsts})"""
        keys += [f"named_struct('_blank', {n * 64 + bit}L, '_rest', shiftright(_fp, {low}) & {mask & ~(1 << bit)}L)" for bit in range(bits)]
    # One long holds the blank's number and the rest of the segment.
    width = max(bits for _, bits in parts)
    if width + 8 > 63:
        raise ValueError("segments are too wide for max_bits below 2")
    index = prints.select("_fp", F.expr(f"explode(array({','.join(keys)}))").alias("_v")).select(
        "_fp", F.expr(f"shiftleft(_v._blank, {width}) | _v._rest").alias("_key"))
    meet = F.expr(f"a._key = b._key and a._fp < b._fp and bit_count(a._fp ^ b._fp) <= {max_bits} "
                  f"and shiftright(a._key, {width}) = {firsts}")
    # Spark knows the size of the fingerprints' file, not that 64 rows come of each: neither side may be broadcast.
    return index.hint("merge").alias("a").join(index.alias("b"), meet).select(F.col("a._fp").alias("a"), F.col("b._fp").alias("b"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Every row's fingerprint; and of every fingerprint the group's head: its row with the smallest id, null last."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    row = F.struct(F.col("_id").isNull().alias("_none"), F.col("_id"), F.col("_sha"))
    nodes = cut(prints.groupBy("_fp").agg(F.min(row).alias("_first")), "nodes")
    roots = components(near_pairs(nodes.select("_fp"), max_bits))
    placed = cut(nodes.join(roots, F.col("_fp") == F.col("node"), "left")
                 .select("_fp", "_first", F.coalesce("root", "_fp").alias("_root")), "placed")
    heads = cut(placed.groupBy("_root").agg(F.min("_first").alias("_head")), "heads")
    return prints, cut(placed.join(heads, "_root").select("_fp", "_head"), "head-of")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    Rows are linked if their fingerprints differ by at most ``max_bits`` bits;
    ``component_id`` is the smallest id reachable (null only where all ids are).
    Texts without words have fingerprint zero and are linked like any other.
    Rows with one fingerprint are one node, however many. An empty table gives
    no rows.
    """
    prints, head_of = _grouped(docs, id_col, text_col, shingle_words, max_bits)
    return prints.join(head_of, "_fp").select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_head._id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
                     max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each group, one row with its smallest id. Columns as they came."""
    _, head_of = _grouped(docs, id_col, text_col, shingle_words, max_bits)
    heads = head_of.select(F.col("_head._id").alias("_id"), F.col("_head._sha").alias("_sha")).distinct()
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"),
                         F.unhex(hexed(whole(text_col))).alias("_sha"))
    both = F.col("d._id").eqNullSafe(F.col("h._id")) & (F.col("d._sha") == F.col("h._sha"))
    return marked.alias("d").join(heads.alias("h"), both, "left_semi").dropDuplicates(["_id", "_sha"]).select("_row.*")
