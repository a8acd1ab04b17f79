"""Benchmark passages in documents, by Wu-Manber search for many strings at once.

Texts become their words in lower case, each with a space on both sides, so
that a window of words is a plain string. Windows are searched by classes of
length. Within a class only the first ``m`` bytes of each window count at
first, ``m`` being the shortest length: a table of blocks of up to eight bytes
says how far the search may move on when it meets a block at the end of the
``m`` bytes. Where it may not move, the windows with that last block and the
same first block are compared directly.

A batch of documents is cut into stretches that move on side by side, so that
each step is a few array operations.
"""

from __future__ import annotations

import json
import mmap
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironquill.llm.shared import cut, shared_folder, whole

WINDOW_WORDS = 10
#: Bytes of item text whose windows are compiled into one index; more items make more of them.
INDEX_BYTES = 4 << 20
#: Bytes of documents searched at once, and bytes of a stretch.
_BATCH, _STRETCH = 4 << 20, 2048
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to a-z; bytes that no word has to the space; every other byte is a word's.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def joined(found: list[bytes]) -> bytes:
    """Words with a space before, between and after; no words: two spaces."""
    return b" " + b" ".join(found) + b" "


def windows(text: bytes, size: int = WINDOW_WORDS) -> dict[bytes, int]:
    """Of joined words every run of ``size`` words, or all if there are fewer, with its first place."""
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
    runs = max(1, len(spaces) - size)
    return {text[spaces[i] : spaces[min(i + size, len(spaces) - 1)] + 1]: spaces[i] for i in reversed(range(runs))}


def _blocks(data: np.ndarray, width: int) -> np.ndarray:
    """At every place the ``width`` bytes from there on, as a number; the data end with eight bytes to spare."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    return view if width == 8 else view & np.uint64((1 << 8 * width) - 1)


def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (last * _MIX) ^ first


class Strings:
    """Wu-Manber tables of one class of strings, each a part of ``text``."""

    def __init__(self, text: np.ndarray, shift: np.ndarray, keys: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray):
        self.text, self.shift, self.keys, self.start, self.length, self.owner = text, shift, keys, start, length, owner
        self.m = int(length.min())
        self.width = min(8, self.m)
        self.drop = np.uint64(65 - len(shift).bit_length())

    @classmethod
    def compiled(cls, text: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray) -> Strings:
        m = int(length.min())
        width, bits = min(8, m), max(12, (8 * len(text)).bit_length())
        block, tail = _blocks(text, width), m - width
        shift = np.full(1 << bits, min(tail + 1, 255), np.uint8)
        for at in range(tail + 1):
            np.minimum.at(shift, (block[start + at] * _MIX) >> np.uint64(64 - bits), min(tail - at, 255))
        keys = _key(block[start + tail], block[start])  # a bucket: strings with one last and one first block
        order = np.argsort(keys, kind="stable")
        return cls(text, shift, keys[order], start[order], length[order], owner[order])

    def find(self, data: bytes, end: int) -> Iterator[tuple[int, int, int]]:
        """First place, length and owner of every occurrence; ``data`` has eight bytes to spare behind ``end``."""
        block = _blocks(np.frombuffer(data, np.uint8), self.width)
        tail, limit = self.m - self.width, end - self.m + 1
        place = np.arange(0, max(limit, 0), _STRETCH, dtype=np.int64)
        stop = np.minimum(place + _STRETCH, limit)
        while place.size:
            move = self.shift[(block[place + tail] * _MIX) >> self.drop]
            here = place[move == 0]
            if here.size:
                yield from self._verified(data, here, _key(block[here + tail], block[here]))
            place = place + np.maximum(move, 1)
            on = place < stop
            if not on.all():
                place, stop = place[on], stop[on]

    def _verified(self, data: bytes, here: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        met = low < high
        for at, a, b in zip(here[met].tolist(), low[met].tolist(), high[met].tolist(), strict=True):
            for start, length, owner in zip(self.start[a:b].tolist(), self.length[a:b].tolist(), self.owner[a:b].tolist(), strict=True):
                if data[at : at + length] == self.text[start : start + length].tobytes():
                    yield at, length, owner


class Index:
    """Windows of items, in classes of length, so that short ones do not slow the search for long ones."""

    _PARTS = ("shift", "keys", "start", "length", "owner")

    def __init__(self, ids: list[list[str]], classes: list[Strings]):
        self.ids, self.classes = ids, classes

    @classmethod
    def of_items(cls, items: Iterable[tuple[str, str | None]], size: int = WINDOW_WORDS) -> Index:
        """Items with the same words are searched once."""
        ids: dict[bytes, list[str]] = {}
        for one, text in items:
            if found := words(text):
                ids.setdefault(joined(found), []).append(one)
        text = np.frombuffer(b"".join(ids) + b"\0" * 8, np.uint8)
        rows, base = [], 0
        for n, item in enumerate(ids):
            rows += [(base + start, len(w), n) for w, start in windows(item, size).items()]
            base += len(item)
        table = np.array(rows, np.int64).reshape(-1, 3)
        kind = np.array([min(x.bit_length(), 6) for x in table[:, 1].tolist()], np.int64)
        return cls(list(ids.values()), [Strings.compiled(text, *table[kind == k].T) for k in np.unique(kind)])

    def find(self, data: bytes, end: int) -> Iterator[tuple[int, int, int]]:
        for strings in self.classes:
            yield from strings.find(data, end)

    def dump(self) -> bytes:
        """A head line that names the tables, then the tables, to be mapped into memory."""
        text = self.classes[0].text if self.classes else np.zeros(8, np.uint8)
        tables = [text] + [np.ascontiguousarray(getattr(c, p)) for c in self.classes for p in self._PARTS]
        head = json.dumps({"ids": self.ids, "tables": [(t.dtype.str, len(t)) for t in tables]}).encode() + b"\n"
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        return b"".join([len(head).to_bytes(8, "little"), pad(head), *(pad(t.tobytes()) for t in tables)])

    @classmethod
    def load(cls, data: bytes | mmap.mmap) -> Index:
        n = int.from_bytes(data[:8], "little")
        head, at, tables = json.loads(data[8 : 8 + n]), 8 + n + -n % 8, []
        for kind, length in head["tables"]:
            tables.append(np.frombuffer(data, kind, length, at))
            at += tables[-1].nbytes + -tables[-1].nbytes % 8
        k = len(cls._PARTS)
        return cls(head["ids"], [Strings(tables[0], *tables[i : i + k]) for i in range(1, len(tables), k)])

    @classmethod
    def open(cls, path: str) -> Index:
        with open(path, "rb") as f:
            return cls.load(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def scan(texts: list[str | None], indexes: Iterable[Index]) -> Iterator[tuple[int, int, set[str]]]:
    """Of each text: words, words inside any window, items with windows there."""
    parts = [words(t) for t in texts]
    each = [joined(p) for p in parts]
    ends = np.cumsum([len(e) for e in each])
    data = b"".join([*each, b"\0" * 8])
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for index in indexes:
        for at, length, owner in index.find(data, len(data) - 8):
            spans, owned = found.setdefault(int(np.searchsorted(ends, at, "right")), ([], set()))
            spans.append((at, at + length - 1))
            owned.update(index.ids[owner])
    for doc, (part, text) in enumerate(zip(parts, each, strict=True)):
        if doc not in found:
            yield len(part), 0, set()
            continue
        spans, owned = found[doc]
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + (ends[doc] - len(text))
        first, last = (np.searchsorted(spaces, x) for x in zip(*spans, strict=True))
        edges = np.zeros(len(part) + 1, np.int64)
        np.add.at(edges, first, 1)
        np.add.at(edges, last, -1)
        yield len(part), int((np.cumsum(edges) > 0).sum()), owned


def _parcels(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of text bytes (or one row)."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            below = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, below + _BATCH, "right")))
            yield batch.slice(at, to - at)
            at = to


def ship_items(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS, index_bytes: int = INDEX_BYTES) -> list[str]:
    """Write indexes of the items to the shared folder and have executors fetch them; their names there.

    Rows are dealt by id into as many indexes as their bytes ask for, and the
    driver holds the rows of one at a time.
    """
    spark, context = items.sparkSession, items.sparkSession.sparkContext
    narrow = cut(items.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("id"), whole(F.col(f"`{text_col}`")).alias("text")).distinct(), "items")
    total = narrow.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count, names = -(-total // index_bytes), []
    for n in range(count):
        rows = narrow.filter(F.pmod(F.xxhash64("id"), F.lit(count)) == n).collect()
        names.append(f"windows-{uuid.uuid4().hex}.bin")
        path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{names[-1]}")
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        out = store.create(path)
        out.write(bytearray(Index.of_items(((r["id"], r["text"]) for r in rows), size).dump()))
        out.close()
        store.deleteOnExit(path)
        context.addFile(path.toString())
    return names


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", size: int = WINDOW_WORDS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``_id, _n_words, _n_hit, _items`` (ids as strings, sorted) for every row of ``docs``.

    A window is ``size`` consecutive words of an item, or a shorter item
    whole; a document's words inside any occurrence are hit. Null texts have no
    words, items without words no windows. Rows with one item id are one item,
    null ids together (as an empty string). Tables may be empty; repeated rows
    and ids of documents are rows like any other.

    The documents are read once and not shuffled. Every task searches its rows
    with each index in turn; indexes are mapped into memory, so that tasks of
    one machine share them.
    """
    names = ship_items(items, item_col, item_text, size, index_bytes)
    narrow = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"))
    out = T.StructType([narrow.schema["_id"], T.StructField("_n_words", T.LongType()), T.StructField("_n_hit", T.LongType()),
                        T.StructField("_items", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [Index.open(SparkFiles.get(n)) for n in names]
        for part in _parcels(batches, 1):
            n_words, n_hit, owned = zip(*scan(part.column(1).to_pylist(), indexes), strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array([sorted(x) for x in owned], pa.list_(pa.string()))], ["_id", "_n_words", "_n_hit", "_items"])

    return narrow.mapInArrow(run, out)
