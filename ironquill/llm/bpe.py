"""BPE encoding by a transducer of frequent words, and exact merging of the others.

The words that a corpus uses most are compiled, with their token ids, into a
minimal acyclic automaton: words share their beginnings and their endings.
Each arc adds a number, and the sum along a word's path is its place in one
table of ids. The automaton is one file in the shared folder, which tasks map
into memory. A word that is not in it is merged by the rules of the vocabulary.
"""

from __future__ import annotations

import heapq
import itertools
import json
import mmap
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ironquill.llm.shared import cut, shared_folder, whole

#: At most so many words are compiled; which ones changes the speed only, never a result.
LEXICON_WORDS = 131_072
#: Words that a task remembers.
_REMEMBERED = 300_000
#: Distinct words that a task counts before it passes its counts on, and rows that it gives back at once.
_COUNTED, _ROWS = 200_000, 256
_HEAD = "<5Q"


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = itertools.count(256)
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@dataclass
class Vocabulary:
    """A word-end BPE vocabulary with a lower-casing normaliser, as its JSON file describes it."""

    tokens: list[str]
    ids: dict[str, int]
    merges: dict[int, int]
    special: dict[str, int]
    suffix: str
    pattern: regex.Pattern
    path: str
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        model, ids = config["model"], dict(config["model"]["vocab"])
        suffix = model["end_of_word_suffix"]
        steps = config["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in config["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not suffix or config["decoder"] or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError("another kind of tokenizer")
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]
        special = {x["content"]: x["id"] for x in config["added_tokens"]}
        tokens = [""] * (1 + max(max(ids.values()), *special.values()))
        for t, i in (ids | special).items():
            tokens[i] = t
        letters = byte_letters()
        return cls(tokens, ids, merges, special, suffix, regex.compile(steps[0]["pattern"]["Regex"]), path,
                   [ids[c] for c in letters], [ids[c + suffix] for c in letters])

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair with the lowest rank is merged, leftmost first, while there is one."""
        ids = [self.first[b] for b in word[:-1]] + [self.last[word[-1]]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, heap = self.merges, []
        for i in range(n - 1):
            if (found := merges.get(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append((found, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            found, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            made = found & 0xFFFFFFFF
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (found := merges.get(made << 32 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (found, i, made, ids[after[i]]))
            h = before[i]
            if h >= 0 and (found := merges.get(ids[h] << 32 | made)) is not None:
                heapq.heappush(heap, (found, h, ids[h], made))
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: such a vocabulary names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


class Splitter:
    """Cuts a text into the words that are encoded alone, and special tokens."""

    #: Here lower-casing and letter classes are the same in every Unicode version, and nothing composes.
    _PLAIN = "\x00-˿‐-‧‰-⁞€"

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")")
        self.whole = None
        self.bytes = {c: b for b, c in enumerate(byte_letters())}
        self.plain = re.compile(f"[{self._PLAIN}]*").fullmatch
        self.find = re.compile(self._plain_pattern(vocabulary.pattern.pattern)).findall

    def _plain_pattern(self, pattern: str) -> str:
        """The vocabulary's pattern for plain texts, its classes spelt out for the faster of two libraries."""
        letters = sorted({x for c in range(0x20AD) if self.plain(chr(c)) for x in chr(c).lower()})
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            own = "".join(rf"\u{ord(c):04x}" for c in letters if regex.match(name, c))
            pattern = pattern.replace(f"[{name}]", f"[{own}]").replace(name, own)
        return pattern

    def words(self, text: str) -> list[str]:
        """Words and special tokens; no word looks like one of these."""
        if "<|" not in text:
            return self._cut(text)
        parts = self.special.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._cut(part))]

    def _cut(self, text: str) -> list[str]:
        if text.isascii() or self.plain(text):
            return self.find(text.lower())
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.vocabulary.path)
        parts = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in parts]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The automaton of the words, each with its ids, as one file's contents.

    Words come in sorted order, so that a state is complete once the next word
    leaves it, and is then replaced by an equal one if there is one.
    """
    words = sorted(entries)
    known: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # final, arcs
    path: list[list] = [[False, []]]

    def freeze(down_to: int, word: bytes) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in known:
                known[key] = len(states)
                states.append((final, arcs))
            path[-1][1].append((word[depth - 1], known[key]))

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        freeze(common, last)
        path.extend([False, []] for _ in word[common:])
        path[-1][0], last = True, word
    freeze(0, last)
    root = len(states)
    states.append((path[0][0], path[0][1]))
    below = [0] * len(states)
    first, labels, targets, adds = [0], bytearray(), [], []
    for n, (final, arcs) in enumerate(states):  # targets come before their sources
        total = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            adds.append(total)
            total += below[target]
        below[n] = total
        first.append(len(labels))
    offsets = np.cumsum([0] + [len(entries[w]) for w in words])
    flat = np.fromiter(itertools.chain.from_iterable(entries[w] for w in words), "<u4")
    finals = bytes(s[0] for s in states)
    pad = lambda b: bytes(b) + b"\0" * (-len(b) % 8)
    return (struct.pack(_HEAD, len(states), len(labels), len(words), len(flat), root) + pad(labels) + pad(finals)
            + np.array(first, "<u8").tobytes() + np.array(targets, "<u8").tobytes() + np.array(adds, "<u8").tobytes()
            + offsets.astype("<u8").tobytes() + flat.tobytes())


class Lexicon:
    """A compiled lexicon, mapped into memory or given as bytes."""

    def __init__(self, data: mmap.mmap | bytes):
        states, arcs, words, ids, self.root = struct.unpack_from(_HEAD, data)
        at, view = struct.calcsize(_HEAD), memoryview(data)
        self.data, self.labels = data, at
        at += arcs + -arcs % 8
        self.finals = at
        at += states + -states % 8

        def numbers(count: int, width: int, code: str) -> memoryview:
            nonlocal at
            part = view[at : at + count * width].cast(code)
            at += count * width
            return part

        self.first, self.targets, self.adds = numbers(states + 1, 8, "Q"), numbers(arcs, 8, "Q"), numbers(arcs, 8, "Q")
        self.offsets, self.ids = numbers(words + 1, 8, "Q"), numbers(ids, 4, "I")

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes) -> list[int] | None:
        state, place, base, find = self.root, 0, self.labels, self.data.find
        for b in word:
            arc = find(b.to_bytes(), base + self.first[state], base + self.first[state + 1]) - base
            if arc < 0:
                return None
            place += self.adds[arc]
            state = self.targets[arc]
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist() if self.data[self.finals + state] else None


class Encoder(dict):
    """Ids by word as little-endian 32-bit numbers, remembered: from the lexicon, or merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        super().__init__()
        self.vocabulary, self.lexicon, self.splitter = vocabulary, lexicon, Splitter(vocabulary)

    def __missing__(self, word: str) -> bytes:
        if word in self.vocabulary.special:
            ids = [self.vocabulary.special[word]]
        else:
            raw = word.encode()
            ids = self.lexicon.get(raw) if self.lexicon else None
            if ids is None:
                ids = self.vocabulary.merge(raw)
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = packed = struct.pack(f"<{len(ids)}I", *ids)
        return packed

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.splitter.words(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


def frequent_words(docs: DataFrame, vocabulary_path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """Up to ``most`` words, the most frequent of all documents; of equally frequent ones all or none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, counts = Splitter(Vocabulary.load(vocabulary_path)), Counter()

        def out() -> pa.RecordBatch:
            for word in splitter.vocabulary.special:
                counts.pop(word, None)
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(splitter.words(text.as_py() or ""))
                if len(counts) > _COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    words = cut(docs.select(whole(text_col).alias("_text")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    # Eighths of powers of two: at most some 500 rows.
    steps = words.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for row in steps:
        total += row["k"]
        if total > most:
            break
        least = row["n"]
    return [] if least is None else [r["w"].encode() for r in words.filter(F.col("n") >= least).select("w").collect()]


def ship_lexicon(spark: SparkSession, data: bytes) -> str:
    """Write the file to the shared folder and have executors fetch it; its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    store = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = store.create(path)
    out.write(bytearray(data))
    out.close()
    store.deleteOnExit(path)
    context.addFile(path.toString())
    return name


def encoded(docs: DataFrame, vocabulary_path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
            most: int = LEXICON_WORDS, lists: bool = True) -> DataFrame:
    """Of each row the columns ``carry``, its ids (without ``lists`` null), the same as little-endian 32-bit numbers, and the decoded text.

    Ids are those of the vocabulary's own tokenizer without added special
    tokens; strings of special tokens in a text become such tokens. A null
    text is empty and has none.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(vocabulary_path)
    entries = {w: vocabulary.merge(w) for w in frequent_words(docs, vocabulary_path, text_col, most)}
    name = ship_lexicon(spark, compile_lexicon(entries))
    source = docs.select(*carry, whole(text_col).alias("_text"))
    added = [T.StructField("_ids", T.ArrayType(T.IntegerType())), T.StructField("_ids_le", T.BinaryType()), T.StructField("_decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.load(vocabulary_path), Lexicon.open(SparkFiles.get(name)))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                packed = [encoder.packed(x.as_py()) for x in part.column(len(carry))]
                ids = pa.nulls(part.num_rows, pa.list_(pa.int32()))
                if lists:
                    ends = np.cumsum([0] + [len(x) // 4 for x in packed])
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                decoded = pa.array([encoder.vocabulary.decode(np.frombuffer(x, "<u4").tolist()) for x in packed], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], ids, pa.array(packed, pa.binary()), decoded], [*carry, "_ids", "_ids_le", "_decoded"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[: len(carry)], *added]))


def normal_form(text: str) -> str:
    """What a round trip keeps of a text: its words in lower case without white space."""
    return regex.sub(r"\s+", "", unicodedata.normalize("NFC", text).lower())
