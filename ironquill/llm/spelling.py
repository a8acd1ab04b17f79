"""Spelling variants: near words found through a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart have reduced words
that are equal or one edit apart, so the full one-edit neighbourhood of every
reduced word is generated and joined with the reduced vocabulary. What meets
is verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironquill.llm.shared import cut, whole

LEAST_LETTERS, LEAST_COUNT, TIMES, DROP_ONE_IN, SYMBOLS = 6, 5, 5, 199, 8
#: Distinct words that a task counts before it passes its counts on, and neighbours that it gives back at once.
_COUNTED, _ROWS = 400_000, 65_536
#: Longer words travel as their number, and are verified after the join: a row's size stays bounded.
_INLINE = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def runs(text: str, least: int = LEAST_LETTERS) -> list[str]:
    """Maximal runs of at least ``least`` letters, A-Z in lower case."""
    return re.findall(f"[a-zÀ-ÿ]{{{least},}}", text.encode().lower().decode())  # bytes.lower() knows A-Z only


def counted(doc: str, text: str, least: int = LEAST_LETTERS) -> Counter[str]:
    """Words of a document: its runs, one in ``DROP_ONE_IN`` without a letter that their hash picks."""
    found: Counter[str] = Counter()
    start = zlib.crc32(f"{doc}:".encode())
    for word, n in Counter(runs(text, least)).items():
        h = zlib.crc32(word.encode(), start)
        if h % DROP_ONE_IN == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < least:
                continue
        found[word] += n
    return found


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of every word with enough letters and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in counted(doc.as_py(), text.as_py(), least_letters).items():
                    counts[word] += n
                if len(counts) > _COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    narrow = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def reduced(word: str, symbols: int = SYMBOLS) -> np.ndarray:
    """A symbol from 1 on for each letter."""
    letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    return 1 + ((letters * _BASE) >> np.uint64(40)) % np.uint64(symbols)


def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.full(length, _BASE)) * np.uint64(length | 1)


def own_key(word: str, symbols: int = SYMBOLS) -> np.uint64:
    """Key of the reduced word, as in its neighbourhood."""
    return (reduced(word, symbols) * _powers(len(word))).sum(dtype=np.uint64)


def neighbourhood(word: str, symbols: int = SYMBOLS) -> tuple[np.uint64, np.ndarray, np.ndarray]:
    """Keys of the reduced word, of all words that replace one symbol of it, and of all that leave one out.

    Words with a symbol put in are met from the longer word's side. A key is a
    polynomial of the symbols, so that each costs a few operations however
    long the word is. Leaving out any of equal neighbours gives the same word.
    """
    s = reduced(word, symbols)
    powers = _powers(len(s))
    key = (s * powers).sum(dtype=np.uint64)
    change = (np.arange(1, symbols + 1, dtype=np.uint64)[None, :] - s[:, None])
    replaced = (key + change * powers[:, None])[change != 0]
    shorter = np.cumprod(np.full(len(s), _BASE)) * np.uint64((len(s) - 1) | 1)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s * shorter)[:-1]])
    moved = np.concatenate([np.zeros(1, np.uint64), (s[1:] * shorter[:-1])])
    after = moved.sum(dtype=np.uint64) - np.cumsum(moved)
    left_out = (before + after)[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else before[:0]
    return key, replaced, left_out


def _keys(symbols: int, every: bool):
    """Arrow function: rows of a key for each word; with ``every``, for its whole neighbourhood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, shorter, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                rows = pa.array(np.concatenate(owner))
                columns = [pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(rows), short.take(rows)]
                return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(shorter))] if every else columns,
                                                  ["_key", "_no", "_word", "_shorter"][: 4 if every else 3])

            short = pa.array([w if len(w) <= _INLINE else None for w in batch.column(1).to_pylist()], pa.string())
            for n, word in enumerate(batch.column(1).to_pylist()):
                key, replaced, left_out = neighbourhood(word, symbols) if every else (own_key(word, symbols), (), ())
                own = np.concatenate([[key], replaced, left_out]) if every else np.array([key])
                for at in range(0, len(own), _ROWS):
                    part = own[at : at + _ROWS]
                    keys.append(part)
                    owner.append(np.full(len(part), n))
                    shorter.append(np.arange(at, at + len(part)) > len(replaced))
                    held += len(part)
                    if held >= _ROWS:
                        yield out()
                        keys, owner, shorter, held = [], [], [], 0
            if held:
                yield out()

    return run


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``a, b``: numbers ``_no`` of the words (``_no, word``) that differ by one letter put in, left out or replaced, each pair once."""
    columns = "_key long, _no long, _word string"
    narrow = words.select("_no", "word")
    # Two replaced words meet from both sides, and one is taken.
    near = (F.col("a._shorter") | (F.col("a._no") < F.col("b._no"))) & F.expr(
        "a._word is null or b._word is null or levenshtein(a._word, b._word, 1) = 1")
    # Spark knows the size of the words' file, not how many keys come of each: neither side may be broadcast.
    met = (narrow.mapInArrow(_keys(symbols, True), columns + ", _shorter boolean").hint("merge").alias("a")
           .join(narrow.mapInArrow(_keys(symbols, False), columns).alias("b"), (F.col("a._key") == F.col("b._key")) & near))
    pairs = cut(met.select(F.least("a._no", "b._no").alias("a"), F.greatest("a._no", "b._no").alias("b"),
                           (F.col("a._word").isNull() | F.col("b._word").isNull()).alias("_open")).distinct(), "near")
    long = words.filter(F.length("word") >= _INLINE).select("_no", "word")
    open_pairs = (pairs.filter("_open").join(long.toDF("a", "_a"), "a").join(long.toDF("b", "_b"), "b")
                  .filter("levenshtein(_a, _b, 1) = 1").select("a", "b"))
    return pairs.filter("not _open").select("a", "b").unionByName(open_pairs)


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form (``word, form``); each round halves the paths."""
    current = cut(links.select("word", F.col("form").alias("root"), F.lit(False).alias("_done")), "roots")
    while not current.filter("not _done").isEmpty():
        further = current.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        current = cut(current.join(further, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNull().alias("_done")), "roots")
    return current.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS,
             least_count: int = LEAST_COUNT, times: int = TIMES, symbols: int = SYMBOLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus with enough letters and occurrences.

    A word's form is its near word of most occurrences (ties: the smallest in
    code-point order) if that has ``times`` the word's own; ``root`` follows
    the forms to the last. A null text has no words; a null id counts as an
    empty string where the hash is taken, and rows that share an id are
    counted each. An empty table gives no rows.
    """
    words = cut(vocabulary(docs, id_col, text_col, least_letters, least_count).withColumn("_no", F.monotonically_increasing_id()), "words")
    pairs = cut(near_words(words, symbols), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("_no").alias("b"), F.col("word").alias("_word"), F.col("n").alias("_n")), "b")
    best = near.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("n"), F.col("_word").alias("word"))).alias("_best"))
    placed = words.join(best, F.col("_no") == F.col("a"), "left")
    is_form = -F.col("_best.n") >= times * F.col("n")
    formed = cut(placed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("_best.word")).alias("form"),
                               F.when(is_form, -F.col("_best.n")).alias("form_n")), "forms")
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
