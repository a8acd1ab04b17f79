import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from ironquill.llm import winnow as W

SEED = 42


def marks(text, gram=W.GRAM, window=W.WINDOW):
    """(hash, place) by definition: the smallest of each window, rightmost of equal ones."""
    text = text or ""
    at = [m.span() for m in re.finditer(r"\S{1,%d}" % W.TOKEN, text)]
    runs = [text[at[i][0] : at[i + gram - 1][1]] for i in range(len(at) - gram + 1)] or ([text] if text else [])
    signed = [xxhash.xxh64_intdigest(r.encode(), SEED) for r in runs]
    high = [((h if h < 1 << 63 else h - (1 << 64)) >> 32) for h in signed]
    out = []
    for a in range(max(1, len(high) - window + 1) if high else 0):
        part = range(a, min(a + window, len(high)))
        best = min(part, key=lambda i: (high[i], -i))
        if not out or out[-1] != (high[best], best):
            out.append((high[best], best))
    return sorted(set(out), key=lambda x: x[1])


TEXTS = ["", None, "a", "short", "x" * 11, "x" * 12, "ab" * 40, "the quick brown fox jumps over the lazy dog " * 3,
         "🙂é日本" * 30, "".join(chr(97 + (i * i) % 26) for i in range(500)), "line\nbreaks\r\nand\ttabs " * 9]


@pytest.mark.parametrize("window", [1, 2, 3, W.WINDOW, 9])
def test_marks_match_the_definition(spark, window):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = rows.select("doc_id", F.transform(W.winnowed(F.col("text"), window=window), lambda m: F.struct(W.mark_hash(m).alias("h"), W.mark_place(m).alias("p"))).alias("m"))
    for row in got.collect():
        assert [(x["h"], x["p"]) for x in row["m"]] == marks(TEXTS[row["doc_id"]], window=window), TEXTS[row["doc_id"]]


def test_shared_run_is_always_found():
    """GRAM + WINDOW - 1 shared tokens share a mark, whatever stands around them."""
    shared = " ".join(f"w{i * i % 97}" for i in range(W.GRAM + W.WINDOW - 1))
    for left, right in (("", ""), ("1 2 3 4 5 ", " Q" * 90), ("zz " * 77, "")):
        a, b = {h for h, _ in marks(left + shared)}, {h for h, _ in marks(shared + right)}
        assert a & b


def brute(rows):
    """rows: (doc_id, text) in order."""
    out = {}
    texts = [t or "" for _, t in rows]
    for i, (d, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(rows)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        sets = [{h for h, _ in marks(t)} for t in (text, edited, after)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), like(sets[0], sets[1]), like(sets[0], sets[2]))
    return out


@pytest.mark.parametrize("n", [1, 2, 11])
def test_edited_texts(spark, n):
    rows = [(i * 10, t) for i, t in enumerate(TEXTS[-n:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in W.edited_likeness(docs).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for d, (chars, sha, edited, after) in want.items():
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (chars, sha)
        assert got[d]["near_edited"] == pytest.approx(edited) and got[d]["near_next"] == pytest.approx(after)


def test_equal_texts_and_only_they_have_equal_fingerprints(spark):
    docs = spark.createDataFrame([(1, "same text " * 9), (2, "same text " * 9), (3, "same text " * 8 + "other"), (4, "")], "doc_id long, text string")
    prints = {r["doc_id"]: r["fingerprint"] for r in W.edited_likeness(docs).collect()}
    assert prints[1] == prints[2] and len(set(prints.values())) == 3


def test_null_and_repeated_ids_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "abc", 1), (None, None, 2), (5, "abcdef", 3), (5, "abcdef", 4), (9, "xyz", 5)], "doc_id long, text string, _marks int")
    assert W.edited_likeness(docs).count() == 5
    assert W.edited_likeness(docs.limit(0)).count() == 0
