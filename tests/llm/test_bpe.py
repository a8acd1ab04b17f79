import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from ironquill.llm import bpe as B
from ironquill.llm.queries import vocabulary_path

PATH = vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary.load(PATH)


def test_characters_one_by_one(library, vocabulary):
    own = B.Encoder(vocabulary)
    for cp in [*range(0x300), *range(0x2010, 0x205F), 0x20AC, 0x130, 0x3A3, 0x1E9E, 0x212A, 0xFB01, 0x1F642]:
        for text in (chr(cp), f"a{chr(cp)}b1", chr(cp) * 2 + "'s"):
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids, text


def test_random_texts(library, vocabulary):
    rng, own = random.Random(1), B.Encoder(vocabulary)
    letters = "abcdeé'stre ÀßİΣσς日本🙂́ \n\t.,!12KKſ"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>x<|startoftext|>", "<|endoftext"])
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_lexicon_holds_its_words_and_no_others(vocabulary):
    words = sorted({f"{a}{b}{c}".encode() for a in ("re", "un", "") for b in ("do", "tie", "lé") for c in ("", "s", "ing", "ed")})
    entries = {w: vocabulary.merge(w) for w in words}
    lexicon = B.Lexicon(B.compile_lexicon(entries))
    assert all(lexicon.get(w) == ids for w, ids in entries.items())
    assert all(lexicon.get(w) is None for w in (b"", b"r", b"re", b"redoo", b"zz", b"redoings"))
    assert B.Lexicon(B.compile_lexicon({})).get(b"a") is None


def test_endings_are_shared(vocabulary):
    one = B.compile_lexicon({w: [1] for w in (b"aaing", b"aaed")})
    more = B.compile_lexicon({bytes([c]) + b"a" + e: [1] for c in range(97, 117) for e in (b"ing", b"ed")})
    states = lambda data: np.frombuffer(data[:8], "<u8")[0]
    assert states(more) == states(one)


def test_long_words(library, vocabulary):
    for text in ("a" * 30_000, "!" * 5_000, "ab" * 9_999):
        assert B.Encoder(vocabulary).encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("most", [0, 3, B.LEXICON_WORDS])
def test_table(spark, library, most):
    texts = ["The cat sat on the mat.", "the the the dog", None, "", "   ", "Ünïcode 日本語 🙂 text's", "<|endoftext|> the end <|startoftext|>", "x" * 3000, "the cat"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "the", "c"), (None, "the", "c")], "doc_id long, text string, _ids string").repartition(3)
    got = B.encoded(docs, PATH, most=most).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "the" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r["_ids"]) == ids and r["_decoded"] == library.decode(ids, skip_special_tokens=False)
        assert hashlib.sha256(r["_ids_le"]).digest() == hashlib.sha256(np.array(ids, "<u4").tobytes()).digest()
    assert B.encoded(docs.limit(0), PATH).count() == 0
