import random

import pytest

from ironquill.llm import license_scan as L
from ironquill.llm.license_texts import TEMPLATES


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def found(spark, texts, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    out = {}
    for r in L.licenses(docs, **kw).collect():
        out.setdefault(r["_id"], []).append(r)
    return out


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_templates_are_found_whole_and_in_place(spark, name):
    text = f"🙂 İ some words before.\n{TEMPLATES[name]}\nand after them"
    hit = next(r for r in found(spark, [text])[0] if r["license"] == name)
    assert hit["coverage"] == 1.0 and L.words(text[hit["start"] : hit["end"]]) == L.words(TEMPLATES[name])


def test_edited_templates_reach_what_a_full_alignment_reaches(spark):
    rng, texts, names = random.Random(4), [], []
    for name in ("mit", "isc", "bsd-2", "apache-2-notice", "gpl-3-notice"):
        for share in (0.0, 0.03, 0.06, 0.1):
            ws = TEMPLATES[name].split()
            for _ in range(int(share * len(ws))):
                at = rng.randrange(len(ws))
                ws[at : at + rng.randint(0, 1)] = [f"new{rng.randrange(99)}"] * rng.randint(0, 2)
            texts.append("start of it " + " ".join(ws) + " end of it")
            names.append(name)
    got = found(spark, texts)
    for n, (text, name) in enumerate(zip(texts, names, strict=True)):
        want = lcs(L.words(TEMPLATES[name]), L.words(text))
        best = max((r["matched_words"] for r in got.get(n, []) if r["license"] == name), default=0)
        assert best == want if want >= L.COVERAGE * len(L.words(TEMPLATES[name])) else True


def test_all_places_and_nothing_else(spark):
    line = TEMPLATES["mit-line"]
    got = found(spark, [f"{line} filler words {line}\n" * 3, "the license of the word", "", None, "under the " * 500])
    assert [r["license"] for r in got[0]] == ["mit-line"] * 6 and set(got) == {0}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, TEMPLATES["reserved"], 1), (None, TEMPLATES["reserved"], 2)], "doc_id long, text string, license int")
    assert L.licenses(docs).count() == 2 and L.licenses(docs.limit(0)).count() == 0
