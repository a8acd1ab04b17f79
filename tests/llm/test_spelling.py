import random
import re
import zlib
from collections import Counter

import pytest

from ironquill.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n int, _no long"


def words_of(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words = words_of(rows)
    close = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n, len(close[w]), words[form[w]] if w in form else None) for w, n in words.items())


def made(spark, rows, **how):
    table = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in S.variants(table, **how).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("symbols", [1, 4, 8])
def test_against_all_pairs(spark, symbols):
    rng = random.Random(symbols)
    base = ["".join(rng.choice("abcdeéÉ") for _ in range(rng.randint(6, 8))) for _ in range(25)]

    def edited(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abcÿ") + w[i:], w[:i] + rng.choice("abÀ") + w[i + 1 :]])

    rows = [(d, " ".join(edited(rng.choice(base[: 1 + d % 25])) for _ in range(120)).upper() if d % 3 else "") for d in range(60)]
    rows += [(None, "Strasse1Strasse,strasse strasse-strasse " * 2), (None, "strasse " * 60), (7, None), (7, "strase " * 6), (7, "")]
    want = plain(rows)
    assert any(r[1] for r in want)
    assert made(spark, rows, symbols=symbols) == want


def test_chains_end_at_the_last_form(spark):
    rows = [(1000, " ".join(["aaaaaa"] * 5 + ["aaaaab"] * 25 + ["aaaabb"] * 125 + ["aaabbb"] * 625))]
    assert [r[2] for r in made(spark, rows)] == ["aaabbb"] * 4 and made(spark, rows) == plain(rows)


def test_long_words(spark):
    long = "".join(random.Random(1).choice("abc") for _ in range(30_000))
    rows = [(i, f"{long} {long}x {long[:64]} {long[:63]} {long[:65]} {long[:65]}") for i in range(40)]
    assert made(spark, rows) == plain(rows)


def test_no_words(spark):
    assert made(spark, []) == [] and made(spark, [(1, None), (2, ""), (3, "a bc ÷×÷")]) == []


def test_neighbourhood_meets_every_edit():
    rng = random.Random(5)
    for _ in range(300):
        w = "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9)))
        key, replaced, shorter = S.neighbourhood(w, 3)
        for i in range(len(w)):
            assert S.neighbourhood(w[:i] + "q" + w[i + 1 :], 3)[0] in {key, *replaced}
            if len(w) > 1:
                assert S.neighbourhood(w[:i] + w[i + 1 :], 3)[0] in set(shorter)
