import random
import re

import pytest

from ironquill.llm import decontaminate as D

DOCS = "doc_id long, text string, _text string, item_id int"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items, size=10):
    doc, hit, owners = words(text), set(), set()
    for one, item in items:
        w = words(item)
        k = min(size, len(w))
        for i in range(len(w) - k + 1) if w else ():
            for j in range(len(doc) - k + 1):
                if doc[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    owners.add("" if one is None else str(one))
    return len(doc), len(hit), sorted(owners)


def compare(spark, docs, items, **how):
    table = spark.createDataFrame([(*d, "t", 1) for d in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, _id int")
    got = sorted((str(r["_id"]), r["_n_words"], r["_n_hit"], list(r["_items"])) for r in D.contamination(table, bench, **how).collect())
    assert got == sorted((str(d), *plain(t, items, how.get("size", 10))) for d, t in docs)


@pytest.mark.parametrize("index_bytes", [D.INDEX_BYTES, 300])
def test_against_every_place(spark, index_bytes):
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["ab", "abc", "Éa", "é", "7", "x", "the", "longer", "日本"]) for _ in range(n))
    items = [(i, some(rng.choice([0, 1, 2, 5, 9, 10, 11, 25]))) for i in range(40)] + [(3, some(12)), (None, some(11)), (None, None), (8, "the, THE;the " * 6)]
    items = [i for i in items if len(words(i[1])) != 1] + [(99, "zzz")]  # one-word items would hit all
    docs = [(d, some(rng.randint(0, 60))) for d in range(120)]
    docs += [(200 + n, some(4) + " -- " + (t or "").upper() + "!" + some(3)) for n, (_, t) in enumerate(items)]
    docs += [(None, "ab zzz"), (None, "ab zzz"), (5, None), (6, ""), (7, "\x00\x7f the the the"), (7, "the " * 300)]
    compare(spark, docs, items, index_bytes=index_bytes)


def test_small_windows_and_empty_tables(spark):
    docs = [(1, "a b a b a c"), (2, "b"), (3, None)]
    compare(spark, docs, [(1, "a b a"), (2, "c"), (3, "b a b")], size=2)
    compare(spark, docs, [])
    compare(spark, docs, [(1, ""), (2, None)])
    compare(spark, [], [(1, "a")])


def test_long_texts(spark):
    rng = random.Random(4)
    item = " ".join(str(rng.randint(0, 99)) for _ in range(200))
    filler = " ".join(str(rng.randint(0, 9999)) for _ in range(200_000))
    docs = [(1, filler + " " + item + " " + filler), (2, "a" * 3_000_000), (3, item)]
    table = spark.createDataFrame([(*d, "t", 1) for d in docs], DOCS)
    bench = spark.createDataFrame([(1, item), (2, "a " * 9 + "a")], "item_id long, text string")
    got = {r["_id"]: (r["_n_words"], r["_n_hit"], r["_items"]) for r in D.contamination(table, bench).collect()}
    assert got[1][0] == 400_200 and got[1][1] >= 200 and got[1][2] == ["1"] and got[2] == (1, 0, []) and got[3] == (200, 200, ["1"])


def test_every_length_of_shortest_string():
    rng = random.Random(9)
    for least in range(1, 12):
        strings = {" " + "".join(rng.choice("ab") for _ in range(rng.randint(least, least + 3))) + " " for _ in range(20)}
        index = D.Index.of_items([(s.strip(), s) for s in strings])
        again = D.Index.load(index.dump())
        text = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 14))) for _ in range(3000))
        for i in (index, again):
            [(n, hit, owned)] = D.scan([text], [i])
            assert (n, hit) == (3000, sum(f" {w} " in strings for w in text.split())) and owned == {w for w in text.split() if f" {w} " in strings}
