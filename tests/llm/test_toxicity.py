import math
import random
import zlib
from collections import Counter

import pytest

from ironquill.llm import toxicity as X
from ironquill.llm.queries import QUERIES


def learnable(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    stems = ["lor", "ame", "tin", "sol", "ber", "gat", "nev", "rum"]
    rows, labels = [], []
    for i in range(900):
        words = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        toxic = int(i % 6 == 0)
        for _ in range(toxic * max(2, len(words) // 40)):
            words[rng.randrange(len(words))] = "zawk" + rng.choice(["", "s", "ing"])
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    model = X.fit(docs, labels)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = {r["doc_id"]: r["_score"] for r in X.scored(docs, model).collect() if not learnable(r["doc_id"])}
    toxic = [found[d] >= X.THRESHOLD for d in found if truth[d]]
    clean = [found[d] >= X.THRESHOLD for d in found if not truth[d]]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.03


def test_labels_that_are_held_out_change_nothing(spark, tables):
    docs, labels = tables
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    few = docs.filter("doc_id < 150")
    a, b = (sorted((r["doc_id"], round(r["_score"], 9)) for r in X.scored(few, X.fit(few, y)).collect()) for y in (labels, turned))
    assert a == b


@pytest.mark.parametrize("others", [(), ("abbab cabs", "xab", None, "")])
def test_gains_match_kneser_ney_by_hand(spark, others):
    rows = [(1, "abab abc", 1, 1), (2, "abc bca cab abc", 0, 1), (3, "bb ab", 0, 1), (4, "cc abb", 1, 1)]
    sample = spark.createDataFrame(rows, "_id long, _text string, _toxic int, _fold int")
    corpus = spark.createDataFrame([(t,) for t in others], "text string")
    grams, contexts = X.kneser_ney(X.letter_counts(sample), X.letter_types(corpus) if others else None)
    counts = {0: Counter(), 1: Counter()}
    for _, text, y, _ in rows:
        for w in text.split():
            s = X._START + w + X._END
            for e in range(2, len(s) + 1):
                counts[y][s[max(0, e - X.ORDER) : e]] += 1
    top = set(counts[0]) | set(counts[1])
    known = set(top)
    for t in others:
        for w in (t or "").split():
            s = X._START + w + X._END
            known |= {s[max(0, e - X.ORDER) : e] for e in range(2, len(s) + 1)}
    levels = {X.ORDER: {g for g in known if len(g) == X.ORDER}}
    continued = {}
    for k in range(X.ORDER, 1, -1):
        continued[k - 1] = Counter(g[1:] for g in levels[k])
        levels[k - 1] = set(continued[k - 1]) | {g for g in known if len(g) == k - 1}
    d = X.DISCOUNT

    def shared(g):
        if len(g) == 1:
            return continued[1][g] / sum(continued[1].values())
        same = {x: c for x, c in continued[len(g)].items() if x[:-1] == g[:-1]}
        n = sum(same.values())
        return (max(same.get(g, 0) - d, 0) + d * len(same) * shared(g[1:])) / n

    def likelihood(g, y):
        same = {x: c for x, c in counts[y].items() if x[:-1] == g[:-1]}
        n = sum(same.values())
        return (max(same.get(g, 0) - d, 0) + d * len(same) * shared(g[1:])) / n if n else shared(g[1:])

    got = {r["g"]: r["gain"] for r in grams.collect()}
    assert got.keys() == top
    for g in top:
        assert got[g] == pytest.approx(math.log(likelihood(g, 1)) - math.log(likelihood(g, 0)), abs=1e-9)


def test_odd_rows(spark, tables):
    docs, labels = tables
    model = X.fit(docs.limit(100), labels.limit(0))
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "!!! 123", 3.0), (2, "word " * 5000, 4.0)], "doc_id long, text string, _other double")
    out = X.scored(odd, model).collect()
    assert len(out) == 4 and all(0 <= r["_score"] < X.THRESHOLD for r in out)
    assert X.scored(odd.limit(0), model).count() == 0
    conflicting = labels.union(labels.selectExpr("doc_id", "1 - toxic")).union(labels.selectExpr("cast(null as long)", "1"))
    X.fit(docs.limit(60), conflicting)


def test_query(spark):
    rows = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (not learnable(r["doc_id"])) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
