import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ironquill.llm import mixing as M


def count(seed, doc_id, rate):
    u = (int(hashlib.md5(f"{seed}:{doc_id}:".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
    below, term, k = math.exp(-rate), math.exp(-rate), 0
    while below < u:
        k += 1
        term *= rate / k
        below += term
    return k


@pytest.mark.parametrize("weights", [{"a": 0.5, "b": 0.3}, {"a": 0.0, "c": 1.0}, {}])
def test_counts_are_poisson_inversions(spark, weights):
    rows = [(i, "a" if i % 3 == 0 else "b" if i % 3 == 1 else f"c{i % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(4)
    got = {}
    for r in M.replicate(docs, weights).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("_copy").alias("d")).collect():
        assert r["n"] == r["d"]
        got[r["doc_id"]] = r["n"]
    sizes = {}
    for _, s in rows:
        sizes[s if s in weights else None] = sizes.get(s if s in weights else None, 0) + 1
    for d, s in rows:
        key = s if s in weights else None
        rate = (weights[key] if key else max(0.0, 1 - sum(weights.values()))) * 600 / sizes[key]
        assert got.get(d, 0) == count(M.SEED, d, rate)


@pytest.mark.parametrize("mean", [0.0, 1e-6, 0.3, 1.0, 17.5, 900.0])
def test_steps_are_the_distribution_function(spark, mean):
    steps = spark.range(1).select(M.poisson_steps(F.lit(mean)).alias("s")).first()["s"]
    assert steps[-1] == pytest.approx(1, abs=1e-9) and steps == sorted(steps)
    want = [math.exp(-mean)] if mean else [1.0]
    for k in range(1, min(len(steps), 40)):
        want.append(want[-1] + math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) if mean else 1.0)
    assert steps[: len(want)] == pytest.approx(want, abs=1e-12)


def test_shares_meet_the_weights(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    weights = {"hot": 0.1, "s1": 0.4}
    shares = {r["k"]: r["n"] / 30_000 for r in M.replicate(docs, weights).groupBy(
        F.when(F.col("source").isin(*weights), F.col("source")).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert shares["hot"] == pytest.approx(0.1, abs=0.01) and shares["s1"] == pytest.approx(0.4, abs=0.03) and shares[None] == pytest.approx(0.5, abs=0.02)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "a", "x"), (None, None, None), (2, "a", ""), (2, "a", "")], "doc_id long, source string, _row string")
    out = M.replicate(docs, {"a": 0.9}, total=500.0)
    assert out.columns[:3] == docs.columns and out.filter("source is null").count() > 0
    assert M.replicate(docs.limit(0), {"a": 0.9}).count() == 0
    with pytest.raises(ValueError):
        M.rates(docs, {"a": -1.0})


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "a", "old", 7.0, i) for i in range(40)], "doc_id long, source string, _copy string, _rate double, _u long")
    got = M.replicate(docs, {"a": 1.0})
    assert got.columns == ["doc_id", "source", "_u", "_copy", "_copies", "_rate", "_place"]
    assert {r["_rate"] for r in got.collect()} == {1.0} and all(r["_u"] == r["doc_id"] for r in got.collect())
