import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ironquill.llm import exact_dedup as E

ROWS = [(1, "abc"), (2, "abc"), (3, ""), (4, None), (5, "a" * 50), (6, "a" * 50), (7, "a" * 49), (8, "abcdabcd"), (9, "abcdabce"), (10, "é🙂" * 9),
        (11, "é🙂" * 9), (12, "abcd"), (13, "line\nline"), (14, "line\nline "), (15, "x" * 33), (16, "x" * 33), (None, "abc"), (None, "only null"),
        (20, "again"), (20, "again"), (21, "one id"), (21, "two texts"), (22, "two texts")]


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept_left = 1
        for d in ids:
            kept = d == keep and kept_left > 0
            kept_left -= kept
            out.append((d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 3, 4, E.BLOCK])
def test_groups_match_brute_force(spark, size):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in E.exact_groups(docs, size=size).collect()), key=str) == brute(ROWS)


@pytest.mark.parametrize("route", [lambda b: F.lit(1).cast("long"), lambda b: F.length(b).cast("long")])
def test_blocks_that_share_a_route_are_told_apart(spark, route):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert sorted((tuple(r) for r in E.exact_groups(docs, size=4, route=route).collect()), key=str) == brute(ROWS)


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(d, t, n) for n, (d, t) in enumerate(ROWS)], "doc_id long, text string, _sha int")
    kept = E.drop_exact_copies(docs, size=5)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == sorted(
        {(d, t) for (d, _, _, k, s) in brute(ROWS) if k for t in {x or "" for _, x in ROWS} if hashlib.sha256(t.encode()).hexdigest() == s}, key=str)
    assert E.exact_groups(docs.limit(0)).count() == 0 and E.drop_exact_copies(docs.limit(0)).count() == 0
