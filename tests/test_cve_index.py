"""The stored index finds what a scan finds."""

import random

import pytest
from pyspark.sql import functions as F

from ironquill.operators import cve, cve_index

SCHEMA = "id string, published string, cvss_score double, description string"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(f"C{i:04}", str(2000 + rng.randrange(20)), i / 10, "".join(rng.choice("abAB é😀\n%_") for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [("C0001", "2030", 1.0, "one id, another text: Heap overflow"), (None, "2031", 2.0, "no id: heap OVERFLOW"), ("null", "2032", 3.0, None),
             ("empty", "2033", 4.0, ""), ("long", "2034", 5.0, "pad " * 50_000 + "needle 😀x")]
    cves = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path_factory.mktemp("index") / "i")
    cve_index.write_cve_index(cves.repartition(5), path)
    return cves, path


QUERIES = ["ab", "abA", " é😀", "aba b", "heap overflow", "needle 😀x", "x", "", "  ", "%_", "zzz", "no such text", "😀x", "d pad p", "b" * 150, "\nab"]


def scanned(cves, q, k):
    return [(r["id"], r["description"]) for r in cve.cve_keyword_search(cves, q, k).collect()]


@pytest.mark.parametrize("q", QUERIES)
def test_one_search_equals_the_scan(spark, stored, q):
    cves, path = stored
    got = cve_index.v2_result(cve_index.search_cve_index(spark, path, q, 7)).collect()
    assert [(r["id"], r["description"]) for r in got] == scanned(cves, q, 7)


def test_many_searches_equal_the_scan(spark, stored):
    cves, path = stored
    asked = spark.createDataFrame([(q,) for q in [*QUERIES, *QUERIES, None]], "query string")
    got = {}
    for r in cve_index.v2_result(cve_index.search_cves(path, asked, 7)).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], r["description"]))
    want = {q: found for q in QUERIES if (found := scanned(cves, q, 7))}
    assert got == want


def test_search_reads_its_own_folders_only(spark, stored):
    _, path = stored
    plan = cve_index._held(cve_index._postings(spark, path), ["abc"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "xxhash64" not in plan
    assert cve_index.search_cve_index(spark, path, None).count() == 0


def test_older_result(spark, stored):
    _, path = stored
    row = cve_index.v1_result(cve_index.search_cve_index(spark, path, "needle")).first()
    assert row.asDict() == {"id": "long", "description": ("pad " * 75), "cvss": 5.0}


def test_empty_index(spark, tmp_path):
    cve_index.write_cve_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert cve_index.search_cve_index(spark, str(tmp_path / "e"), "abc").count() == 0
    assert cve_index.search_cves(str(tmp_path / "e"), spark.createDataFrame([("abc",)], "query string")).count() == 0


def test_lookup_by_the_rarest_word(spark):
    known = spark.createDataFrame([("A", "2001", 1.0, "common words only"), ("B", "2002", 2.0, "common rare Words"), ("C", "2003", None, "common"),
                                   ("D", "2003", 4.0, None)], SCHEMA)
    rows = [("t", "Rare common", "N/A", 1), ("t", "words", None, 2), ("t", "absent words", "N/A", 3), ("t", "", "N/A", 4), ("t", "--", "N/A", 5), ("t", "common", "N/A", 6),
            ("u", "common", "N/A", 1), ("u", "common", "CVE-1", 2)]
    asked = spark.createDataFrame(rows, "text_id string, title string, cve string, rule_ord int")
    out = cve.finding_cve_lookup(asked, known, ["rule_ord"])
    got = {(r["text_id"], r["rule_ord"]): (r["top_cve"], r["top_cvss"]) for r in out.collect()}
    assert got == {("t", 1): ("B", 2.0), ("t", 2): ("B", 2.0), ("t", 3): (None, None), ("t", 5): (None, None), ("u", 1): ("C", None)}
