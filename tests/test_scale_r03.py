"""Work that is done once, in pieces and without a pass more than needed; the results stay."""

import math
import os
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from ironquill.functions import text as T
from ironquill.operators import cve, cve_index, paste, scoring, secrets
from ironquill.sources import files as src
from ironquill.sources.listing import CorpusReader
from ironquill.streaming.streams import _last_of_batch


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def entropy(text):
    return -sum(p * math.log2(p) for c in set(text) for p in [text.count(c) / len(text)]) if text else 0.0


def test_entropy_takes_characters_out(spark):
    texts = ["", "a", "aab", "é😀é\n", "the quick brown fox", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(T.shannon_entropy(F.col("text"))).collect()]
    assert got[-1] is None and all(abs(g - entropy(t)) < 1e-9 for g, t in zip(got[:-1], texts[:-1]))
    long = spark.range(1).select(F.concat(F.repeat(F.lit("a"), 3_000_000), F.lit("".join(map(chr, range(0x4E00, 0x4E00 + 4000))))).alias("text"))
    began = time.time()
    bits = long.select(T.shannon_entropy(F.col("text"))).first()[0]
    n = 3_004_000
    want = -(3_000_000 / n) * math.log2(3_000_000 / n) + 4000 / n * math.log2(n)
    assert abs(bits - want) < 1e-6 and time.time() - began < 20


def test_tokens_are_scored_once_and_marks_lose_no_literal(spark):
    rng = random.Random(3)
    parts = [r.literal for r in paste.LITERAL_RULES] + ["plain", "(", '"', "=", "_", "Q" * 3]
    rows = [(str(i), " ".join(rng.choice(parts) for _ in range(rng.randrange(5)))) for i in range(300)] + [("n", None)]
    texts = spark.createDataFrame(rows, "text_id string, text string")
    got = sorted((r.text_id, r.rule_ord) for r in paste.literal_rule_match(texts).collect())
    want = sorted((i, n) for i, t in rows if t for n, r in enumerate(paste.LITERAL_RULES) if r.literal.lower() in t.lower())
    assert got == want
    assert plan(paste.entropy_secrets(texts)).count("regexp_extract_all(") == 1


def _texts(spark):
    return spark.createDataFrame([("b", "eval(x) os.system(y)"), ("a", "md5(z) pickle.loads(q)")], "text_id string, text string")


def test_sorts_read_kept_findings(spark):
    out = scoring.sort_cards(paste.analyze_text(_texts(spark)), ["text_id"])
    assert "Generate" not in plan(out)
    assert [(r.text_id, r.severity) for r in out.collect()] == [("a", "CRITICAL"), ("a", "LOW"), ("b", "HIGH"), ("b", "HIGH")]


def _files(spark):
    rows = [("r", ".env", False, 9, "k = 1"), ("r", "a.py", False, 9, "x\nAK" + "IA" + "ABCDEFGHIJKLMNOP\n"), ("q", "b.py", False, 9, "-----BEGIN " + "RSA PRIVATE KEY-----"),
            ("q", "c/.env", False, 9, None)]
    return spark.createDataFrame(rows, "repo string, path string, is_link boolean, size bigint, content string")


def test_findings_with_names_apart(spark):
    files = _files(spark)
    found = secrets.secret_findings(files, names=files.select("repo", "path", "size"))
    assert sorted(map(str, found.collect())) == sorted(map(str, secrets.secret_findings(files).collect()))
    assert "Generate" not in plan(secrets.sort_findings(found, ["repo"]))
    scans = spark.createDataFrame([("r", True), ("q", False)], "repo string, is_pro boolean")
    shown = scoring.free_tier_topk(found, secrets.finding_order(), scans, 1)
    assert "Generate" not in plan(shown) and shown.filter("repo = 'q'").count() == 1


def test_places_of_both_widths(spark):
    rows = [("r", "p", "l", "raw", 7, 5000, 0), ("r", "p", "l", "raw", 7, 4095, 2**20 - 1), ("r", "p", "l", "raw", 7, 4095, 2**20),
            ("r", "p", "m", "raw", 3, 2**31 - 1, 0), ("r", "p", "m", "raw", 4, 0, 0), ("r", "p", "n", "raw", 2**31 - 1, 1, 1)]
    matches = spark.createDataFrame(rows, "repo string, path string, label string, raw string, line int, rule_ord int, match_pos int")
    out = secrets.dedup_matches(matches)
    assert {r.label: (r.line, r.rule_ord, r.match_pos) for r in out.collect()} == {
        "l": (7, 4095, 2**20 - 1), "m": (3, 2**31 - 1, 0), "n": (2**31 - 1, 1, 1)}
    assert "bigint" in str(plan(out)) and "_near" in plan(out)


def test_newest_cves_are_searched_first(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"C{rng.randrange(900):04}" if i % 50 else None, rng.choice(["2020", "2021", "2022", None]), 1.0, " ".join(rng.choice(["red", "blue", "bolt", "ring", "x9"]) for _ in range(3)))
            for i in range(1000)] + [("old", "1999", 1.0, "red needle")]
    cves = spark.createDataFrame(rows, "id string, published string, cvss_score double, description string")
    path = str(tmp_path / "i")
    cve_index.write_cve_index(cves.repartition(5), path)
    assert len([f for f in os.listdir(f"{path}/postings") if f.startswith("bucket")]) > 1
    queries = ["red", "re", "red bolt", "needle", "x9 x9 x9", "ring blue", "absent"]
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    key = lambda r: (r["published"], r["id"])
    got = {}
    for r in cve_index.search_cves(path, asked, 3, ahead=(16, 128)).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(key(r))
    want = {q: [key(r) for r in cve.cve_keyword_search(cves, q, 3).collect()] for q in queries}
    assert got == {q: w for q, w in want.items() if w}


def test_trees_in_parts(spark, tmp_path):
    files = _files(spark).unionByName(_files(spark).withColumn("path", F.concat(F.lit("d/"), "path")))

    def read(roots):
        return src.src_file_corpus(spark, roots, src.scannable).select("repo", "path", "size", F.md5("content").alias("md5"))

    whole = sorted(map(tuple, src.through_trees(spark, files, f"file://{tmp_path}/w", read).collect()))
    assert sorted(map(tuple, src.through_trees(spark, files, f"file://{tmp_path}/p", read, 2).collect())) == whole and len(whole) == 8
    left = [f for d, _, names in os.walk(tmp_path / "p") for f in names if "tree-" in d]
    assert left == [] and any("tree-" in d for d, _, _ in os.walk(tmp_path / "w"))


def test_many_directories_are_few_tasks(tmp_path):
    for i in range(300):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "f.py").write_text("x")
    reader = CorpusReader({"r": str(tmp_path)}, (), 8, 1 << 20)
    tasks = reader.partitions()
    assert len(tasks) <= 16 and sorted(row[2] for t in tasks for row in reader.read(t)) == sorted(f"d{i}/f.py" for i in range(300))


def test_users_with_many_events_send_few_rows():
    pdf = pd.DataFrame({"user_id": ["u"] * 1000 + ["v"], "seq": [*range(1000), 5], "a": ["x", *[None] * 999, "y"], "b": [None, "z"] * 500 + [None]})
    (out,) = _last_of_batch(("a", "b"))([pdf])
    assert sorted(zip(out["user_id"], out["seq"])) == [("u", 0), ("u", 999), ("v", 5)]
