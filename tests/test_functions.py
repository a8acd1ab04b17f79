import html
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ironquill.functions import text as T
from ironquill.functions.regex import WHITESPACE, jvm
from ironquill.rules.literal_rules import INJECTION_REGEXES
from ironquill.rules.secret_rules import SECRET_RULES


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_redact_lengths(spark):
    values = ["", "a" * 6, "a" * 7, "a" * 14, "a" * 40]
    assert column(spark, values, T.redact) == [
        "***", "***", "aaaaaa*  (redacted)", "aaaaaa********  (redacted)", "aaaaaa********  (redacted)"]
    shown = column(spark, ["abcdefghijk"], T.redact)[0]
    assert shown.startswith("abcdef*") and "g" not in shown


def test_entropy(spark):
    tie = "".join(chr(65 + i) for i in range(16)) + "".join(chr(97 + i) * 2 for i in range(8))
    values = ["", "aaaa", "abcd", tie, "hello world"]

    def bits(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0

    got = column(spark, values, T.shannon_entropy)
    assert got[3] == 4.5
    assert got == pytest.approx([bits(v) for v in values])


def test_two_decimals_ties(spark):
    df = spark.createDataFrame([(4.5,), (4.625,), (4.875,), (5.0,)], "v double")
    assert [r[0] for r in df.select(T.two_decimals(F.col("v"))).collect()] == [f"{v:.2f}" for v in (4.5, 4.625, 4.875, 5.0)]


def test_file_ext(spark):
    paths = [".env", "a/.env", ".env.local", "..x.py", "a.b/c", "a/b.tar.gz", "x.", "a/..foo", "a/.b.c", "Makefile", "X.PY"]
    assert column(spark, paths, T.file_ext) == [os.path.splitext(p)[1].lower() for p in paths]


def test_version_parse_orders_like_number_lists(spark):
    values = ["2.2.27", "1.0rc1", "", "latest", "10", "3.2", "9999999999999999999999999.1", "9999999999999999999999998.1", "007"]
    got = column(spark, values, T.version_parse)
    assert [[int(n["number"]) for n in v] for v in got] == [
        [2, 2, 27], [1, 0, 1], [0], [0], [10], [3, 2], [10**25 - 1, 1], [10**25 - 2, 1], [7]]
    assert sorted(range(len(got)), key=lambda i: got[i]) == sorted(range(len(got)), key=lambda i: [int(n["number"]) for n in got[i]])


def test_cvss(spark):
    assert column(spark, ["9", "8.9", "7", "4.0", "0.1", "0", "-1", "x", None, "nan"], T.cvss_severity) == [
        "CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "NONE", "NONE", "UNKNOWN", "UNKNOWN", "NONE"]


def test_html_escape(spark):
    values = ["<a href='x'>&amp;\"</a>", "plain"]
    assert column(spark, values, T.html_escape) == [html.escape(v) for v in values]


def test_whitespace_is_that_of_strip():
    assert set(WHITESPACE) == {chr(c) for c in range(0x11000) if chr(c).isspace()}


def test_patterns_mean_the_same(spark):
    """Random lines around each rule's own characters: both engines find the same matches."""
    rng = random.Random(7)
    odd = [chr(c) for c in (0xA0, 0x2003, 0x1C, 0x85, 0x131, 0x130, 0x17F, 0x212A, 0xE9, 0x661)]
    words = ["sk-", "sk-proj-", "hf_", "AKIA", "aws", "secret", "SECRET_KEY", "jwt_secret", "password", "pwd", "token",
             "api_key", "=", ": ", '"', "'", " ", "https://", "x?key=", "postgres://u:p@host/db", "md5 (", "sha1(", "#TODO",
             "Bearer ", "Authorization", "changeme", "your", "_", "-", ".", "SG.", "union", "select", "<script>", "on", "or 1",
             "Q" * 20, "a1" * 18, "0f" * 16, "eyJ" + "b" * 12, "0" * 40, "Drop ", ";"] + odd
    lines = ["".join(rng.choice(words) for _ in range(rng.randint(3, 14))) for _ in range(4000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").cache()
    patterns = [r.regex for r in SECRET_RULES] + ["(?i)" + p for p in INJECTION_REGEXES]
    cols = [F.regexp_extract_all("t", F.lit(jvm(p)), F.lit(0)).alias(f"p{k}") for k, p in enumerate(patterns)]
    rows = df.select("i", *cols).collect()
    hits = 0
    for r in rows:
        for k, p in enumerate(patterns):
            expected = [m.group(0) for m in re.finditer(p, lines[r.i])]
            assert r[f"p{k}"] == expected, (p, lines[r.i])
            hits += len(expected)
    assert hits > 1000
