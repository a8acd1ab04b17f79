"""No bound of a representation may change a result."""

from pyspark.sql import functions as F

from ironquill.operators import cve, requests, usage
from ironquill.operators.secrets import dedup_matches


def test_places_of_many_rules_and_long_lines(spark):
    rows = [("r", "p", "l", "raw", 7, 4100, 70_000), ("r", "p", "l", "raw", 9, 1, 1), ("r", "p", "m", "raw", 2**31 - 1, 2**31 - 1, 2**31 - 1)]
    matches = spark.createDataFrame(rows, "repo string, path string, label string, raw string, line int, rule_ord int, match_pos int")
    got = sorted((r["line"], r["rule_ord"], r["match_pos"]) for r in dedup_matches(matches).collect())
    assert got == [(7, 4100, 70_000), (2**31 - 1,) * 3]


def _feed(spark, text, **metrics):
    def score(v):
        return [{"cvssData": {"baseScore": v}}] if v is not None else None

    cve_type = ("cve struct<id:string,published:string,descriptions:array<struct<value:string>>,metrics:struct<"
                + ",".join(f"{m}:array<struct<cvssData:struct<baseScore:double>>>" for m in cve.METRICS)
                + ">,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,references:array<struct<url:string>>>")
    record = {"id": "CVE-1", "published": "2020", "descriptions": [{"value": text}], "metrics": {m: score(metrics.get(m)) for m in cve.METRICS},
              "configurations": [], "references": []}
    return spark.createDataFrame([(record,)], cve_type)


def test_keyword_search_reads_the_whole_description(spark):
    raw = _feed(spark, "pad " * 150 + "SQL injection in search", cvssMetricV2=4.0)
    found = cve.cve_keyword_search(cve.cve_flatten(raw, None), "sql injection").collect()
    assert len(found) == 1 and len(found[0]["description"]) == cve.DESCRIPTION_CHARS
    asked = spark.createDataFrame([("t", "SQL injection", "N/A", 1)], "text_id string, title string, cve string, rule_ord int")
    hit = cve.finding_cve_lookup(asked, cve.cve_flatten(raw, None, cve.METRICS[:1]), ["rule_ord"]).first()
    assert hit["top_cve"] == "CVE-1" and hit["top_cvss"] is None


def test_reason_names_the_limit_in_force(spark):
    rows = spark.createDataFrame([("x" * 11,)], "text string")
    assert requests.validate_text(rows, max_chars=10).first()["reason"] == "Input too large (max 10 chars)"


def test_unknown_users_count_against_the_free_plan(spark):
    asked = spark.range(7).select(F.col("id").alias("req_id"), F.lit("nobody").alias("user_id"), F.timestamp_micros(F.col("id") * 1_000_000).alias("ts"))
    users = spark.createDataFrame([], "id string, plan string")
    got = usage.quota_check(asked, users).orderBy("req_id").collect()
    assert [r["allowed"] for r in got] == [True] * 5 + [False] * 2 and {r["plan"] for r in got} == {"free"}


def test_feed_lines_that_are_no_json_are_reported(spark, tmp_path):
    from ironquill.sources.tables import cve_feed_rejects, src_cve_feed

    feed = tmp_path / "feed.json"
    feed.write_text('{"cve": {"id": "A"}}\n{"cve": {"id": \n{"vulnerabilities": [{"cve": {"id": "B"}}, {"cve": {"id": "C"}}]}\n')
    assert sorted(r.id for r in src_cve_feed(spark, str(feed)).select("cve.id").collect()) == ["A", "B", "C"]
    assert [r.line for r in cve_feed_rejects(spark, str(feed)).collect()] == ['{"cve": {"id": ']
