import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ironquill.operators import requests as req
from ironquill.operators import secrets
from ironquill.sources import manifest_table, sinks
from ironquill.streaming import streams
from tests.test_activity import REQ, T0, numbers, request
from tests.test_billing import EVENTS, USERS, event, states, user
from ironquill.operators.billing import subscription_state
from ironquill.rules.plan_limits import EV_ACTIVATED, EV_FAILED, EV_RENEWED


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def drain(stream, tmp):
    (stream.writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/check")
     .trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{tmp}/out")


def test_rate_limit_restarts_and_equals_batch(spark, tmp_path):
    rows = [request(i, s, peer="a" if i % 3 else "b") for i, s in enumerate([0, 5, 9, 40, 59, 60, 61, 62, 75, 121, 122, 190, 191, 300])]
    parts = [rows[:5], rows[5:9], rows[9:]]
    for part in parts:  # one run per arrival; the state survives in the checkpoint
        land(spark.createDataFrame(part, REQ), tmp_path / "in")
        source = spark.readStream.schema(REQ).parquet(str(tmp_path / "in"))
        out = drain(streams.stream_rate_limit(source), tmp_path)
    assert numbers(out) == numbers(req.rate_limit_batch(spark.createDataFrame(rows, REQ)))


def usage_counts(spark, path):
    return {(r.user_id, str(r.date)): r.request_count for r in sinks.usage_view(spark, str(path)).collect()}


def test_usage_upsert_counts_once(spark, tmp_path, monkeypatch):
    rows = [request(i, i * 3600, user_id=f"u{i % 2}") for i in range(72)]
    frame = lambda part: spark.createDataFrame(part, REQ).withColumn("org_id", F.lit("o"))
    land(frame(rows[:30]), tmp_path / "in")
    source = spark.readStream.schema(frame(rows).schema).parquet(str(tmp_path / "in"))
    run = lambda check: streams.stream_usage_upsert(source, f"{tmp_path}/t", f"{tmp_path}/{check}").awaitTermination()
    run("a")
    land(frame(rows[30:60]), tmp_path / "in")
    with monkeypatch.context() as m:  # the data are written, the commit fails

        def crash(*args):
            raise OSError("lost")

        m.setattr(manifest_table, "commit", crash)
        with pytest.raises(Exception, match="lost"):
            run("a")
    assert sum(usage_counts(spark, f"{tmp_path}/t").values()) == 30
    run("a")
    land(frame(rows[60:]), tmp_path / "in")
    run("a")
    want = {(u, d): 12 for u in ("u0", "u1") for d in ("2024-01-01", "2024-01-02", "2024-01-03")}
    assert usage_counts(spark, f"{tmp_path}/t") == want
    now = manifest_table.current(spark, f"{tmp_path}/t")
    sinks.sink_upsert_usage(f"{tmp_path}/t", now["query"])(frame(rows[60:]), now["batch"])  # the last batch again
    assert usage_counts(spark, f"{tmp_path}/t") == want
    assert len(now["query"]) == 36  # the id that the checkpoint keeps
    untouched = now["partitions"]["2024-01-01"]
    assert "-0/" in untouched or "-1/" in untouched  # the third batch has not rewritten it
    assert manifest_table.vacuum(spark, f"{tmp_path}/t", keep=1) > 0 and usage_counts(spark, f"{tmp_path}/t") == want
    run("b")  # another checkpoint reads everything again
    assert usage_counts(spark, f"{tmp_path}/t") == want


def test_late_rows_are_dropped(spark, tmp_path):
    for seconds in ([0, 10], [2 * 86400], [20], [4 * 86400]):
        land(spark.createDataFrame([request(i, s) for i, s in enumerate(seconds)], REQ), tmp_path / "in")
        source = spark.readStream.schema(REQ).parquet(str(tmp_path / "in"))
        out = drain(streams.stream_usage_daily(source), tmp_path)
    assert {(str(r.date), r.request_count) for r in out.collect()} == {("2024-01-01", 2), ("2024-01-03", 1)}


def test_usage_of_open_days(spark, tmp_path):
    for seconds in ([0, 10], [2 * 86400], [2 * 86400 + 20, 4 * 86400]):
        land(spark.createDataFrame([request(i, s) for i, s in enumerate(seconds)], REQ), tmp_path / "in")
        source = spark.readStream.schema(REQ).parquet(str(tmp_path / "in"))
        streams.stream_usage_open(source, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {(str(r.date), r.request_count) for r in streams.usage_now(spark, str(tmp_path / "out")).collect()}
    assert got == {("2024-01-01", 2), ("2024-01-03", 2), ("2024-01-05", 1)}


def test_secret_scan_equals_batch(spark, tmp_path):
    key = "AK" + "IA" + "Z" * 16
    files = spark.createDataFrame([("r", f"f{i // 2}.py" if i < 2 else f"f{i}.py", False, 9, f"a\nk={key}\nmd5(x) md5(x)\nk={key}") for i in range(6)],
                                  "repo string, path string, is_link boolean, size bigint, content string")
    land(files, tmp_path / "in")
    source = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    out = drain(streams.stream_secret_scan(source), tmp_path)
    got = [(r.repo, r.path, r.label, r.line, r.rule_ord, r.match_pos) for r in out.collect()]
    once = {(r.repo, r.path, r.type, r.line, r.rule_ord, r.match_pos) for r in secrets.secret_findings(files).collect()}
    assert set(got) == once and len(got) == 6 * len(once) // 5  # one path arrived twice, as a file of its own each time
    assert key not in str(out.collect())


def test_alerts_and_audit(spark, tmp_path):
    rows = spark.createDataFrame([request(1, 0, query="q=<script "), request(2, 0, query="ok")], REQ)
    land(rows, tmp_path / "in")
    out = drain(streams.stream_injection_alerts(spark.readStream.schema(REQ).parquet(str(tmp_path / "in"))), tmp_path / "a")
    assert [r.req_id for r in out.collect()] == [1]
    logs = spark.createDataFrame([("u", "scan", T0, "x" * 600, "")], "user_id string, action string, created_at timestamp, metadata string, "
                                 "resource string")
    land(logs, tmp_path / "logs")
    source = spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs"))
    streams.stream_audit_append(source, f"{tmp_path}/audit", f"{tmp_path}/c").awaitTermination()
    row = spark.read.parquet(f"{tmp_path}/audit").first()
    assert len(row.metadata) == 500 and row.resource is None


def test_subscription_stream_equals_batch(spark, tmp_path):
    users = spark.createDataFrame([user("a", sub="S1"), user("b"), user("c")], USERS)
    events = [event(1, EV_ACTIVATED, "S2", "b"), event(2, EV_FAILED[0], "S1"), event(3, EV_ACTIVATED, "S1", "c"),
              event(4, EV_RENEWED[0], "S1"), event(5, EV_FAILED[1], "S2"), event(6, EV_RENEWED[0], "S2")]
    for part in (events[:2], events[2:5], events[5:]):
        land(spark.createDataFrame(part, EVENTS), tmp_path / "in")
        source = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        streams.stream_subscription_state(source, users, f"{tmp_path}/s", f"{tmp_path}/c").awaitTermination()
    want = states(subscription_state(spark.createDataFrame(events, EVENTS), users))
    assert states(streams.state_now(spark, f"{tmp_path}/s", users)) == want
    # Another checkpoint replays all events beside the first one's rows.
    streams.stream_subscription_state(source, users, f"{tmp_path}/s", f"{tmp_path}/again").awaitTermination()
    assert states(streams.state_now(spark, f"{tmp_path}/s", users)) == want


def test_rate_limit_backlog_is_folded_in_parts(spark, tmp_path):
    rng = random.Random(4)
    rows = [request(i, rng.randint(0, 400), peer="a" if i % 7 else "b") for i in range(300)]
    land(spark.createDataFrame(rows, REQ), tmp_path / "in")
    source = spark.readStream.schema(REQ).parquet(str(tmp_path / "in"))
    out = drain(streams.stream_rate_limit(source, held=9), tmp_path)
    assert numbers(out) == numbers(req.rate_limit_batch(spark.createDataFrame(rows, REQ)))


def test_late_requests_are_counted(spark, tmp_path):
    for n, seconds in enumerate(([0, 10], [2 * 86400], [20, 30], [2 * 86400 + 5])):
        land(spark.createDataFrame([request(10 * n + i, s) for i, s in enumerate(seconds)], REQ), tmp_path / "in")
        stream = streams.stream_rate_limit(spark.readStream.schema(REQ).parquet(str(tmp_path / "in")))
        query = (stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        late = sum(r.dropped for r in streams.late_rows(query).collect())
        assert late == (2 if n == 2 else 0)
    kept = {(r.req_id, r.request_number) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()}
    assert kept == {(0, 1), (1, 2), (10, 1), (30, 2)}


def test_latest_state(spark):
    rows = [("t", "QUEUED", 0, None, 1), ("t", "DONE", 100, "{}", 3), ("t", "SCANNING", 60, None, 2), ("u", "FAILED", 0, "{}", 1),
            ("u", "RETRY", 5, None, 2)]
    df = spark.createDataFrame(rows, "id string, state string, progress int, result_json string, updated_at int")
    got = {r.id: (r.state, r.progress, r.result_json) for r in sinks.sink_latest_state(df).collect()}
    assert got == {"t": ("DONE", 100, "{}"), "u": ("RETRY", 5, "{}")}


def test_scan_rows_round_trip(spark, tmp_path):
    summary = spark.createDataFrame([("r", "HIGH", 3, 70)], "repo string, risk_level string, total_secrets int, security_score int")
    sinks.sink_scan_results(sinks.scan_rows(summary, "u", dt.datetime(2024, 1, 2)), str(tmp_path / "scans"))
    row = spark.read.parquet(str(tmp_path / "scans")).first()
    assert (row.source, str(row.scan_date)) == ("r", "2024-01-02") and '"security_score":70' in row.result_json
