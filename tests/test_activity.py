import datetime as dt
import functools
import random

import numpy as np
from pyspark.sql import functions as F

from ironquill.operators import requests as req
from ironquill.operators import usage
from ironquill.operators.rate_windows import Steps, anchored_windows
from ironquill.operators.sliced import carry_last, running_count

T0 = dt.datetime(2024, 1, 1)
REQ = ("req_id bigint, ts timestamp, user_id string, method string, path string, query string, content_type string, "
       "cf_ip string, real_ip string, fwd_for string, peer string")


def request(i, seconds, path="/", peer="1.1.1.1", **kw):
    row = dict(req_id=i, ts=T0 + dt.timedelta(seconds=seconds), user_id="u", method="GET", path=path, query="", content_type="",
               cf_ip="", real_ip=None, fwd_for="", peer=peer)
    return tuple({**row, **kw}.values())


def numbers(df):
    return {r.req_id: (r.request_number, r.allowed, r.remaining, r.reset_in) for r in df.collect()}


def replay(rows, limits=req.RATE_LIMITS):
    """One counter per (address, bucket), request by request."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        i, ts, path, ip = r[0], r[1].timestamp(), r[4], r[10]
        bucket = "auth" if path.startswith("/auth/") else "scan" if "/scan" in path else "default"
        start, n = state.get((ip, bucket), (None, 0))
        start, n = (ts, 1) if start is None or ts - start > 60 else (start, n + 1)
        state[ip, bucket] = start, n
        out[i] = (n, n <= limits[bucket], max(0, limits[bucket] - n), int(60 - round(ts - start, 6)))
    return out


def test_rate_window_is_anchored(spark):
    rows = [request(i, s) for i, s in enumerate([0, 10, 60, 60.5, 61, 130])]
    got = numbers(req.rate_limit_batch(spark.createDataFrame(rows, REQ)))
    assert [got[i][0] for i in range(6)] == [1, 2, 3, 1, 2, 1]
    assert got[2][3] == 0 and got[1][3] == 50


def test_rate_paths_agree_with_replay(spark):
    rng = random.Random(3)
    rows = [request(i, round(rng.uniform(0, 4000), 3), rng.choice(["/auth/x", "/api/scan", "/"]), rng.choice(["a", "a", "a", "b"]))
            for i in range(1500)]
    df = spark.createDataFrame(rows, REQ).repartition(5)
    expected = replay(rows)
    assert any(not v[1] for v in expected.values())
    assert numbers(req.rate_limit_batch(df)) == expected
    for slices in (1, 3, 40):
        assert numbers(req.rate_limit_batch(df, slices=slices)) == expected
    # Slices shorter than a window, which outlasts several of them.
    dense = [request(i, round(rng.uniform(0, 300), 1), "/", "a" if i % 9 else "b") for i in range(900)]
    assert numbers(req.rate_limit_batch(spark.createDataFrame(dense, REQ), slices=50)) == replay(dense)


def test_steps_compose_to_the_replay():
    rng = random.Random(8)
    for trial in range(300):
        width, spread = rng.choice([1, 5, 20, 60]), rng.choice([20, 100, 400])
        t = np.sort(np.array([rng.randint(0, spread) for _ in range(rng.randint(2, 60))]))
        cuts = sorted({0, len(t), *(rng.randint(0, len(t)) for _ in range(4))})
        parts = [Steps.of(t[a:b], width) for a, b in zip(cuts, cuts[1:]) if b > a]
        start, count = None, 0
        for x in t.tolist():
            start, count = (x, 1) if start is None or x - start > width else (start, count + 1)
        state = None
        for p in parts:
            state = p.end(state, width)
        folded = functools.reduce(lambda a, b: a.then(b, width), parts)
        backward = functools.reduce(lambda a, b: b.then(a, width), parts[::-1])
        assert state == folded.end(None, width) == backward.end(None, width) == (start, count)
        before = (int(t[0]) - rng.randint(0, width), rng.randint(1, 9))
        one = before
        for p in parts:
            one = p.end(one, width)
        assert folded.end(before, width) == backward.end(before, width) == one


def test_a_key_over_many_slices(spark):
    rows = spark.range(200_000).selectExpr("id as i", "'a' as k", "id * 7 % 1000003 as t")
    got = anchored_windows(rows, ["k"], "i", 50, slices=30).agg(F.sum("n"), F.sum("window_start"), F.max("n")).first()
    start, n, sums = None, 0, [0, 0, 0]
    for x in sorted(i * 7 % 1000003 for i in range(200_000)):
        start, n = (x, 1) if start is None or x - start > 50 else (start, n + 1)
        sums = [sums[0] + n, sums[1] + start, max(sums[2], n)]
    assert list(got) == sums


def test_request_columns(spark):
    rows = [request(1, 0, cf_ip=" 9.9.9.9 , 8.8.8.8"), request(2, 0, real_ip="7.7.7.7", fwd_for="6.6.6.6"), request(3, 0, peer=None),
            request(4, 0, query="a='or 1", path="/api/x", method="PUT", content_type="text/html")]
    df = req.request_reasons(req.with_rate_key(spark.createDataFrame(rows, REQ)))
    got = {r.req_id: (r.ip, r.status) for r in df.collect()}
    assert got == {1: ("9.9.9.9", 200), 2: ("7.7.7.7", 200), 3: ("unknown", 200), 4: ("1.1.1.1", 400)}
    assert df.filter("req_id = 4 AND reject").count() == 1


def test_url_rules(spark):
    urls = {"https://github.com/a/b": None, "https://github.com/a": "specific", "http://github.com/a/b": "HTTPS repository",
            "https://GitHub.com/a/b": "GitHub HTTPS", "https://github.com.evil/a/b": "github.com", "https://u@github.com:443/a/b": "GitHub HTTPS"}
    df = req.validate_repo_urls(spark.createDataFrame([(u,) for u in urls], "url string"))
    for r in df.collect():
        assert (r.reason is None and r.ok) if urls[r.url] is None else urls[r.url] in r.reason, r


def test_sliced_windows_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "x", None]), i // 7, i, rng.choice([None, f"v{i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, slice int, i int, v string").repartition(4)
    count, last, expect = {}, {}, {}
    for k, _s, i, v in rows:
        count[k] = count.get(k, 0) + 1
        expect[i] = (count[k], last.get(k))
        last[k] = v or last.get(k)
    out = running_count(df, ["k"], "slice", ["i"], "n")
    out = carry_last(out, ["k"], "slice", "i", "v", "before")
    assert {r.i: (r.n, r.before) for r in out.collect()} == expect


def test_quota(spark):
    users = spark.createDataFrame([("u", "free"), ("p", "PRO"), ("z", "unknown")], "id string, plan string")
    rows = [request(i, i, user_id=u) for i, u in enumerate("u" * 7 + "p" * 7 + "z" * 6)]
    got = usage.quota_check(spark.createDataFrame(rows, REQ), users).groupBy("user_id").agg(
        F.count_if(~F.col("allowed")).alias("denied"), F.max("usage_count").alias("n")).collect()
    assert {r.user_id: (r.denied, r.n) for r in got} == {"u": (2, 7), "p": (0, 7), "z": (1, 6)}


def test_meter(spark):
    rows = [(0, None), (5, 0), (5, -1), (5, 9999), (9, 10), (7, 10), (1, 8), (99, 10)]
    got = usage.usage_meter(spark.createDataFrame(rows, "request_count int, daily_scans int")).collect()
    assert [(r.unlimited, r.pct, r.band) for r in got] == [(True, None, None)] * 4 + [
        (False, 90, "danger"), (False, 70, "warning"), (False, 13, "success"), (False, 100, "danger")]


def scan(i, body, day=10, user="u"):
    return (f"s{i}", user, body, dt.datetime(2024, 1, day, 0, 0, i % 60))


def test_trend_key_presence(spark):
    rows = [scan(1, '{"security_score": null, "score": 7}'), scan(2, '{"score": 7}'), scan(3, '{"a": 1}'),
            scan(4, '{"security_score": 90, "score": 1}'), scan(5, '{"security_score": 50}', day=31), scan(6, None)]
    df = spark.createDataFrame(rows, "id string, user_id string, result_json string, created_at timestamp")
    users = spark.createDataFrame([("u",), ("none",)], "id string")
    assert sorted(r.score for r in usage.trend_points(df, "2024-01-31 12:00:00").collect()) == [7, 50, 90]
    got = {r.user_id: tuple(r)[1:] for r in usage.security_trend(df, "2024-01-31 12:00:00", users=users).collect()}
    assert got == {"u": (49.0, 90, 7, 3), "none": (0.0, 0, 0, 0)}


def test_trend_keeps_the_oldest(spark):
    rows = [(f"s{i:04d}", "u", f'{{"score": {i}}}', T0 + dt.timedelta(minutes=i)) for i in range(620)]
    df = spark.createDataFrame(rows, "id string, user_id string, result_json string, created_at timestamp")
    assert usage.trend_points(df, "2024-01-02 00:00:00").agg(F.max("score")).first()[0] == 499


def test_audit_scope_and_wildcards(spark):
    rows = [(f"a{i}", "u1" if i % 2 else "u2", "o1", act, T0 + dt.timedelta(seconds=i))
            for i, act in enumerate(["scan", "login", "s_an", "SCAN_x", "admin"])]
    df = spark.createDataFrame(rows, "id string, user_id string, org_id string, action string, created_at timestamp")

    def ids(**kw):
        return [r.id for r in usage.audit_search(df, **kw).collect()]

    assert ids() == []
    assert ids(org_id="o1", user_id="u1") == ["a4", "a3", "a2", "a1", "a0"]
    assert ids(user_id="u1") == ["a3", "a1"]
    assert ids(org_id="o1", action_filter="s_an") == ["a3", "a2", "a0"]
    assert ids(org_id="o1", limit=2) == ["a4", "a3"] and len(ids(org_id="o1", limit=-5)) == 1


def test_week_series(spark):
    used = spark.createDataFrame([("u", dt.date(2024, 1, 20), 4), ("u", dt.date(2024, 1, 14), 1), ("u", dt.date(2024, 1, 13), 9)],
                                 "user_id string, date date, request_count bigint")
    users = spark.createDataFrame([("u",), ("idle",)], "id string")
    got = usage.usage_7day_series(used, users, "2024-01-20").orderBy("user_id", "date").collect()
    assert [r.request_count for r in got] == [0] * 7 + [1, 0, 0, 0, 0, 0, 4]
