"""Queries against an independent engine on the same tables.

A spread of them by default; all with IRONQUILL_ALL=1 (several minutes).
"""

import os

import pytest

from ironquill.workload.oracles import ORACLES
from ironquill.workload.queries import QUERIES
from ironquill.workload.views import BASE

FOLDER = os.environ.get("IRONQUILL_DATA", "/root/testdata/sf0.001")
DEFAULT = ("literal_rule_match", "entropy_secrets", "analyze_report", "secret_match", "scan_report", "dependency_report",
           "security_trend", "quota_check", "rate_limit_batch", "subscription_state", "cve_report", "finding_cve_lookup", "cve_search_v1", "cve_search_many", "advisory_match_many",
           "dashboard_bundle", "trial_status", "finding_summary_text", "stream_rate_limit")
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def other():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM '{FOLDER}/{b}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("IRONQUILL_ALL") else DEFAULT)
def test_query(spark, other, name):
    df = QUERIES[name](spark, FOLDER)
    cursor = other.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    theirs = sorted(str([plain(r[names.index(c)]) for c in order]) for r in cursor.fetchall())
    ours = sorted(str([plain(r[c]) for c in order]) for r in df.collect())
    assert len(ours) > 0 and ours == theirs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_keep_what_scale_needs(spark):
    top = plan(QUERIES["free_tier_topk"](spark, FOLDER))
    assert "WindowGroupLimit" in top  # rows beyond k are cut before the shuffle
    dedup = plan(QUERIES["dedup_matches"](spark, FOLDER))
    assert "partial_min" in dedup and "SortAggregate" not in dedup and "ArrowEvalPython" not in dedup
    for name in ("scan_report", "finding_cve_lookup", "dependency_report", "quota_check", "subscription_state"):
        text = plan(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    # Fixed tables are local relations, so no plan deals the large side out by a few rule, plan or bucket names.
    for name in ("sort_findings", "scan_report", "advisory_match", "eol_match", "dependency_report", "plan_gate", "user_org_limits",
                 "quota_check", "rate_limit_batch", "recent_scans", "dashboard_bundle"):
        text = plan(QUERIES[name](spark, FOLDER))
        # The sorted requests are a checkpoint; that is the only other scan.
        assert text.count("ExistingRDD") == (1 if name == "rate_limit_batch" else 0), name
        for key in ("rule_ord", "_lp", "name", "bucket"):
            assert f"hashpartitioning({key}#" not in text, (name, key)
    scores = plan(QUERIES["analyze_report"](spark, FOLDER))
    assert "Join" not in scores and "hashpartitioning" not in scores
    lookup = plan(QUERIES["src_tables"](spark, FOLDER))
    assert "GreaterThanOrEqual(o_orderdate,1998-01-01T00:00)" in lookup
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in lookup
