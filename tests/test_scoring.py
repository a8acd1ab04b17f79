import itertools

import pytest

from ironquill.operators import guards, reports, scoring
from ironquill.operators.enrich import auto_fix, compliance_map


def findings(spark, sevs, key="repo"):
    return spark.createDataFrame([(k, s, i) for i, (k, s) in enumerate(sevs)], f"{key} string, severity string, rule_ord int")


@pytest.mark.parametrize("sevs,score,band", [
    ([], 100, "Excellent"), (["LOW", "LOW"], 90, "Excellent"), (["LOW"] * 3, 85, "Good"), (["HIGH", "LOW"], 75, "Good"),
    (["CRITICAL", "MEDIUM"], 50, "Moderate"), (["CRITICAL", "MEDIUM", "odd"], 45, "High Risk"),
    (["CRITICAL"] * 3, 0, "Critical"), ([None], 95, "Excellent"), (["critical"], 60, "Moderate")])
def test_security_score(spark, sevs, score, band):
    scans = spark.createDataFrame([("r",)], "repo string")
    row = scoring.security_score(findings(spark, [("r", s) for s in sevs]), scans).first()
    assert (row.security_score, row.score_risk_level) == (score, band)


def test_score_is_monotone(spark):
    sevs = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    rows = [(f"{n}", s) for n, combo in enumerate(itertools.combinations_with_replacement(sevs, 3)) for s in combo]
    for r in scoring.security_score(findings(spark, rows)).collect():
        assert 0 <= r.security_score <= 85


def test_risk_and_status(spark):
    f = findings(spark, [("c", "CRITICAL"), ("h", "HIGH"), ("m", "MEDIUM"), ("u", "weird")])
    scans = spark.createDataFrame([(k,) for k in "chmun"], "repo string")
    assert {r.repo: r.risk_level for r in scoring.risk_level(f, scans).collect()} == {
        "c": "CRITICAL", "h": "HIGH", "m": "MEDIUM", "u": "LOW", "n": "NONE"}
    assert {r.repo: r.status for r in scoring.status_label(f, scans).collect()} == {
        "c": "Vulnerable", "h": "Vulnerable", "m": "Caution", "u": "Secure", "n": "Secure"}
    old = {r.repo: (r.score, r.risk) for r in scoring.legacy_score(f, scans, "repo").collect()}
    assert old == {"c": (40, "HIGH"), "h": (25, "HIGH"), "m": (10, "MEDIUM"), "u": (3, "MEDIUM"), "n": (0, "LOW")}


def test_compliance(spark):
    rows = [("xss and sql injection", "", ""), ("", "uses eval( here", ""), ("", "", "nothing"), ("SSH Key", "", "")]
    df = spark.createDataFrame(rows, "title string, description string, match string")
    got = [(r.owasp[:3], r.nist) for r in compliance_map(df).collect()]
    assert got == [("A03", "SI-10"), ("A03", "SI-10"), ("A05", "SI-2"), ("A02", "SC-12")]


@pytest.mark.parametrize("before,after,confidence", [
    ("a = eval(x); b = eval(y)", "a = ast.literal_eval(x); b = eval(y)", 95),
    ("requests.get(u, verify = False)", "requests.get(u, verify=True)", 90),
    ("  el.innerHTML = p$1\\n ", "el.textContent = p$1\\n", 75),
    ("line1\nsubprocess.call(c, shell=True)", "line1\nsubprocess.run(c, shell=False, check=True)", 90),
    ("nothing", None, None), ("eval(", None, None)])
def test_auto_fix(spark, before, after, confidence):
    row = auto_fix(spark.createDataFrame([(before,)], "match string")).first().auto_fix
    assert (row and (row.after, row.confidence)) == (after and (after, confidence))


def test_free_tier(spark):
    f = findings(spark, [("pro", "LOW")] * 9 + [("free", "HIGH")] * 7)
    scans = spark.createDataFrame([("pro", True), ("free", False)], "repo string, is_pro boolean")
    shown = scoring.free_tier_topk(f, ["rule_ord"], scans).groupBy("repo").count().collect()
    assert {r.repo: r["count"] for r in shown} == {"pro": 9, "free": 5}
    s = scoring.truncation(scoring.severity_summary(f).join(scans, "repo"))
    assert {r.repo: r.truncated for r in s.collect()} == {"pro": False, "free": True}


def test_guards(spark):
    rows = [("many", f"f{i}", 1) for i in range(4)] + [("big", "x", 10), ("slip", "a/../../x", 1), ("slip", "b", 1), ("ok", "a/../b", 1)]
    df = spark.createDataFrame(rows, "archive string, member string, size bigint")
    got = {r.archive: r.reason for r in guards.archive_guard(df, 3, 9).collect()}
    assert got["many"] == "ZIP contains too many files (4). Limit is 3."
    assert got["big"].startswith("ZIP uncompressed") and got["slip"].endswith(": a/../../x") and got["ok"] is None


def test_reply_parse(spark):
    rows = [("a", "x\n- one\n - - two\n-\nFIXES:\n-fix FIXES: more\nno"), ("b", "  plain - text "), ("c", "FIXES:")]
    df = spark.createDataFrame(rows, "reply_id string, content string")
    got = {r.reply_id: (r.explanation, r.fixes) for r in reports.llm_reply_parse(df).collect()}
    assert got == {"a": ("one\ntwo", ["fix FIXES: more"]), "b": ("plain - text", []), "c": ("", [])}
