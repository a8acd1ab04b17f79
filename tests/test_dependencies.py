import json

import pytest

from ironquill.operators import dependencies as dep
from ironquill.plans.composites import dependency_report
from ironquill.sources.manifests import declared_packages


def parse(spark, manifest, content):
    df = spark.createDataFrame([("r", manifest, manifest, content)], "repo string, path string, manifest string, content string")
    return [(r.name, r.version) for r in declared_packages(df).orderBy("pos").collect()]


CASES = [
    ("requirements.txt", "Django==2.2.27\r\n# no\n-r x\n a_b >= 3.2,<4 # c\npkg[extra]==1\nz===1\ny!=1.0\n  plain  \n@@",
     [("django", "2.2.27"), ("a-b", "3.2"), ("pkg", ""), ("z", ""), ("y", "1.0"), ("plain", "")]),
    ("package.json", json.dumps({"dependencies": {"A": "^1.2", "b": ">= 2"}, "devDependencies": {"c": "latest", "n": 3}}),
     [("a", "1.2"), ("b", "2"), ("c", "latest"), ("n", "3")]),
    ("package.json", json.dumps({"dependencies": None, "devDependencies": {"c": "*"}}), [("c", "*")]),
    ("package.json", json.dumps({"dependencies": ["x"], "devDependencies": {"c": "*"}}), []),
    ("package.json", "{'a': 1}", []),
    ("package-lock.json", json.dumps({"packages": {"": {"version": "1"}, "node_modules/a": {"version": "2"}, "node_modules/a/"
     "node_modules/@s/B": {"version": "3"}, "node_modules/l": {"link": True}}}), [("a", "2"), ("@s/b", "3")]),
    ("package-lock.json", json.dumps({"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2",
     "dependencies": {"c": {"version": "3"}}}}}, "d": {"version": "4"}}}), [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")]),
    ("package-lock.json", json.dumps({"dependencies": {"a": {"version": "1", "dependencies": ["x"]}, "d": {"version": "4"}}}), [("a", "1")]),
    ("package-lock.json", json.dumps({"dependencies": {"a": {"dependencies": {"b": {"version": "2"}, "c": 7, "e": {"version": "5"}}},
     "d": {"version": "4"}}}), [("b", "2")]),
    ("package-lock.json", json.dumps({"dependencies": {"A": {"version": ""}, "b": {"version": "2", "dependencies": {}}, "c": {"version": 3}}}),
     [("b", "2"), ("c", "3")]),
    ("package-lock.json", json.dumps({"dependencies": "x"}), []),
    ("Pipfile.lock", json.dumps({"default": {"X": {"version": "==1.0"}, "y": {}}, "develop": {"z": {"version": "==2"}}}),
     [("x", "1.0"), ("z", "2")]),
    ("Pipfile", '[packages]\nA_b = "==1.5"\nstar = "*"\ntab = {version = "1"}\n\n[dev-packages]\nd = "~=2.0"\n[requires]\nq = "1"\n',
     [("a-b", "1.5"), ("star", ""), ("d", "2.0")]),
    ("poetry.lock", 'name = "no"\n[[package]]\nname = "A"\nversion = "1.0"\n[[package]]\nname = "b"\n[[package]]\nversion = "2"\n'
     'name = "c"\n', [("a", "1.0"), ("c", "2")]),
]


@pytest.mark.parametrize("manifest,content,expected", CASES)
def test_parsers(spark, manifest, content, expected):
    assert parse(spark, manifest, content) == expected


def test_deep_and_wide_locks(spark):
    deep = {}
    for i in reversed(range(60)):
        deep = {f"n{i}": {"version": f"{i + 1}.0", "dependencies": deep} if deep else {"version": f"{i + 1}.0"}, f"z{i}": {"version": "9"}}
    text = json.dumps({"lockfileVersion": 1, "dependencies": deep})
    assert parse(spark, "package-lock.json", text) == [(f"n{i}", f"{i + 1}.0") for i in range(60)] + [(f"z{i}", "9") for i in reversed(range(60))]
    wide = {f"p{i}": {"version": str(i + 1), "dependencies": {f"q{i}": {"version": "1"}}} for i in range(800)}
    got = parse(spark, "package-lock.json", json.dumps({"dependencies": wide}))
    assert got == [x for i in range(800) for x in ((f"p{i}", str(i + 1)), (f"q{i}", "1"))]


def check(spark, pairs):
    deps = spark.createDataFrame([("r", n, v) for n, v in pairs], "repo string, name string, version string")
    return {(r.package, r.version): (r.cve, r.severity) for r in dep.dependency_findings(deps).collect()}


def test_advisory_boundaries(spark):
    got = check(spark, [("lodash", "4.17.20"), ("lodash ", "1"), ("django", "2.2.27"), ("django", "4.0.4"), ("flask", "1.0"),
                        ("flask", "0.12.2"), ("react", "16.0.9"), ("react", "16.1"), ("axios", "latest"), ("axios ", "")])
    assert got == {
        ("lodash", "4.17.20"): ("CVE-2020-8203", "HIGH"), ("django", "2.2.27"): ("CVE-2022-28346", "CRITICAL"),
        ("flask", "1.0"): ("N/A", "LOW"), ("flask", "0.12.2"): ("CVE-2018-1000656", "HIGH"), ("react", "16.0.9"): ("N/A", "LOW"),
        ("axios", "latest"): ("CVE-2021-3749", "HIGH")}
    assert check(spark, [("lodash", "4.17.21")]) == {("lodash", "4.17.21"): ("CVE-2021-23337", "CRITICAL")}
    assert check(spark, [("lodash", "4.17.22"), ("lodash2", "1")]) == {}


def test_priority_and_last_mention(spark):
    rows = [("r", "b/Pipfile", "Pipfile", 0, "flask", "0.1"), ("r", "a/requirements.txt", "requirements.txt", 0, "flask", "0.1"),
            ("r", "a/requirements.txt", "requirements.txt", 5, "flask", ""), ("r", "z/poetry.lock", "poetry.lock", 1, "jinja2", "1")]
    df = spark.createDataFrame(rows, "repo string, path string, manifest string, pos int, name string, version string")
    got = {r.name: (r.version, r.manifest, r.pos) for r in dep.dedup_packages(df.repartition(3)).collect()}
    assert got == {"flask": ("", "requirements.txt", 0), "jinja2": ("1", "poetry.lock", 1)}
    assert dep.dependency_count(df).collect()[0].dependency_count == 2


def test_report_and_two_step_operators_agree(spark):
    files = spark.createDataFrame(
        [("r", "requirements.txt", False, 10, "django==2.1\nvue==1.0\nflask==1.1.5"),
         ("r", "node_modules/package.json", False, 10, '{"dependencies": {"ws": "1.0.0"}}')],
        "repo string, path string, is_link boolean, size bigint, content string")
    got = {r.package: r.cve for r in dependency_report(files).collect()}
    assert got == {"django": "CVE-2022-28346", "vue": "N/A", "flask": "N/A"}
    deps = spark.createDataFrame([("r", "django", "2.1"), ("r", "vue", "1.0")], "repo string, name string, version string")
    cves = dep.advisory_match(deps, dep.advisories_table(spark))
    assert [r.package for r in dep.eol_match(deps, dep.eol_table(spark), cves).collect()] == ["vue"]
