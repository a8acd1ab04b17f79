"""Large advisory tables against a plain search of every advisory."""

import random
import re

from pyspark.sql import functions as F

from ironquill.operators import advisory_sweep as sweep
from ironquill.operators import dependencies as dep
from ironquill.rules.advisories import ADVISORIES

SCHEMA = "name string, ord bigint, max_version string, severity string, cve string, description string"


def numbers(version):
    return [int(n) for n in re.findall(r"\d+", version)] or [0]


def test_sweep_equals_the_plain_search(spark):
    rng = random.Random(3)

    def version():
        return rng.choice(["", "v"]) + ".".join(str(rng.randrange(12)) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "-rc", ".0"])

    known = [(rng.choice("aaab"), o, version(), "LOW", f"CVE-{o}", "d.") for o in rng.sample(range(10**6), 500)]
    odd = [(None, 1, "9", "LOW", "x", "d."), ("c", None, "9", "LOW", "x", "d."), ("c", 5, None, "LOW", "x", "d."), ("d", 2, "none", "LOW", "zero", "d.")]
    asked = [(f"r{i}", rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([version(), "", "latest", None]), i) for i in range(600)]
    deps = spark.createDataFrame(asked, "repo string, name string, version string, _range int").repartition(3)
    got = {r["repo"]: (r["package"], r["version"], r["cve"], r["_range"]) for r in sweep.advisory_match_many(deps, spark.createDataFrame(known + odd, SCHEMA)).collect()}
    want = {}
    for repo, name, v, i in asked:
        fit = [(a[1], a[4]) for a in [*known, odd[3]] if v and a[0] == name and numbers(v) <= numbers(a[2])]
        if fit:
            want[repo] = (name, v, min(fit)[1], i)
    assert got == want and len(want) > 100


def test_built_in_advisories_agree(spark):
    rows = [(a.name, i, a.max_version, a.severity, a.cve, a.description) for i, a in enumerate(ADVISORIES)]
    deps = spark.createDataFrame([("r", a.name, v) for a in ADVISORIES for v in (a.max_version, "0.1", "999", a.max_version + ".1")],
                                 "repo string, name string, version string")
    many = sweep.advisory_match_many(deps, spark.createDataFrame(rows, SCHEMA))
    few = dep.advisory_match(deps, dep.advisories_table(spark))
    assert sorted(map(str, many.collect())) == sorted(map(str, few.select(many.columns).collect()))


def test_one_package_with_many_advisories(spark):
    known = spark.range(100_000).select(
        F.lit("hot").alias("name"), F.col("id").alias("ord"), F.concat((F.col("id") / 1000).cast("int").cast("string"), F.lit("."), (F.col("id") % 1000).cast("string")).alias("max_version"),
        F.lit("LOW").alias("severity"), F.concat(F.lit("CVE-"), F.col("id").cast("string")).alias("cve"), F.lit("d.").alias("description"))
    deps = spark.range(0, 100_000, 7).select(F.col("id").cast("string").alias("repo"), F.lit("hot").alias("name"),
                                             F.concat((F.col("id") / 1000).cast("int").cast("string"), F.lit("."), (F.col("id") % 1000).cast("string")).alias("version"))
    found = sweep.advisory_match_many(deps, known)
    assert found.filter(F.col("cve") == F.concat(F.lit("CVE-"), "repo")).count() == found.count() == deps.count()
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_empty_tables(spark):
    none, deps = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("r", "a", "1")], "repo string, name string, version string")
    assert sweep.advisory_match_many(deps, none).count() == 0 and sweep.advisory_match_many(deps.limit(0), none).count() == 0


def test_widest_prefix_covers_the_others(spark):
    rows = [("a", [1, 5]), ("a", [1]), ("b", [1, 5]), ("b", [2]), ("b", [1, 9]), ("c", [3, 1]), ("c", [3, 0]), ("d", None)]
    got = {r["name"]: r["prefix"] for r in sweep.widest_prefixes(spark.createDataFrame(rows, "name string, prefix array<bigint>")).collect()}
    assert got == {"a": [1], "b": [2], "c": [3, 1]}
