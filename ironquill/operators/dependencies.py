"""Declared packages -> one version per repository -> advisory findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.small import small_table
from ..functions.text import first_match, number_key, version_parse
from ..rules.advisories import ADVISORIES, EOL_PREFIXES
from ..rules.scan_limits import MANIFESTS

CATEGORY = "Dependency Vulnerability"
FIELDS = ("title", "type", "category", "package", "version", "severity", "description", "fix", "cve", "match")


def advisories_table(spark: SparkSession, advisories=ADVISORIES) -> DataFrame:
    """One row per package with its advisories in precedence order.

    Keeping a package's rows together makes the lookup a one-to-one join: no
    row multiplies and nothing has to be regrouped afterwards.
    """
    by_name: dict[str, list] = {}
    for a in advisories:
        by_name.setdefault(a.name, []).append((a.max_version, a.severity, a.cve, a.description))
    raw = small_table(
        spark, list(by_name.items()),
        "name string, advisories array<struct<max_version:string,severity:string,cve:string,description:string>>")
    limit = F.transform("advisories", lambda a: F.struct(
        version_parse(a["max_version"]).alias("max_v"), a["max_version"].alias("max_version"),
        a["severity"].alias("severity"), a["cve"].alias("cve"), a["description"].alias("description")))
    return raw.select("name", limit.alias("advisories"))


def eol_table(spark: SparkSession, prefixes=EOL_PREFIXES) -> DataFrame:
    return small_table(spark, [(n, list(p)) for n, p in prefixes], "name string, prefix array<bigint>")


def manifest_priority(manifest: Column) -> Column:
    return first_match([(manifest == m, F.lit(i)) for i, m in enumerate(MANIFESTS)], F.lit(99))


def dedup_in_manifest(declared: DataFrame) -> DataFrame:
    """Per file and package: place of the first mention, version of the last."""
    return declared.groupBy("repo", "path", "manifest", "name").agg(
        F.min("pos").alias("pos"), F.max_by("version", "pos").alias("version"))


def dedup_packages(declared: DataFrame) -> DataFrame:
    """Per repository and package: the first manifest in priority and path order wins.

    It wins even if it pins no version.  Takes raw declared rows as well as
    deduplicated ones: within a file the last mention decides, so one
    aggregation by (repo, name) serves both and needs only one shuffle.
    """
    at = F.struct(manifest_priority(F.col("manifest")).alias("priority"), F.col("path"))
    # Smallest (priority, path), then largest position: the order key negates the position.
    order = F.struct(at["priority"].alias("a"), F.col("path").alias("b"), (-F.col("pos")).alias("c"))
    first = F.struct(at["priority"].alias("priority"), F.col("path").alias("path"), F.col("pos").alias("pos"))
    return declared.groupBy("repo", "name").agg(
        F.min_by(F.struct("path", "manifest", "version"), order).alias("_w"), F.min(first).alias("_f")).select(
        "repo", "name", F.col("_w.version").alias("version"), F.col("_w.path").alias("path"),
        F.col("_w.manifest").alias("manifest"), F.col("_f.priority").alias("priority"), F.col("_f.pos").alias("pos"))


def dependency_count(declared: DataFrame) -> DataFrame:
    """Distinct package names per repository over all manifests."""
    return declared.select("repo", "name").distinct().groupBy("repo").agg(
        F.count(F.lit(1)).alias("dependency_count"))


def distinct_deps(*declared: DataFrame) -> DataFrame:
    """Set union of (repo, name)."""
    names = [d.select("repo", "name") for d in declared]
    out = names[0]
    for other in names[1:]:
        out = out.unionByName(other)
    return out.distinct()


def _keep(deps: DataFrame) -> list[str]:
    return [c for c in deps.columns if c not in ("name", "version")]


def _pinned(deps: DataFrame) -> DataFrame:
    return deps.filter(F.col("version") != "").withColumn("_v", version_parse(F.col("version")))


def _cve_struct() -> Column:
    hit = F.get(F.filter("advisories", lambda a: F.col("_v") <= a["max_v"]), 0)
    name, version = F.col("name"), F.col("version")
    return F.when(hit.isNotNull(), F.struct(
        F.lit("Vulnerable Dependency").alias("title"), F.lit("Vulnerable Dependency").alias("type"),
        F.lit(CATEGORY).alias("category"), name.alias("package"), version.alias("version"),
        hit["severity"].alias("severity"),
        F.concat(hit["description"], F.lit(" Affects versions <= "), hit["max_version"], F.lit(".")).alias(
            "description"),
        F.concat(F.lit("Upgrade "), name, F.lit(" to a version newer than "), hit["max_version"], F.lit(".")).alias(
            "fix"),
        hit["cve"].alias("cve"), F.concat(name, F.lit("=="), version).alias("match")))


def _eol_struct() -> Column:
    name, version = F.col("name"), F.col("version")
    return F.struct(
        F.lit("Outdated Dependency").alias("title"), F.lit("Outdated Dependency").alias("type"),
        F.lit(CATEGORY).alias("category"), name.alias("package"), version.alias("version"),
        F.lit("LOW").alias("severity"),
        F.concat(name, F.lit(" "), version,
                 F.lit(" is an end-of-life or significantly outdated major version.")).alias("description"),
        F.concat(F.lit("Upgrade "), name, F.lit(" to a currently supported major version.")).alias("fix"),
        F.lit("N/A").alias("cve"), F.concat(name, F.lit("=="), version).alias("match"))


def _is_eol() -> Column:
    known = F.transform("prefix", lambda n: number_key(n.cast("string")))
    return F.slice(F.col("_v"), F.lit(1), F.size("prefix")) <= known


def found_advisories(known: DataFrame) -> DataFrame:
    """Findings of packages that have their ``advisories`` beside them, in precedence order."""
    keep = [c for c in _keep(known) if c != "advisories"]
    return (_pinned(known).select(*keep, _cve_struct().alias("_f"))
            .filter(F.col("_f").isNotNull()).select(*keep, "_f.*"))


def advisory_match(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """First advisory whose last vulnerable version is not below the package's."""
    return found_advisories(deps.join(advisories, "name").select(*deps.columns, "advisories"))


def eol_match(deps: DataFrame, eol: DataFrame, cve_findings: DataFrame) -> DataFrame:
    """End-of-life prefixes, for packages that have no advisory finding."""
    keep = _keep(deps)
    flagged = cve_findings.select("repo", F.col("package").alias("name")).distinct()
    return (_pinned(deps).join(eol, "name").filter(_is_eol()).join(flagged, ["repo", "name"], "left_anti")
            .select(*keep, _eol_struct().alias("_f")).select(*keep, "_f.*"))


def checked_packages(deps: DataFrame, advisories: DataFrame | None = None,
                     eol: DataFrame | None = None) -> DataFrame:
    """Every package with its finding, if any, as a nullable struct.

    A package has at most one finding, so both small tables are looked up side
    by side: no row multiplies and no anti join over the findings is needed.
    """
    spark = deps.sparkSession
    advisories = advisories_table(spark) if advisories is None else advisories
    eol = eol_table(spark) if eol is None else eol
    known = (deps.withColumn("_v", version_parse(F.col("version"))).join(advisories, "name", "left")
             .join(eol, "name", "left"))
    old = F.when(F.col("prefix").isNotNull() & _is_eol(), _eol_struct())
    found = F.when(F.col("version") != "", F.coalesce(F.when(F.col("advisories").isNotNull(), _cve_struct()), old))
    return known.select(*deps.columns, found.alias("finding"))


def dependency_findings(deps: DataFrame, advisories: DataFrame | None = None,
                        eol: DataFrame | None = None) -> DataFrame:
    """Advisory and end-of-life findings of deduplicated packages."""
    return checked_packages(deps, advisories, eol).filter(F.col("finding").isNotNull()).select(
        *_keep(deps), "finding.*")


DEP_ORDER = ("priority", "path", "pos", "package")
