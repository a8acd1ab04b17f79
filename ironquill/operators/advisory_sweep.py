"""Advisories and end-of-life prefixes from tables of any size.

The lookup of :mod:`dependencies` keeps a package's advisories in one row.
Here they stay rows: advisories and the distinct versions asked about are
dealt into ranges by (package, version), and one sweep from high to low carries
the first advisory in precedence order.  A package of any number of advisories
lies in many ranges, and only one row per range and package is passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import number_key, version_parse
from ..session import checkpointed, keep_result
from .dependencies import found_advisories

KNOWN = ("max_version", "severity", "cve", "description")


def first_advisories(asked: DataFrame, advisories: DataFrame) -> DataFrame:
    """(name, version) of ``asked`` with ``advisories``: an array of the first advisory that covers it; others are left out.

    ``advisories``: name, ord (unique in a package), max_version, severity,
    cve, description.  Rows without a name, ord or max_version cover nothing;
    of equal ords the smaller text comes first.
    """
    first = F.struct("ord", F.struct(version_parse(F.col("max_version")).alias("max_v"), *KNOWN).alias("a")).alias("_first")
    # Of advisories with one bound, only the first in order can ever be the answer. Read twice, so kept.
    bounds = keep_result(advisories.filter("name is not null and ord is not null and max_version is not null")
              .select("name", version_parse(F.col("max_version")).alias("_v"), first)
              .groupBy("name", "_v").agg(F.min("_first").alias("_first")).withColumn("version", F.lit(None).cast("string")))
    wanted = asked.select("name", "version").filter("name is not null and version <> ''").distinct().withColumn("_v", version_parse(F.col("version")))
    wanted = wanted.join(bounds.select("name").distinct(), "name", "left_semi")
    rows = bounds.unionByName(wanted, allowMissingColumns=True).repartitionByRange("name", "_v").withColumn("_range", F.spark_partition_id())
    rows = checkpointed(rows)  # which row lies in which range must not change between its two readers
    above = Window.partitionBy("name").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    base = (rows.filter("_first is not null").groupBy("name", "_range").agg(F.min("_first").alias("_m"))
            .unionByName(rows.select("name", "_range").distinct(), allowMissingColumns=True)
            .groupBy("name", "_range").agg(F.min("_m").alias("_m"))
            .select("name", "_range", F.min("_m").over(above).alias("_base")))
    # Rows of one version are peers of a range frame, so a bound covers its own version.
    here = Window.partitionBy("name", "_range").orderBy(F.col("_v").desc())
    swept = rows.withColumn("_here", F.min("_first").over(here)).filter("version is not null").join(base, ["name", "_range"])
    return (swept.withColumn("_found", F.least("_here", "_base")).filter("_found is not null")
            .select("name", "version", F.array("_found.a").alias("advisories")))


def advisory_match_many(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """:func:`dependencies.advisory_match` for an advisory table of any size (columns as in :func:`first_advisories`)."""
    found = first_advisories(deps, advisories).withColumnsRenamed({"name": "_name", "version": "_version"})
    met = deps.join(found, (deps["name"] == F.col("_name")) & (deps["version"] == F.col("_version")))
    return found_advisories(met.drop("_name", "_version"))


def widest_prefixes(eol: DataFrame) -> DataFrame:
    """Of a package's prefixes the one that covers all that the others do: then :func:`dependencies.eol_match` meets one row."""
    bound = F.concat(F.transform("prefix", lambda n: number_key(n.cast("string"))), F.array(F.struct(F.lit(2**31 - 1).alias("digits"), F.lit("").alias("number"))))
    return eol.filter("prefix is not null").groupBy("name").agg(F.max_by("prefix", bound).alias("prefix"))
