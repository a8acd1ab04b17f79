"""Tables and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CVE_SCHEMA = (
    "cve struct<id:string,published:string,descriptions:array<struct<value:string>>,"
    "metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double>>>,"
    "cvssMetricV30:array<struct<cvssData:struct<baseScore:double>>>,"
    "cvssMetricV2:array<struct<cvssData:struct<baseScore:double>>>>,"
    "configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string>>>>>>,"
    "references:array<struct<url:string>>>")


def src_tables(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A keyed table; filters, column choice and limits on it reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def src_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds=None,
             partitions: int = 1, **options: str) -> DataFrame:
    """A database table, read in parallel by ranges of a numeric ``key`` if bounds are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]),
                                numPartitions=str(partitions))
    return reader.load()


def _cve_lines(spark: SparkSession, path: str) -> DataFrame:
    schema = f"vulnerabilities array<struct<{CVE_SCHEMA.replace('cve ', 'cve:', 1)}>>, {CVE_SCHEMA}, _bad string"
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(path)


def cve_feed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``line``: the lines of a landed feed that are not such JSON, which :func:`src_cve_feed` leaves out."""
    bad = F.col("_bad").isNotNull() & F.col("cve").isNull() & F.col("vulnerabilities").isNull()
    return _cve_lines(spark, path).filter(bad).select(F.col("_bad").alias("line"))


def src_cve_feed(spark: SparkSession, path: str) -> DataFrame:
    """A landed feed: JSON lines of ``{"cve": ...}``, or pages with a ``vulnerabilities`` list."""
    pages = _cve_lines(spark, path)
    listed = pages.filter(F.col("vulnerabilities").isNotNull()).select(F.inline("vulnerabilities"))
    return pages.filter(F.col("cve").isNotNull()).select("cve").unionByName(listed)


def src_epss_feed(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Exploit probabilities: cve and epss as text."""
    reader = spark.read.schema("cve string, epss string")
    return reader.json(path) if fmt == "json" else reader.option("header", True).option("enforceSchema", False).csv(path)
