"""A stored substring index over CVE descriptions.

A folded description is cut into its distinct runs of three code points.  The
table of (run, id) lies sorted by run below folders dealt by the first two
code points of a run, so that a search reads the postings that it needs and
no others.  Runs that many descriptions hold are split over files by id.

A search intersects the postings of its rarest runs and verifies the whole
query in the whole descriptions that are left: the result is the scan's.

Many searches at once look among the newest CVEs first; a query that finds
enough there is settled, and only the others go on to all postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..rules.plan_limits import CVE_QUERY_MAX_CHARS, CVE_QUERY_MIN_CHARS
from ..session import keep_result, spread
from .cve import DESCRIPTION_CHARS, V1_DESCRIPTION_CHARS, clean_query
from .sliced import first_rows

RUN = 3
BUCKETS = 64
#: Postings that a search intersects; the others of its runs are left to verification.
INTERSECTED = 3
#: Files over which a bucket's postings are dealt by id.
PARTS = 8
#: About so many of the newest CVEs are searched before all are, where there are more than ``AHEAD_X`` times as many.
AHEAD, AHEAD_X, CUT_SAMPLE = (4_096, 65_536, 1_048_576), 4, 4_096


def _runs(folded: Column) -> Column:
    """Distinct runs of three code points; the mark at the end lets every two code points begin one."""
    return F.array_distinct(F.regexp_extract_all(F.concat(folded, F.lit("\0")), F.lit(f"(?s)(?=(.{{{RUN}}}))."), F.lit(1)))


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(run, 1, RUN - 1)), F.lit(BUCKETS)).cast("int")


def write_cve_index(cves: DataFrame, path: str) -> None:
    """Store ``cves`` (id, published, whole description, any others), the postings and their lengths under ``path``.

    Rows without a description are stored and never found.  A repeated id is
    one posting and each of its rows is verified.
    """
    cves.write.parquet(f"{path}/cves")
    spark = cves.sparkSession
    stored = spark.read.schema(cves.schema).parquet(f"{path}/cves")
    runs = spread(stored).select("id", F.explode(_runs(F.lower("description"))).alias("run")).select(_bucket(F.col("run")).alias("bucket"), "run", "id")
    # Dealt by hash: ranges would be chosen by a first pass over all runs.
    (runs.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(PARTS))).sortWithinPartitions("bucket", "run", "id")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    lengths = _postings(spark, path).groupBy("bucket", "run").agg(F.count(F.lit(1)).alias("n"))
    (lengths.repartition("bucket").sortWithinPartitions("bucket", "run")
     .write.partitionBy("bucket").parquet(f"{path}/lengths"))


def _cves(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/cves")


def _postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run string, id string, bucket int").parquet(f"{path}/postings")


def _lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run string, n bigint, bucket int").parquet(f"{path}/lengths")


def _held(df: DataFrame, runs: list[str]) -> DataFrame:
    """Rows of these runs; the folders follow from literals, so others are not listed."""
    return df.filter(F.col("bucket").isin(*[_bucket(F.lit(r)) for r in runs]) & F.col("run").isin(*runs))


def search_cve_index(spark: SparkSession, path: str, query: str | None, k: int = 3) -> DataFrame:
    """The ``k`` newest CVEs whose whole description contains the query, whole; none for a query that is too short."""
    q, cves = clean_query(query), _cves(spark, path)
    if q is None:
        return cves.filter(F.lit(False))
    q, postings = q.lower(), _postings(spark, path)
    if len(q) < RUN:
        ids = postings.filter((F.col("bucket") == _bucket(F.lit(q))) & F.startswith("run", F.lit(q))).select("id").distinct()
    else:
        runs = sorted({q[i : i + RUN] for i in range(len(q) - RUN + 1)})
        known = _held(_lengths(spark, path), runs).orderBy("n", "run").collect()  # a row per run of the query
        rare = [r["run"] for r in known][:INTERSECTED]
        if len(known) < len(runs):
            return cves.filter(F.lit(False))
        ids = _held(postings, rare).groupBy("id").agg(F.count_distinct("run").alias("_n")).filter(F.col("_n") == len(rare)).select("id")
    found = cves.alias("c").join(ids.alias("i"), F.col("c.id").eqNullSafe(F.col("i.id")), "left_semi")
    return found.filter(F.contains(F.lower("description"), F.lit(q))).orderBy(F.col("published").desc(), "id").limit(k)


def _cut(cves: DataFrame, newest: int):
    """``published`` and ``id`` of a CVE that about ``newest`` others precede, newest first; a hashed sample sets it."""
    every = max(1, newest // CUT_SAMPLE)
    some = cves.select("published", "id").filter(
        F.col("published").isNotNull() & F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0))
    return some.orderBy(F.col("published").desc(), "id").limit(max(1, newest // every)).orderBy("published", F.col("id").desc()).first()


def _not_after(cut) -> Column:
    """Rows up to the cut in the order of results: newest first, then by id, null ids before others."""
    return F.coalesce((F.col("published") > cut["published"]) | (
        (F.col("published") == cut["published"]) & (F.col("id").isNull() | (F.col("id") <= cut["id"]))), F.lit(False))


def _verified(wanted: DataFrame, postings: DataFrame, cves: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` newest of ``cves`` per query of ``wanted`` (``_q``, ``_need`` runs, ``run``), from postings that hold the runs."""
    met = (wanted.join(postings, keys).groupBy("_q", "_need", "id").agg(F.count_distinct("run").alias("_n"))
           .filter(F.col("_n") >= F.col("_need")).select("_q", "id"))
    found = met.join(cves.withColumnRenamed("id", "_id"), F.col("id").eqNullSafe(F.col("_id"))).filter(
        F.contains(F.lower("description"), F.col("_q"))).drop("_id")
    return first_rows(found, ["_q"], [F.col("published").desc(), "id"], k).select("_q", "rank", *cves.columns)


def search_cves(index: str, queries: DataFrame, k: int = 3, query: str = "query", ahead=AHEAD) -> DataFrame:
    """For every distinct query: its ``k`` newest CVEs, with their ``rank``; all columns of the stored CVEs.

    Each query is cut and folded as a single search does; null and short ones
    find nothing.  A query meets only the postings of its rarest runs: first
    those of the newest CVEs, in sets of about ``ahead`` rows, and those of all
    CVEs if fewer than ``k`` are found there.
    """
    spark = queries.sparkSession
    cut = F.substring(strip(F.col(query)), 1, CVE_QUERY_MAX_CHARS)
    asked = (queries.select(F.col(query).alias("query"), F.lower(cut).alias("_q")).distinct()
             .filter(F.char_length("_q") >= CVE_QUERY_MIN_CHARS))
    lengths, postings = _lengths(spark, index), _postings(spark, index)
    short = F.char_length("_q") < RUN

    own = F.array_distinct(F.regexp_extract_all(F.col("_q"), F.lit(f"(?s)(?=(.{{{RUN}}}))."), F.lit(1)))
    runs = (asked.filter(~short).select("_q").distinct().withColumn("_all", F.size(own)).select("_q", "_all", F.explode(own).alias("run"))
            .withColumn("bucket", _bucket(F.col("run"))).join(lengths, ["bucket", "run"]))
    # A query has at most a hundred runs; one of them in no description settles it.
    rare = (runs.groupBy("_q", "_all").agg(F.array_sort(F.collect_list(F.struct("n", "run"))).alias("_r")).filter(F.size("_r") == F.col("_all"))
            .select("_q", F.slice("_r", 1, INTERSECTED).alias("_r")).select("_q", F.size("_r").alias("_need"), F.explode("_r.run").alias("run")))
    pairs = (asked.filter(short).select("_q").distinct().withColumn("bucket", _bucket(F.col("_q"))).alias("a")
             .join(lengths.select("bucket", "run", F.substring("run", 1, RUN - 1).alias("_two")).alias("l"),
                   (F.col("a.bucket") == F.col("l.bucket")) & (F.col("_q") == F.col("_two")))
             .select("_q", F.lit(1).alias("_need"), "run"))
    cves = _cves(spark, index)
    total = cves.count()
    ahead = [n for n in ahead if n * AHEAD_X < total]
    wanted = rare.unionByName(pairs).withColumn("bucket", _bucket(F.col("run")))
    wanted, settled = (keep_result(wanted) if ahead else wanted), []
    for n in ahead:
        if (cut := _cut(cves, n)) is None:
            continue
        newest = spread(cves.filter(_not_after(cut)))
        held = newest.select("id", F.explode(_runs(F.lower("description"))).alias("run"))
        found = keep_result(_verified(wanted, held, newest, ["run"], k))
        enough = found.filter(F.col("rank") == k).select("_q")
        settled.append(found.join(enough, "_q", "left_semi"))
        wanted = keep_result(wanted.join(enough, "_q", "left_anti"))
        if wanted.isEmpty():
            break
    best = _verified(wanted, postings, cves, ["bucket", "run"], k)
    for found in settled:
        best = best.unionByName(found)
    return asked.join(best, "_q").select("query", "rank", *cves.columns)


def v1_result(found: DataFrame) -> DataFrame:
    """The older search's columns: id, the description's first 300 characters, cvss (of version 3.1 where so flattened)."""
    kept = [c for c in ("query", "rank") if c in found.columns]
    return found.select(*kept, "id", F.substring("description", 1, V1_DESCRIPTION_CHARS).alias("description"), F.col("cvss_score").alias("cvss"))


def v2_result(found: DataFrame) -> DataFrame:
    return found.withColumn("description", F.substring("description", 1, DESCRIPTION_CHARS))
