"""Size and safety limits on archives and repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_dirs
from ..rules.scan_limits import MAX_ARCHIVE_BYTES, MAX_FILES, MAX_REPO_BYTES, SCAN_SKIP_DIRS


def _grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def leaves_root(member: Column) -> Column:
    """True if the member's path is absolute or climbs above the root."""
    depth = F.aggregate(
        F.split(member, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"),
            F.least(acc["low"], acc["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")),
        lambda acc: acc["low"])
    return F.startswith(member, F.lit("/")) | (depth < 0)


def archive_guard(members: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """One row per archive with its totals, ``ok`` and the first reason."""
    unsafe = leaves_root(F.col("member"))
    agg = members.groupBy("archive").agg(
        F.count(F.lit(1)).alias("members"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.min(F.when(unsafe, F.col("member"))).alias("_unsafe"))
    reason = (F.when(F.col("members") > max_files, F.concat(
                  F.lit("ZIP contains too many files ("), _grouped(F.col("members")),
                  F.lit(f"). Limit is {max_files:,}.")))
              .when(F.col("total_bytes") > max_bytes,
                    f"ZIP uncompressed size exceeds {max_bytes // 1048576} MB limit.")
              .when(F.col("_unsafe").isNotNull(),
                    F.concat(F.lit("Unsafe path in ZIP (path traversal): "), F.col("_unsafe"))))
    return agg.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull()).drop("_unsafe")


def repo_size_guard(files: DataFrame, max_files: int = MAX_FILES, max_bytes: int = MAX_REPO_BYTES) -> DataFrame:
    """One row per repository; links and skipped directories do not count."""
    counted = ~F.col("is_link") & ~in_dirs(F.col("path"), SCAN_SKIP_DIRS)
    agg = files.groupBy("repo").agg(
        F.count_if(counted).alias("files"),
        F.coalesce(F.sum(F.when(counted, F.col("size"))), F.lit(0)).alias("total_bytes"))
    reason = (F.when(F.col("files") > max_files, f"Repository exceeds {max_files:,} file limit.")
              .when(F.col("total_bytes") > max_bytes, f"Repository exceeds {max_bytes // 1048576} MB size limit."))
    return agg.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())
