"""Sinks.  A replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules.plan_limits import LOG_VALUE_CHARS
from ..session import keep_result
from . import manifest_table


def sink_scan_results(scans: DataFrame, path: str) -> None:
    """Append scan rows (``created_at`` and any nested result), partitioned by scan date."""
    (scans.withColumn("scan_date", F.to_date("created_at"))
     .write.mode("append").partitionBy("scan_date").parquet(path))


def scan_rows(summary: DataFrame, user_id: str | None, created_at) -> DataFrame:
    """Scan summaries as rows of the scans table, with the result as JSON text."""
    body = F.to_json(F.struct(*[c for c in summary.columns if c not in ("repo", "user_id")]))
    return summary.select(
        F.sha2(F.concat_ws("|", F.col("repo"), F.lit(str(created_at))), 256).alias("id"),
        F.lit(user_id).alias("user_id"), F.col("repo").alias("source"), "risk_level", "total_secrets",
        body.alias("result_json"), F.lit(str(created_at)).cast("timestamp").alias("created_at"))


USAGE_SCHEMA = "user_id string, org_id string, date date, request_count bigint"


def sink_upsert_usage(path: str, feed: str | None = None):
    """foreachBatch writer of request events: one row per user and day, added to what is there.

    Only the days that a batch touches are rewritten, into a folder of their
    own; a manifest then names it together with the batch.  A batch that the
    manifest has is left out, so a replay counts nothing twice, and a crash
    before the commit leaves the table as it was.  ``feed`` names the run, by
    default the streaming query; another one, as a new checkpoint makes, reads
    its source from the beginning, so the table begins anew with it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = feed or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
        before = manifest_table.current(spark, path)
        if before["query"] == run and before["batch"] >= batch_id:
            return
        if before["query"] != run:
            before = dict(manifest_table.EMPTY)
        added = keep_result(batch.groupBy("user_id", F.to_date("ts").alias("date")).agg(
            F.max("org_id").alias("org_id"), F.count(F.lit(1)).alias("request_count")))
        days = {str(r["date"]) for r in added.select("date").distinct().collect()}
        old = manifest_table.folders(before, days)
        rows = added.unionByName(spark.read.schema(USAGE_SCHEMA).parquet(*old)) if old else added
        merged = rows.groupBy("user_id", "date").agg(F.max("org_id").alias("org_id"), F.sum("request_count").alias("request_count"))
        out = f"{path}/data/{run}-{batch_id}"
        merged.withColumn("day", F.coalesce(F.col("date").cast("string"), F.lit("None"))).write.mode("overwrite").partitionBy("day").parquet(out)
        manifest_table.commit(spark, path, {"query": run, "batch": batch_id, "partitions": {
            **before["partitions"], **{day: f"{out}/day={day}" for day in days}}})

    return write


def usage_view(spark: SparkSession, path: str) -> DataFrame:
    return manifest_table.read_table(spark, path, USAGE_SCHEMA).select("user_id", "date", "org_id", "request_count")


def sink_latest_state(task_events: DataFrame) -> DataFrame:
    """Current row of each task from its event log; the last update decides.

    A field that an update leaves null keeps its earlier value.
    """
    fields = [c for c in task_events.columns if c not in ("id", "updated_at")]
    return task_events.groupBy("id").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("updated_at"))).alias(c) for c in fields],
        F.max("updated_at").alias("updated_at"))


def log_rows(events: DataFrame, keep=("user_id", "action", "created_at")) -> DataFrame:
    """Audit rows: every other value as text, cut to 500 characters; empty becomes null."""
    def cut(c):
        return F.nullif(F.substring(F.col(c).cast("string"), 1, LOG_VALUE_CHARS), F.lit("")).alias(c)

    return events.select(*[F.col(c) if c in keep else cut(c) for c in events.columns])


def sink_append_log(events: DataFrame, path: str) -> None:
    log_rows(events).write.mode("append").parquet(path)
