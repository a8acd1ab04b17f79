"""Structured Streaming forms of the operators.

Late rows: a ten-minute watermark on ``ts``; rows behind it are dropped by
stateful operators and counted by :func:`late_rows`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.billing import STATE_COLUMNS, column_writes, event_keys
from ..operators.requests import limits_table, verdicts, with_rate_key, injection_filter
from ..operators.secrets import rule_hints, secret_match
from ..functions.text import redact
from ..rules.plan_limits import EV_ACTIVATED, EV_CHECKOUT, RATE_WINDOW_SECONDS
from ..rules.secret_rules import SECRET_RULES
from ..sources.files import scan_files, src_lines
from ..sources.sinks import log_rows, sink_upsert_usage
from .stateful import HELD_REQUESTS, Answers, LastWrites, Moves, RateWindows, use_rocksdb

WATERMARK = "10 minutes"


def stream_rate_limit(requests: DataFrame, limits: DataFrame | None = None,
                      window: int = RATE_WINDOW_SECONDS, held: int = HELD_REQUESTS) -> DataFrame:
    """Verdicts for a request stream; the state per (ip, bucket) is window start and count.

    Requests of one trigger are judged in time order per key, at once: a
    verdict does not wait for the watermark.  :func:`late_rows` counts the
    requests behind it.
    """
    window_us = window * 1_000_000
    use_rocksdb(requests.sparkSession)
    limits = limits_table(requests.sparkSession) if limits is None else limits
    keyed = with_rate_key(requests.withColumn("ts", F.col("ts").cast("timestamp"))).withWatermark("ts", WATERMARK)
    rows = keyed.join(limits, "bucket", "left").select(
        "req_id", "ip", "bucket", "ts", F.unix_micros("ts").alias("t"), "max_requests")
    numbered = rows.groupBy("ip", "bucket").transformWithState(
        RateWindows(window_us, held), RateWindows.SCHEMA, "Append", "EventTime")
    return verdicts(numbered, window_us)


def late_rows(query) -> DataFrame:
    """``batch, operator, dropped``: rows behind the watermark that a query's stateful operators have dropped, per batch.

    From the progress that Spark keeps of the latest batches
    (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    rows = [(p.batchId, op.operatorName, op.numRowsDroppedByWatermark)
            for p in query.recentProgress for op in p.stateOperators if op.numRowsDroppedByWatermark]
    return SparkSession.active().createDataFrame(rows, "batch bigint, operator string, dropped bigint")


def stream_usage_daily(requests: DataFrame) -> DataFrame:
    """Requests per user and day; a day is final once the watermark has passed it."""
    return (requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", WATERMARK)
            .groupBy("user_id", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("request_count"))
            .select("user_id", F.to_date("window.start").alias("date"), "request_count"))


def stream_usage_open(requests: DataFrame, path: str, checkpoint: str):
    """Counts of every day as they stand, open days included: each batch writes the rows that it changed.

    A replay rewrites its own folder.  :func:`usage_now` reads the newest count of each user and day.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (stream_usage_daily(requests).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def usage_now(spark: SparkSession, path: str) -> DataFrame:
    """Counts only grow, so the largest is the newest."""
    return spark.read.parquet(path).groupBy("user_id", "date").agg(F.max("request_count").alias("request_count"))


def _first_matches(batches):
    """Matches as the scan finds them -> the first of each label and raw match in a file.

    A file's matches come one after the other in the order of their places;
    a place that is not later than the one before begins another file.
    """
    file, place, seen = None, None, set()
    for pdf in batches:
        first = []
        for own, at, match in zip(zip(pdf["repo"], pdf["path"]), zip(pdf["line"], pdf["rule_ord"], pdf["match_pos"]),
                                  zip(pdf["label"], pdf["match_key"])):
            if own != file or at <= place:
                file, seen = own, set()
            place = at
            first.append(match not in seen)
            seen.add(match)
        yield pdf[first]


def stream_secret_scan(files: DataFrame, rules=SECRET_RULES) -> DataFrame:
    """Stateless scan of arriving files; every file is whole, so each line is judged at once.

    Emits the first place of each label and raw match in a file, as
    :func:`dedup_matches` does.  ``match_key`` is a hash of the raw match,
    which itself is not emitted.
    """
    keys = ("repo", "path")
    lines = src_lines(scan_files(files).select(*keys, "content"), hints=rule_hints(rules))
    matches = secret_match(lines, rules).select(
        *keys, "label", "line", "rule_ord", "match_pos", redact(F.col("raw")).alias("match"),
        F.sha2("raw", 256).alias("match_key"))
    return matches.mapInPandas(_first_matches, "repo string, path string, label string, line int, rule_ord int, match_pos int, "
                                               "match string, match_key string")


def stream_injection_alerts(requests: DataFrame) -> DataFrame:
    """Only the hostile requests, with what the log keeps of them."""
    return injection_filter(requests).filter("flagged").select(
        "req_id", "ts", "path", F.substring("query", 1, 80).alias("query"))


def stream_audit_append(events: DataFrame, path: str, checkpoint: str):
    """Append audit rows as files; the checkpoint makes it exactly once."""
    return (log_rows(events).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def stream_usage_upsert(requests: DataFrame, path: str, checkpoint: str):
    return (requests.writeStream.foreachBatch(sink_upsert_usage(path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _last_of_batch(columns):
    """Writes -> per user of a batch, the rows with a column's last write or the last place: users with many events send few."""
    def run(batches):
        for pdf in batches:
            pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
            kept = ~pdf["user_id"].duplicated(keep="last")
            for c in columns:
                written = pdf.index[pdf[c].notna()]
                kept[written] |= ~pdf["user_id"][written].duplicated(keep="last")
            yield pdf[kept]

    return run


def subscription_updates(events: DataFrame, users: DataFrame) -> DataFrame:
    """The users that payment events change, as they stand after each trigger: ``id, last_seq`` and the state's columns.

    Three kinds of state: the subscription that a user holds, the holders of a
    subscription, and the last write of each of a user's columns.  The state
    has the holders that ``users`` names; what else is stored of a user is
    joined to the events and results at hand, so that users without any are
    never put into a state.
    """
    use_rocksdb(events.sparkSession)
    flat = event_keys(events).withColumn("ts", F.col("ts").cast("timestamp"))
    facts = list(Answers.FACTS)
    ids = users.select(F.col("id").alias("user_id"), F.nullif("paypal_subscription_id", F.lit("")).alias("stored"))
    held = users.select(F.col("id").alias("user_id"), F.nullif("paypal_subscription_id", F.lit("")).alias("subscription_id")).filter(
        F.col("subscription_id").isNotNull())
    direct = flat.filter("by_user").join(ids, F.col("ref_user") == F.col("user_id")).select("user_id", "stored", *facts)
    grants = direct.filter(F.col("event_type").isin(EV_ACTIVATED, EV_CHECKOUT)).select("user_id", "seq", "subscription_id", "stored")
    direct = direct.drop("stored")
    moves = grants.groupBy("user_id").transformWithState(Moves(), Moves.SCHEMA, "Append", "None")
    lines = moves.unionByName(flat.filter(~F.col("by_user")).select(*facts), allowMissingColumns=True)
    answered = lines.groupBy("subscription_id").transformWithState(
        Answers(), Answers.SCHEMA, "Append", "None", initialState=held.groupBy("subscription_id"))
    writes = direct.unionByName(answered).select("user_id", "seq", *[v.cast("string").alias(c) for c, v in column_writes().items()])
    writes = writes.mapInPandas(_last_of_batch(STATE_COLUMNS), writes.schema)
    stored = users.select(F.col("id").alias("_id"), *[
        (F.col(c) if c in users.columns else F.lit(None)).cast("string").alias(f"_s_{c}") for c in STATE_COLUMNS]).dropDuplicates(["_id"])
    last = LastWrites(STATE_COLUMNS)
    now = writes.groupBy("user_id").transformWithState(last, last.schema, "Append", "None")
    # A write is never null: null is a column that no event has written.
    return now.join(stored, F.col("id") == F.col("_id"), "left").select("id", "last_seq", *[
        F.coalesce(c, f"_s_{c}").alias(c) for c in STATE_COLUMNS])


def stream_subscription_state(events: DataFrame, users: DataFrame, path: str, checkpoint: str):
    """Keep the users' subscription state up to date from a payment event stream; :func:`state_now` reads it.

    Each trigger appends the users that it changed, exactly once; a restart
    goes on from the state in the checkpoint, and another checkpoint adds rows
    without touching earlier ones.  Events must not arrive earlier than already
    applied ones: sequence numbers rise across triggers.
    """
    return (subscription_updates(events, users).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def state_now(spark: SparkSession, path: str, users: DataFrame) -> DataFrame:
    """Users with their newest state: the row of the last event, or what is stored of a user without events."""
    last = LastWrites(STATE_COLUMNS)
    rows = spark.read.schema(last.schema).parquet(path)
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*STATE_COLUMNS), "last_seq").alias("_new"))
    kinds = {f.name: f.dataType for f in users.schema}
    stored = {c: F.col(c) if c in kinds else F.lit(None).cast("string") for c in STATE_COLUMNS}
    return users.join(newest, "id", "left").select("id", *[
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}").cast(kinds.get(c, "string"))).otherwise(stored[c]).alias(c)
        for c in STATE_COLUMNS])
