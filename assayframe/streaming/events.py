"""Event-log operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assayframe.functions import fixed


def read_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def with_event_time(stream: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """Watermarks need a zoned timestamp; zone-less ones are read in the session zone (UTC)."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def lifecycle_stream(audit: DataFrame, key: str = "assessment_id") -> DataFrame:
    """Latest event per assessment, for the update output mode. State is one row per assessment."""
    at = F.struct("event_timestamp", "log_id")
    return audit.groupBy(key).agg(F.max_by("event_type", at).alias("last_event"), F.max("event_timestamp").alias("last_at"),
                                  F.count(F.lit(1)).alias("events"))


def closed_runs(audit: DataFrame, key: str = "assessment_id", idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """One row per run: the events of one assessment with at most `idle` between neighbours.

    On a stream (append mode) a run is told once, when the watermark has passed its end, and leaves the state; rows that come
    after that are dropped. So state holds open runs only, however many assessments there were. On a table all runs are told. Events without
    time are left out; events without assessment are runs of their own key."""
    timed = with_event_time(audit, "event_timestamp", late) if audit.isStreaming else audit.withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    at, kind = F.struct("event_timestamp", "log_id"), F.col("event_type")
    when = lambda test: F.min(F.when(test, F.col("event_timestamp")))
    runs = timed.groupBy(F.session_window("event_timestamp", idle).alias("w"), F.col(key)).agg(
        F.count(F.lit(1)).alias("events"), F.max_by("event_type", at).alias("last_event"), F.max("event_timestamp").alias("last_at"),
        when(kind == "assessment_submitted").alias("submitted_at"), when(kind == "assessment_started").alias("started_at"),
        when(kind.isin("assessment_complete", "assessment_failed")).alias("ended_at"))
    return runs.select(key, F.col("w.start").alias("opened_at"), "last_at", "last_event", "events", "submitted_at", "started_at", "ended_at")


def quality_counters(stream: DataFrame, at: str, value: str, by: list[str], low: float | None = None, high: float | None = None,
                     window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, missing values and range violations per event-time window."""
    timed = with_event_time(stream, at, late) if stream.isStreaming else stream.withColumn(at, F.col(at).cast("timestamp"))
    v = F.col(value)
    bad = F.lit(False)
    if low is not None:
        bad = bad | (v < low)
    if high is not None:
        bad = bad | (v > high)
    agg = timed.groupBy(F.window(at, window).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.count_if(bad).alias("violations"))
    return agg.select(F.col("w.start").alias("window_start"), *by, "rows", "missing", "violations")


def throttle_stream(events: DataFrame, key: str, at: str, limit: int = fixed.ATTEMPT_LIMIT,
                    seconds: int = fixed.ATTEMPT_WINDOW_SECONDS, late: str = "10 minutes") -> DataFrame:
    """(key, event_time, attempt): attempts over the limit as they arrive.

    State per key is the opening time and count of its current window; it is dropped when the
    watermark passes the window. Rows of a batch are handled in time order."""
    kind = events.schema[key].dataType.simpleString()
    span = seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = sorted(t for b in batches for t in b["t"])
        opened, count = state.get if state.exists else (None, 0)
        over = []
        for t in times:
            if opened is None or t >= opened + span:
                opened, count = t, 0
            count += 1
            if count > limit:
                over.append((k[0], t, count))
        if opened is not None:
            state.update((opened, count))
            state.setTimeoutTimestamp(max((opened + span) // 1000, state.getCurrentWatermarkMs() + 1))
        if over:
            yield pd.DataFrame(over, columns=["k", "t", "attempt"])

    timed = with_event_time(events.select(key, at), at, late)
    rows = timed.select(F.col(key).alias("k"), F.unix_micros(at).alias("t"), at)
    out = rows.groupBy("k").applyInPandasWithState(step, f"k {kind}, t bigint, attempt int", "opened bigint, count int", "append",
                                                   GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("k").alias(key), F.timestamp_micros("t").alias("event_time"), "attempt")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drain everything available into Parquet; in update mode each batch is stored with its number."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        def store(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_no={number}")

        query = writer.foreachBatch(store).start()
    query.awaitTermination()


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Final value of every key from stored update batches."""
    others = [c for c in updates.columns if c not in keys and c != "batch_no"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_no").alias("_v")).select(*keys, "_v.*")


def append_audit(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append-only copy of the audit stream, partitioned by day."""
    query = (stream.withColumn("event_date", F.to_date("event_timestamp")).writeStream.outputMode("append").format("parquet")
             .partitionBy("event_date").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
