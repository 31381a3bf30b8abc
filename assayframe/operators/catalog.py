"""Catalog-wide analytics over stored results and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.operators import quantiles
from assayframe.session import stored

MAX_SCORES = 1001  # values of a score with one decimal in 0..100


def with_previous(df: DataFrame, key: str, order: list[str], values: list[str], chunk: Column | None = None) -> DataFrame:
    """Add prev_<value>: the values of the preceding row of the same key; rows without a key form one series.

    A plain window would sort all rows of a hot key in one task. Here rows are ordered inside
    (key, chunk); the last row of each chunk is an aggregate, and the first row of a chunk takes it
    from the chunk before. Chunks are ranges of (key, order) of about equal size, so a hot key spreads over many
    wherever its rows stand in time; a `chunk` of one's own must not decrease along `order`."""
    at = F.struct(*order)
    # the range cut samples its input before it reads it: stored first, so that nothing before it runs twice
    cut = stored(df, "series-rows").repartitionByRange(key, *order).withColumn("_chunk", F.spark_partition_id()) if chunk is None else df.withColumn("_chunk", chunk)
    rows = stored(cut, "series")  # two branches read it
    ends = rows.groupBy(F.col(key).alias("_of"), F.col("_chunk").alias("_part")).agg(F.max_by(F.struct(*values), at).alias("_end"))
    before = ends.select("_of", "_part", F.lag("_end").over(W.partitionBy("_of").orderBy("_part")).alias("_there"))
    inside = W.partitionBy(key, "_chunk").orderBy(*order)
    rows = rows.withColumn("_here", F.lag(F.struct(*values)).over(inside)).withColumn("_nth", F.row_number().over(inside))
    joined = rows.join(before, F.col(key).eqNullSafe(F.col("_of")) & F.col("_chunk").eqNullSafe(F.col("_part")), "left")
    prev = F.when(F.col("_nth") > 1, F.col("_here")).otherwise(F.col("_there"))
    return joined.select(*df.columns, *[prev[v].alias(f"prev_{v}") for v in values])


def score_deltas(results: DataFrame, key: str = "dataset_id", at: str = "submitted_at", tie: str = "assessment_id",
                 chunk: Column | None = None) -> DataFrame:
    """Change of cqi and prs against the assessment before it of the same dataset."""
    out = with_previous(results, key, [at, tie], ["cqi", "prs"], chunk)
    return out.withColumn("cqi_delta", F.round(F.col("cqi") - F.col("prev_cqi"), 1)).withColumn("prs_delta", F.col("prs") - F.col("prev_prs"))


def distribution(results: DataFrame, *by: str) -> DataFrame:
    """Count and mean index over every rollup level of the given columns; `level` is the grouping id."""
    return results.rollup(*by).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("datasets"),
                                   F.round(F.avg("cqi"), 4).alias("mean_cqi"), F.round(F.avg("prs"), 4).alias("mean_prs"))


def cross_distribution(results: DataFrame, *by: str) -> DataFrame:
    return results.cube(*by).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("datasets"),
                                 F.round(F.avg("cqi"), 4).alias("mean_cqi"))


def with_percent_rank(results: DataFrame, value: str = "cqi") -> DataFrame:
    """Add percent_rank of a score with one decimal in 0..100; rows without a score rank first, like the least value.

    Such a score has at most 1001 values, so the ranks are a literal map of that size and no row moves. A column with
    more distinct values is no such score and is refused; `numbering.with_ranks` ranks any column."""
    results = stored(results, "scores")  # two passes read it
    counts = results.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(value).asc_nulls_first()).limit(MAX_SCORES + 2).collect()
    if len(counts) > MAX_SCORES + 1:
        raise ValueError(f"{value} has more than {MAX_SCORES} distinct values; numbering.with_ranks has no such limit")
    total, less, ranks, none = sum(r["n"] for r in counts), 0, [], 0.0
    for r in counts:
        share = round(less / (total - 1), 6) if total > 1 else 0.0
        if r[value] is None:
            none = share
        else:
            ranks += [F.lit(r[value]).cast(results.schema[value].dataType), F.lit(share)]
        less += r["n"]
    if not ranks:
        return results.withColumn("percent_rank", F.lit(none))
    return results.withColumn("percent_rank", F.when(F.col(value).isNull(), none).otherwise(F.try_element_at(F.create_map(*ranks), F.col(value))))


def search(results: DataFrame, cqi_bands: list[str] | None = None, prs_bands: list[str] | None = None,
           classes: list[str] | None = None) -> DataFrame:
    for column, wanted in (("cqi_band", cqi_bands), ("prs_band", prs_bands), ("release_class", classes)):
        if wanted:
            results = results.where(F.col(column).isin(wanted))
    return results


def service_levels(audit: DataFrame, key: str = "assessment_id") -> DataFrame:
    """Failure rate, webhook failures and duration percentiles per hour of submission.

    Runs without a submission stand under hour NULL (`unsubmitted`); runs that end before they were submitted count in
    `reversed` and have no duration."""
    def first(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, F.col("event_timestamp")))

    runs = audit.groupBy(key).agg(first("assessment_submitted").alias("submitted"), first("assessment_complete").alias("complete"),
                                  first("assessment_failed").alias("failed"),
                                  F.count_if(F.col("event_type") == "webhook_failed").alias("unsent"))
    took = F.timestamp_diff("SECOND", "submitted", F.coalesce("complete", "failed"))
    runs = runs.withColumn("lag", took).withColumn("took", F.when(took >= 0, took.cast("double")))
    runs = stored(runs.withColumn("hour", F.date_trunc("hour", "submitted")), "runs")  # rates and durations read it
    counted = runs.where("took is not null").groupBy("hour", "took").agg(F.count(F.lit(1)).alias("cnt"))
    p95 = quantiles.grouped_quantiles(counted, ["hour"], "took", "cnt", {"p95_seconds": 0.95})
    whole = runs.groupBy("hour").agg(
        F.count(F.lit(1)).alias("runs"), F.count("failed").alias("failed"), F.round(F.count("failed") / F.count(F.lit(1)), 6).alias("failure_rate"),
        F.sum("unsent").alias("webhook_failures"), F.count_if(F.col("submitted").isNull()).alias("unsubmitted"),
        F.count_if(F.col("lag") < 0).alias("reversed"), F.max("took").cast("bigint").alias("longest_seconds"))
    return whole.join(p95.withColumn("p95_seconds", F.round("p95_seconds", 4)), "hour", "left")


# ---- lifecycle -------------------------------------------------------------------------

def lifecycle(audit: DataFrame, key: str = "assessment_id") -> DataFrame:
    """Latest event per assessment and the seconds spent queued and processing. One partial aggregation."""
    at = F.struct("event_timestamp", "log_id")

    def first(kind: str) -> Column:
        return F.min(F.when(F.col("event_type") == kind, F.col("event_timestamp")))

    agg = audit.groupBy(key).agg(
        F.max_by("event_type", at).alias("last_event"), F.max("event_timestamp").alias("last_at"), F.count(F.lit(1)).alias("events"),
        first("assessment_submitted").alias("submitted_at"), first("assessment_started").alias("started_at"),
        F.least(first("assessment_complete"), first("assessment_failed")).alias("ended_at"))
    return agg.select(
        key, "last_event", "last_at", "events", "submitted_at", "started_at", "ended_at",
        F.timestamp_diff("SECOND", "submitted_at", "started_at").alias("queue_seconds"),
        F.timestamp_diff("SECOND", "started_at", "ended_at").alias("processing_seconds"))


# ---- tamper-evident log ------------------------------------------------------------------

def _chain(items: Column) -> Column:
    return F.aggregate(items, F.lit(""), lambda acc, x: F.sha2(F.concat(acc, F.lit("|"), x["text"]), 256))


def chain_blocks(audit: DataFrame, key: str = "assessment_id", block: Column | None = None) -> DataFrame:
    """(key, block, entries, digest, chained): SHA-256 chain of the log of each assessment.

    Entries are chained inside a block (a day by default) and block digests are chained per assessment, so
    one busy assessment spreads over its blocks and is never gathered whole."""
    block = block if block is not None else F.to_date("event_timestamp")
    text = F.concat_ws("|", F.col("log_id").cast("string"), F.col("event_type"), F.unix_micros(F.col("event_timestamp").cast("timestamp")).cast("string"),
                       F.col("event_detail"))
    entry = F.struct(F.col("event_timestamp"), F.col("log_id"), text.alias("text"))
    blocks = audit.groupBy(F.col(key), block.alias("block")).agg(
        F.count(F.lit(1)).alias("entries"), _chain(F.array_sort(F.collect_list(entry))).alias("digest"))
    days = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "entries", "digest"))).alias("_days"))
    sums = F.aggregate("_days", F.array(F.lit("")), lambda acc, x: F.array_append(
        acc, F.sha2(F.concat(F.element_at(acc, -1), F.lit("|"), x["digest"]), 256)))
    linked = days.select(key, F.posexplode("_days").alias("_i", "_day"), sums.alias("_sums"))
    return linked.select(key, "_day.block", "_day.entries", "_day.digest", F.col("_sums")[F.col("_i") + 1].alias("chained"))


def verify_chain(audit: DataFrame, stored: DataFrame, key: str = "assessment_id", block: Column | None = None) -> DataFrame:
    """Blocks whose recomputed digest or chain differs from the stored one, or that are missing on one side."""
    now = chain_blocks(audit, key, block).select(key, "block", F.col("digest").alias("_d"), F.col("chained").alias("_c"))
    both = stored.select(key, "block", "digest", "chained").join(now, [key, "block"], "full_outer")
    return both.where(~F.col("digest").eqNullSafe(F.col("_d")) | ~F.col("chained").eqNullSafe(F.col("_c"))).select(key, "block")
