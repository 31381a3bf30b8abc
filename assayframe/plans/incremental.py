"""Incremental profile: every partition leaves mergeable states, the whole is put together from states without its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import cells
from assayframe.operators import grouped

SKETCH_K = 800  # quantile sketch: 0.35 % of rank at 99 % confidence, before and after merging
RANK_ERROR = 0.01  # stated for every quantile
HLL_BITS = 12  # distinct sketch: 1.6 % standard error
DISTINCT_ERROR = 0.06  # stated for every distinct count
TRACKED = 1000  # values followed by the heavy-hitter sketch; counts are exact up to about three quarters of as many values

STATE = ("column_name string, kind string, rows bigint, present bigint, mean double, m2 double, min double, max double, quantiles binary, "
         "distinct_values binary, top struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>, part string")


def part_states(df: DataFrame, part: str) -> DataFrame:
    """One state per (partition, column): counts, moments, extremes and sketches of quantiles, distinct values and heavy hitters.

    One scan; the states are summed map-side, so a large partition reaches the shuffle as states. NaN counts as missing, the
    partition column is no column of the profile, columns of nested types are left out."""
    free = "_part"
    while free in df.columns:
        free += "_"
    long = grouped.unpivot(df.withColumnRenamed(part, free), [free])
    v, t = F.col("num"), F.col("txt")
    told = F.when(v.isNotNull(), F.xxhash64(v + 0.0)).otherwise(F.when(t.isNotNull(), F.xxhash64(t)))  # + 0.0: one zero
    states = long.groupBy(F.col(free).cast("string").alias("part"), "column_name", "kind").agg(
        F.count(F.lit(1)).alias("rows"), (F.count(v) + F.count(t)).alias("present"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("quantiles"),
        F.hll_sketch_agg(told, F.lit(HLL_BITS)).alias("distinct_values"), F.expr(f"approx_top_k_accumulate(txt, {TRACKED})").alias("top"))
    return states.select("column_name", "kind", "rows", "present", "mean", "m2", "min", "max", "quantiles", "distinct_values", "top", "part")


def add_parts(df: DataFrame, part: str, path: str) -> None:
    """Store the states of the partitions in `df`; a partition that arrives again replaces what it left before, others stay."""
    (part_states(df, part).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part").parquet(path))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).parquet(path)


def merged(states: DataFrame, top: int = 10) -> DataFrame:
    """(column_name, kind, parts, rows, missing_count, completeness_pct, min, max, mean, std, q1, median, q3, distinct_estimate, top_values).

    Counts, extremes and moments are those of all rows; quartiles are within `RANK_ERROR` of their rank, distinct counts within
    `DISTINCT_ERROR`. A column that has another kind in some partitions is told per kind. No states give no rows."""
    by = ["column_name", "kind"]
    held = F.when(F.col("mean").isNotNull(), F.col("present"))
    whole = states.groupBy(*by).agg(
        F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("present").alias("present"), F.min("min").alias("min"), F.max("max").alias("max"),
        (F.sum(held * F.col("mean")) / F.sum(held)).alias("mean"), F.kll_merge_agg_double("quantiles", F.lit(SKETCH_K)).alias("_q"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_values")).alias("distinct_estimate"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(top, {TRACKED}), {TRACKED})").alias("_top"))
    # the spread of the partitions around the common mean is added to the spread within them
    centre = whole.select(*by, F.col("mean").alias("_mean"))
    spread = states.join(centre, by).groupBy(*by).agg(F.sum(F.col("m2") + held * F.pow(F.col("mean") - F.col("_mean"), 2)).alias("_m2"))
    out = whole.join(spread, by, "left")
    some = F.col("mean").isNotNull()
    at = [F.when(some, F.kll_sketch_get_quantile_double("_q", F.lit(p))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    listed = F.slice(F.filter("_top", lambda x: x["item"].isNotNull()), 1, top)
    return out.select(*by, "parts", "rows", (F.col("rows") - F.col("present")).alias("missing_count"), cells.pct(F.col("present"), F.col("rows")).alias("completeness_pct"),
                      "min", "max", "mean", F.when(some, F.coalesce(F.sqrt(F.col("_m2") / F.nullif(F.col("present") - 1, F.lit(0))), F.lit(0.0))).alias("std"), *at,
                      "distinct_estimate", F.when(~some & (F.col("kind") != "numeric"), listed).alias("top_values"))


def rank_errors(df: DataFrame, found: DataFrame) -> DataFrame:
    """(column_name, rank_error): the greatest distance of a stated quartile from its rank among the column's values; a check by one
    scan of the rows. A value stands at every rank from the share below it to the share up to it."""
    names = [("q1", 0.25), ("median", 0.5), ("q3", 0.75)]
    asked = found.where("mean is not null").select(F.col("column_name").alias("_c"), *[n for n, _ in names])  # one row per column
    cells_long = grouped.unpivot(df, []).where("num is not null")
    v = F.col("num")
    shares = cells_long.join(asked, F.col("column_name") == F.col("_c")).groupBy("column_name").agg(
        *[F.avg((v < F.col(n)).cast("double")).alias(f"{n}_low") for n, _ in names], *[F.avg((v <= F.col(n)).cast("double")).alias(f"{n}_high") for n, _ in names])
    return shares.select("column_name", F.greatest(*[F.greatest(F.col(f"{n}_low") - p, p - F.col(f"{n}_high"), F.lit(0.0)) for n, p in names]).alias("rank_error"))
