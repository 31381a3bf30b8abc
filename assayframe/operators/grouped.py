"""Column statistics of many datasets in one job (long form, grouped by dataset and column)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells, fixed
from assayframe.operators import columns, headers, quantiles
from assayframe.session import stored


def unpivot(df: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """(keys, column_name, kind, num, txt): one row per cell."""
    parts = []
    for f in df.schema.fields:
        kind = columns.dtype_class(f.dataType)
        if f.name in keys or kind == "unknown" or (only and f.name not in only):
            continue
        c = cells.quoted(f.name)
        num = cells.nan_to_null(c.cast("double"), T.DoubleType()) if kind == "numeric" else F.lit(None).cast("double")
        txt = c.cast("string") if kind != "numeric" else F.lit(None).cast("string")
        parts.append(F.struct(F.lit(f.name).alias("column_name"), F.lit(kind).alias("kind"), num.alias("num"), txt.alias("txt")))
    return df.select(*keys, F.inline(F.array(*parts)))


def profile_by(df: DataFrame, keys: list[str], only: list[str] | None = None) -> DataFrame:
    """Column profile per group. The cells are counted per value once and stored; distinct counts, quartiles and
    outliers all read those counts, so a hot group or value is collapsed map-side. Text travels as 96 bits of hash, never whole. The source
    is scanned twice: for the counts and for the moments."""
    cells_long = unpivot(df, keys, only)
    by = [*keys, "column_name"]
    told = cells_long.select(*by, "kind", "num", (F.col("num").isNotNull() | F.col("txt").isNotNull()).alias("present"),
                             F.when(F.col("txt").isNotNull(), F.xxhash64("txt")).alias("t1"), F.when(F.col("txt").isNotNull(), F.hash("txt")).alias("t2"))
    counted = stored(told.groupBy(*by, "kind", "num", "present", "t1", "t2").agg(F.count(F.lit(1)).alias("cnt")), "cell-counts")
    v, n, present = F.col("num"), F.col("cnt"), F.col("present")
    bounds = {}
    for f in df.schema.fields:
        if headers.range_rule(f.name):
            bounds[f.name] = headers.range_rule(f.name)
    bad = F.lit(False)
    for name, (low, high) in bounds.items():
        bad = bad | ((F.col("column_name") == name) & ((v < low) | (v > high)))
    base = counted.groupBy(*by, "kind").agg(
        F.sum("cnt").alias("rows"), F.sum(F.when(present, n).otherwise(0)).alias("present"),
        F.count_if(present).alias("distinct_values"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.max(F.coalesce(bad, F.lit(False))).alias("range_violation"))
    moments = cells_long.where(v.isNotNull()).groupBy(*by).agg(F.avg("num").alias("mean"), F.stddev_samp("num").alias("std"))
    quart = quantiles.grouped_quantiles(counted, by, "num", "cnt", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    out_of = counted.where(v.isNotNull()).join(quart, by).groupBy(*by).agg(F.sum(F.when(
        (v < F.col("q1") - reach) | (v > F.col("q3") + reach), n).otherwise(0)).alias("outliers"))
    whole = base.join(moments, by, "left").join(quart, by, "left").join(out_of, by, "left")
    numeric = F.col("kind") == "numeric"
    dtype = (F.when(F.col("kind") == "text", F.when(F.col("distinct_values") <= fixed.CATEGORY_LIMIT, "categorical")
                    .otherwise("string")).otherwise(F.col("kind")))
    return whole.select(
        *by, dtype.alias("dtype"), "rows", (F.col("rows") - F.col("present")).alias("missing_count"),
        cells.pct(F.col("present"), F.col("rows")).alias("completeness_pct"), "min", "max",
        F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"),
        F.when(numeric & (F.col("present") > 0), F.round(F.coalesce("std", F.lit(0.0)), 4)).alias("std"),
        F.when(numeric & (F.col("present") > 0), cells.pct(F.col("outliers"), F.col("present"))).alias("outlier_pct"),
        F.when(numeric & (F.col("present") > 0), F.col("range_violation")).alias("range_violation"),
        F.when(F.col("kind") != "numeric", F.col("distinct_values")).alias("distinct_values"))
