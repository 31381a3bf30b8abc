"""Row-level checks of one table: duplicates, label balance, age bands, conformance, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells, fixed
from assayframe.operators import headers


def _comparable(df: DataFrame) -> DataFrame:
    """Columns usable as grouping keys: NaN read as NULL, maps as sorted entries."""
    cols = []
    for f in df.schema.fields:
        c = cells.nan_to_null(cells.quoted(f.name), f.dataType)
        if isinstance(f.dataType, T.MapType):
            c = F.array_sort(F.map_entries(c))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def fingerprint(df: DataFrame) -> list[Column]:
    """Two independent 64-bit hashes of the whole row. NULL is hashed with its position,
    because the plain hash skips it."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = cells.quoted(f.name)
        parts += [c, c.isNull()]
    return [F.xxhash64(F.lit(17), *parts).alias("_h1"), F.xxhash64(F.lit(40503), *parts).alias("_h2")]


def duplicate_counts(df: DataFrame, method: str = "fingerprint") -> DataFrame:
    """(rows, exact_duplicate_rows, exact_duplicate_pct): rows that repeat an earlier row.

    `fingerprint` shuffles 16 bytes per distinct row; two different rows share both hashes with a
    chance of about rows^2 / 2^129. `rows` groups by the full rows and has no such chance."""
    flat = _comparable(df)
    if method == "rows":
        groups = flat.groupBy(*[cells.quoted(c) for c in flat.columns]).agg(F.count(F.lit(1)).alias("_n"))
    else:
        groups = flat.select(*fingerprint(flat)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    total = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("_d"))
    extra = F.col("rows") - F.col("_d")
    return total.select("rows", extra.alias("exact_duplicate_rows"), cells.pct(extra, F.col("rows")).alias("exact_duplicate_pct"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(class_value, cnt) of the label column, NULL left out."""
    c = cells.nan_to_null(cells.quoted(label), df.schema[label].dataType)
    return (df.select(c.cast("string").alias("class_value")).where(F.col("class_value").isNotNull())
            .groupBy("class_value").agg(F.count(F.lit(1)).alias("cnt")))


def label_summary(counts: DataFrame) -> DataFrame:
    """(classes, binary_label_detected, imbalance_ratio) from class counts."""
    agg = counts.agg(F.count(F.lit(1)).alias("classes"), F.max("cnt").alias("_hi"), F.min("cnt").alias("_lo"))
    ratio = cells.pct(F.col("_hi"), F.col("_lo") * 100)
    return agg.select("classes", (F.col("classes") == 2).alias("binary_label_detected"),
                      F.when(F.col("classes") >= 2, ratio).alias("imbalance_ratio"))


def age_bands(df: DataFrame, column: str) -> DataFrame:
    """Least, greatest and the share under 18, 18 to 60 and over 60 of the present ages."""
    a = cells.nan_to_null(cells.quoted(column).cast("double"), T.DoubleType())
    agg = df.select(a.alias("a")).agg(F.count("a").alias("n"), F.min("a").alias("min"), F.max("a").alias("max"),
                                      F.count_if(F.col("a") < 18).alias("lo"),
                                      F.count_if(F.col("a").between(18, 60)).alias("mid"),
                                      F.count_if(F.col("a") > 60).alias("hi"))
    return agg.select("min", "max", *[cells.pct(F.col(c), F.col("n")).alias(name) for c, name in (
        ("lo", "under_18_pct"), ("mid", "18_to_60_pct"), ("hi", "over_60_pct"))])


def conformance(df: DataFrame) -> DataFrame:
    """(rows, schema_violations, conformant_rows_pct) of the whole-word age and body-mass rules."""
    tests = []
    for f in df.schema.fields:
        if cells.is_numeric(f.dataType):
            c = cells.nan_to_null(cells.quoted(f.name), f.dataType)
            tests += [F.count_if((c < low) | (c > high)) for low, high in headers.word_rules(f.name)]
    total = F.lit(0).cast("bigint")
    for t in tests:
        total = total + t
    agg = df.agg(F.count(F.lit(1)).alias("rows"), total.alias("schema_violations"))
    return agg.select("rows", "schema_violations",
                      cells.pct(F.col("rows") - F.col("schema_violations"), F.col("rows"), 100.0).alias("conformant_rows_pct"))


def sample_rows(df: DataFrame, n: int = fixed.SAMPLE_ROWS, seed: int = fixed.SAMPLE_SEED,
                key: list[str] | None = None) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, chosen by the order of a row hash.

    A count fixes a hash threshold that keeps slightly more than n rows, so the final ordering
    sees about n rows however large the table is. `key` must identify a row; without it Spark's
    seeded generator scores the rows."""
    total = df.count()
    if total <= n:
        return df
    if key:
        text = F.concat_ws("|", F.lit(str(seed)), *[cells.quoted(k).cast("string") for k in key])
        score = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(16 ** 13))
    else:
        score = F.rand(seed)
    scored = df.withColumn("_score", score)
    share = min(1.0, (n + 8 * n ** 0.5 + 50) / total)
    near = scored.where(F.col("_score") < share)
    if share < 1.0 and near.count() < n:  # practically never; then order everything
        near = scored
    ties = ["_score", *[cells.quoted(k) for k in (key or [])]]
    return near.orderBy(*ties).limit(n).drop("_score")
