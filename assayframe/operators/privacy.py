"""Value-level personal-data checks and measured re-identification risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import cells, fixed


def _text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if cells.is_text(f.dataType)]


def scan_values(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column_name, family, present, hits, hit_pct): values holding an email, phone or national id.

    One pass and one partial aggregation; whole values are searched."""
    names = names or _text_names(df)
    aggs = []
    for i, n in enumerate(names):
        aggs.append(F.count(cells.quoted(n)).alias(f"n{i}"))
        aggs += [F.count_if(cells.quoted(n).rlike(p)).alias(f"{fam}{i}") for fam, p in fixed.VALUE_PATTERNS.items()]
    items = [F.struct(F.lit(n).alias("column_name"), F.lit(fam).alias("family"), F.col(f"n{i}").alias("present"),
                      F.col(f"{fam}{i}").alias("hits")) for i, n in enumerate(names) for fam in fixed.VALUE_PATTERNS]
    rows = df.agg(*aggs).select(F.inline(F.array(*items)))
    return rows.withColumn("hit_pct", cells.pct(F.col("hits"), F.col("present")))


def extract_values(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, family, value): every match in a text column."""
    found = [F.struct(F.lit(fam).alias("family"), F.regexp_extract_all(F.col(column), F.lit(p), F.lit(0)).alias("hits"))
             for fam, p in fixed.VALUE_PATTERNS.items()]
    return df.select(key, F.inline(F.array(*found))).select(key, "family", F.explode("hits").alias("value"))


def name_like(df: DataFrame, min_distinct: float = 0.5, pattern: str = r"^[A-Z][\w'.#-]+([ ][A-Z]?[\w'.#-]*)*$") -> DataFrame:
    """(column_name, present, distinct_estimate, matches, name_like): text columns of many distinct name-shaped values.

    Distinct counts are sketched, so no value is shuffled."""
    names = _text_names(df)
    aggs = []
    for i, n in enumerate(names):
        c = cells.quoted(n)
        aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c, 0.02).alias(f"d{i}"), F.count_if(c.rlike(pattern)).alias(f"m{i}")]
    items = [F.struct(F.lit(n).alias("column_name"), F.col(f"n{i}").alias("present"), F.col(f"d{i}").alias("distinct_estimate"),
                      F.col(f"m{i}").alias("matches")) for i, n in enumerate(names)]
    rows = df.agg(*aggs).select(F.inline(F.array(*items)))
    return rows.withColumn("name_like", (F.col("matches") * 2 > F.col("present"))
                           & (F.col("distinct_estimate") > F.col("present") * min_distinct))


def gps_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(latitude_column, longitude_column, present, in_range, is_pair) for candidate numeric pairs."""
    aggs, items = [], []
    for i, (la, lo) in enumerate(pairs):
        lat, lon = cells.quoted(la).cast("double"), cells.quoted(lo).cast("double")
        both = lat.isNotNull() & lon.isNotNull()
        aggs += [F.count_if(both).alias(f"n{i}"), F.count_if(lat.between(-90, 90) & lon.between(-180, 180)).alias(f"k{i}")]
        items.append(F.struct(F.lit(la).alias("latitude_column"), F.lit(lo).alias("longitude_column"),
                              F.col(f"n{i}").alias("present"), F.col(f"k{i}").alias("in_range")))
    rows = df.agg(*aggs).select(F.inline(F.array(*items)))
    return rows.withColumn("is_pair", (F.col("present") > 0) & (F.col("in_range") == F.col("present")))


def full_dates(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(column_name, present, full_dates, day_precision): text columns that mostly hold complete dates."""
    names = names or _text_names(df)
    aggs = [a for i, n in enumerate(names) for a in (
        F.count(cells.quoted(n)).alias(f"n{i}"), F.count_if(F.trim(cells.quoted(n)).rlike(fixed.FULL_DATE_PATTERN)).alias(f"f{i}"))]
    items = [F.struct(F.lit(n).alias("column_name"), F.col(f"n{i}").alias("present"), F.col(f"f{i}").alias("full_dates"))
             for i, n in enumerate(names)]
    rows = df.agg(*aggs).select(F.inline(F.array(*items)))
    return rows.withColumn("day_precision", F.col("full_dates") * 2 > F.col("present"))


def anonymity_classes(df: DataFrame, quasi: list[str | Column]) -> DataFrame:
    """One row per combination of quasi-identifiers with its size; NULL counts as a value."""
    return df.groupBy(*quasi).agg(F.count(F.lit(1)).alias("class_size"))


def anonymity(df: DataFrame, quasi: list[str | Column], k_min: int = 5) -> DataFrame:
    """k, classes, rows, unique rows, rows below k_min, and the mean re-identification probability with its baseline 100*p.

    Class sizes are pre-aggregated map-side; the mean of 1/size over rows is classes / rows."""
    agg = anonymity_classes(df, quasi).agg(
        F.min("class_size").alias("k"), F.count(F.lit(1)).alias("classes"), F.sum("class_size").alias("rows"),
        F.count_if(F.col("class_size") == 1).alias("unique_rows"),
        F.sum(F.when(F.col("class_size") < k_min, F.col("class_size")).otherwise(0)).alias("rows_below"))
    return agg.withColumn("baseline_risk", cells.pct(F.col("classes"), F.col("rows")))
