"""Exact row numbers and ranks of a whole table without one task that sorts it: ranges are sorted apart and offset by the sizes of those before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.functions import cells
from assayframe.session import stored

WITHIN = 33  # bits of monotonically_increasing_id that number the rows of one partition


def _free(name: str, taken: list[str]) -> str:
    low = {t.lower() for t in taken}
    while name in low:
        name += "_"
    return name


def _laid_out(df: DataFrame, order: list[Column], label: str) -> tuple[DataFrame, str]:
    """The table sorted in ranges and written once, with a column that holds each row's range and place; all later reads
    see the same ranges, whatever happens to executors."""
    at = _free("_at", df.columns)
    return stored(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), label), at


def _part(at: str) -> Column:
    return F.shiftright(at, WITHIN)


def _before(sizes: DataFrame) -> DataFrame:
    """(_range, _before) from (_range, _size): one row per range, so at most as many as the sort had partitions."""
    return sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_before"))


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """Rows numbered from 1 in the given order. Rows that the order leaves equal are put in the order of a hash of the whole row, so that a
    frequent value is cut into several ranges too; only rows alike in every column may swap between runs. NULL comes first
    unless `order` says otherwise. An empty table gives no rows; a column `name` of the table is replaced."""
    ties = [F.xxhash64(F.to_json(F.struct(*[cells.quoted(c) for c in df.columns]))), F.hash(F.to_json(F.struct(*[cells.quoted(c) for c in df.columns])))]
    rows, at = _laid_out(df, [*order, *ties], "numbered")
    before = _before(rows.groupBy(_part(at).alias("_range")).agg(F.count(F.lit(1)).alias("_size"))).withColumnRenamed("_range", at + "r").withColumnRenamed("_before", at + "b")
    place = (F.col(at + "b") + F.col(at).bitwiseAND((1 << WITHIN) - 1) + 1).alias(name)
    return rows.join(F.broadcast(before), _part(at) == F.col(at + "r")).select(*[cells.quoted(c) for c in df.columns if c != name], place)


def with_ranks(df: DataFrame, value: str, rank: str = "rank", percent: str = "percent_rank", digits: int = 6) -> DataFrame:
    """Rank (1 + rows below) and percent rank of every row by `value`, for any number of distinct values. NULL ranks lowest, equal
    values share a rank, a single row has percent rank 0.

    Values are counted map-side and only distinct ones are sorted; rows meet their value's rank by a join, where Spark's skew
    handling splits a frequent value."""
    counted = df.groupBy(cells.quoted(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    values, at = _laid_out(counted, [F.col("v").asc_nulls_first()], "ranked")
    before = _before(values.groupBy(_part(at).alias("_range")).agg(F.sum("n").alias("_size")))
    inside = Window.partitionBy("_r").orderBy(at)  # a range of distinct values, as the sort cut it
    low = values.withColumn("_r", _part(at)).withColumn("_low", F.sum("n").over(inside) - F.col("n"))
    all_rows = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = low.join(F.broadcast(before), F.col("_r") == F.col("_range")).select(F.col("v"), (F.col("_low") + F.col("_before")).alias("_below"))
    taken = [*df.columns, rank, percent]
    v, below = _free("_v", taken), _free("_below", taken)
    told = told.select(F.col("v").alias(v), F.col("_below").alias(below))
    share = F.round(F.col(below) / F.lit(max(all_rows - 1, 1)), digits)
    return df.join(told, cells.named(df, value).eqNullSafe(F.col(v))).select(*[cells.named(df, c) for c in df.columns if c not in (rank, percent)], (F.col(below) + 1).alias(rank), share.alias(percent))
