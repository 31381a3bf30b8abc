"""Column statistics of one table in fused aggregations (wide form)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells, fixed
from assayframe.operators import headers, quantiles

BATCH = 60  # columns per aggregation, so that generated code stays small
CANDIDATE_LIMIT = 400  # approximate distinct count below which categories are counted exactly


def dtype_class(dtype: T.DataType) -> str:
    if cells.is_numeric(dtype):
        return "numeric"
    if cells.is_text(dtype):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if cells.is_temporal(dtype):
        return "datetime"
    return "unknown"


def prepared(df: DataFrame) -> DataFrame:
    """NaN becomes NULL and numbers become double, so every later step tests only NULL."""
    cols = []
    for f in df.schema.fields:
        c = cells.quoted(f.name)
        if cells.is_numeric(f.dataType):
            c = cells.nan_to_null(c.cast("double"), T.DoubleType())
        cols.append(c.alias(f.name))
    return df.select(*cols)


def code_match(c: Column, code: str) -> Column:
    """The code pattern with white space allowed around it, which spares trimming every value."""
    return c.rlike(r"^\s*" + fixed.CODE_PATTERNS[code][1:-1] + r"\s*$")


@dataclass
class ColumnFacts:
    name: str
    kind: str
    position: int
    missing: int = 0
    stats: dict[str, Any] = field(default_factory=dict)


def _aggregates(name: str, kind: str, i: int) -> list[Column]:
    c = cells.quoted(name)
    out = [F.count_if(c.isNull()).alias(f"missing_{i}")]
    if kind == "numeric":
        out += [F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}"), F.avg(c).alias(f"mean_{i}"),
                F.stddev_samp(c).alias(f"std_{i}")]
        rule = headers.range_rule(name)
        if rule:
            out.append(F.coalesce(F.max((c < rule[0]) | (c > rule[1])), F.lit(False)).alias(f"range_{i}"))
        for j, (low, high) in enumerate(headers.word_rules(name)):
            out.append(F.count_if((c < low) | (c > high)).alias(f"word{j}_{i}"))
    elif kind in ("text", "boolean"):
        out.append(F.approx_count_distinct(c, 0.05).alias(f"distinct_{i}"))
        if kind == "text":
            for code in fixed.CODE_PATTERNS:
                out.append(F.count_if(code_match(c, code)).alias(f"{code}_{i}"))
    return out


def scan(df: DataFrame) -> tuple[int, list[ColumnFacts]]:
    """Row count and facts of every column. `df` comes from `prepared`'s schema of `kinds`.

    One aggregation per batch of columns; a columnar source reads each column once."""
    fields = df.schema.fields
    kinds = [dtype_class(f.dataType) for f in fields]
    facts, rows = [], 0
    for start in range(0, max(1, len(fields)), BATCH):
        batch = list(range(start, min(len(fields), start + BATCH)))
        aggs = [a for i in batch for a in _aggregates(fields[i].name, kinds[i], i)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
        rows = row["rows"]
        for i in batch:
            stats = {k[: -len(f"_{i}")]: v for k, v in row.asDict().items() if k.endswith(f"_{i}") and k != "rows"}
            facts.append(ColumnFacts(fields[i].name, kinds[i], i, stats.pop("missing"), stats))
    return rows, facts


def add_spread(df: DataFrame, rows: int, facts: list[ColumnFacts], map_limit: int = quantiles.MAP_LIMIT) -> None:
    """Median, quartiles and the share outside 1.5 quartile ranges, for every numeric column."""
    numeric = [f for f in facts if f.kind == "numeric" and rows - f.missing > 0]
    for start in range(0, len(numeric), BATCH):
        part = numeric[start:start + BATCH]
        found = quantiles.exact_quantiles(df, {f.name: rows - f.missing for f in part}, [0.25, 0.5, 0.75], map_limit)
        tests = []
        for f in part:
            q1, median, q3 = found[f.name]
            f.stats.update(q1=q1, median=median, q3=q3)
            c, reach = cells.quoted(f.name), 1.5 * (q3 - q1)
            tests.append(F.count_if((c < q1 - reach) | (c > q3 + reach)).alias(f"o{f.position}"))
        row = df.agg(*tests).first()
        for f in part:
            f.stats["outliers"] = row[f"o{f.position}"]


def values_long(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, value text, cnt) of the named columns in one pass; NULLs dropped."""
    def shown(name: str) -> Column:
        dtype = df.schema[name].dataType
        if isinstance(dtype, T.BooleanType):
            return cells.text_of_flag(cells.quoted(name))
        return cells.quoted(name).cast("string")

    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"),
                               F.when(cells.quoted(n).isNotNull(), shown(n)).alias("value")) for n in names])
    return (df.select(F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt")))


def value_counts(df: DataFrame, limit: int = fixed.CATEGORY_LIMIT) -> DataFrame:
    """Value counts of text columns with at most `limit` distinct values: (column_name, unique_values, value, cnt).

    A sketch first sets aside columns far above the limit so their values are never shuffled;
    the decision for the rest is exact."""
    names = [f.name for f in df.schema.fields if dtype_class(f.dataType) in ("text", "boolean")]
    approx = df.agg(*[F.approx_count_distinct(cells.quoted(n), 0.05).alias(f"c{i}") for i, n in enumerate(names)]).first()
    near = [n for n, a in zip(names, approx) if a <= CANDIDATE_LIMIT]
    return exact_categories(df, near, limit)


def exact_categories(df: DataFrame, names: list[str], limit: int = fixed.CATEGORY_LIMIT) -> DataFrame:
    counted = values_long(df, names) if names else df.sparkSession.createDataFrame([], "column_name string, value string, cnt bigint")
    few = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_values")).where(F.col("unique_values") <= limit)
    return counted.join(F.broadcast(few), "column_name").select("column_name", "unique_values", "value", "cnt")


COLUMN_SCHEMA = ("position int, name string, dtype string, completeness_pct double, missing_count bigint, min double, "
                 "max double, mean double, median double, std double, outlier_pct double, range_violation boolean, "
                 "unique_values bigint, value_counts map<string,bigint>, pii_flag string, pii_confidence string")


def round_half_up(value: float | None, digits: int) -> float | None:
    if value is None:
        return None
    from decimal import ROUND_HALF_UP, Decimal

    number = Decimal(repr(value))
    return float(number.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)) if number.is_finite() else value


def pct_of(part: int, whole: int, empty: float = 0.0) -> float:
    return (20000 * part + whole) // (2 * whole) / 100.0 if whole > 0 else empty


def column_row(f: ColumnFacts, rows: int, categories: dict[str, int] | None) -> Row:
    """The profile of one column, from aggregated facts."""
    present = rows - f.missing
    out: dict[str, Any] = {k.split()[0]: None for k in COLUMN_SCHEMA.split(", ")}
    out.update(position=f.position, name=f.name, dtype=f.kind, missing_count=f.missing,
               completeness_pct=pct_of(present, rows))
    if f.kind == "numeric" and present > 0:
        s = f.stats
        out.update(min=s["min"], max=s["max"], mean=round_half_up(s["mean"], 4), median=round_half_up(s["median"], 4),
                   std=round_half_up(s["std"], 4) if s["std"] is not None else 0.0,
                   outlier_pct=pct_of(s["outliers"], present), range_violation=bool(s.get("range", False)))
    elif f.kind in ("text", "boolean"):
        if f.kind == "text":
            out["dtype"] = "string" if categories is None else "categorical"
        if categories is not None:
            out.update(unique_values=len(categories), value_counts=categories)
        hit = next((fam for fam, cols in headers.table_headers([f.name]).items() if cols), None)
        if f.kind == "text" and hit:
            out.update(pii_flag=f"{hit}_pattern", pii_confidence="High")
    return Row(**out)


def standards(facts: list[ColumnFacts], rows: int) -> dict[str, list[str]]:
    """Text columns where more than half of the present values match a code pattern."""
    return {code: [f.name for f in facts if f.kind == "text" and 2 * (f.stats[code] or 0) > rows - f.missing]
            for code in fixed.CODE_PATTERNS}


CODE_PREFIX = 500  # values judged in the ordered mode


def standards_in_order(df: DataFrame, order: list[str], first: int = CODE_PREFIX) -> DataFrame:
    """(column_name, judged, one count and one verdict per code): the code test on each text column's first `first` present values by
    the given key, for rows that have an order. The whole-table test is `standards`.

    Every partition passes on at most `first` values a column before the shuffle (Spark limits ranks there up to its threshold of 1000).
    Ties of the key go by the value; NULL keys come first. A column without values has no verdict true; no text column gives no rows."""
    fields = [f for f in df.schema.fields if dtype_class(f.dataType) == "text"]
    keys = [f"k{i}" for i in range(len(order))]
    listed = F.array(*[F.struct(F.lit(f.name).alias("column_name"), cells.quoted(f.name).cast("string").alias("value")) for f in fields])
    if not fields:
        listed = listed.cast("array<struct<column_name:string,value:string>>")
    long = df.select(*[cells.quoted(k).alias(a) for k, a in zip(order, keys)], F.inline(listed)).where(F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(*keys, "value"))
    seen = long.withColumn("place", place).where(F.col("place") <= first).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("judged"), *[F.count_if(code_match(F.col("value"), c)).alias(f"{c}_matches") for c in fixed.CODE_PATTERNS])
    every = df.sparkSession.createDataFrame([(f.name,) for f in fields], "column_name string")  # one row per column
    out = every.join(seen, "column_name", "left").na.fill(0)
    return out.select("*", *[(F.col(f"{c}_matches") * 2 > F.col("judged")).alias(f"{c}_detected") for c in fixed.CODE_PATTERNS])
