"""Readers for delimited text, JSON and Parquet, with missing-token and type rules for text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells, fixed
from assayframe.session import scratch_path
from assayframe.sources import records

_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
_WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
_TIME_NAME = re.compile(r"(.*_at|.*_time|timestamp.*|modified|date)$", re.IGNORECASE)
BATCH = 100


def na_to_null(df: DataFrame) -> DataFrame:
    """Missing tokens in string columns become NULL."""
    return df.select(*[
        F.when(~cells.quoted(f.name).isin(fixed.NA_TOKENS), cells.quoted(f.name)).alias(f.name)
        if cells.is_text(f.dataType) else cells.quoted(f.name) for f in df.schema.fields])


def infer_kinds(df: DataFrame) -> dict[str, str]:
    """Type of each string column from all of its values: bigint, double, boolean or string.

    One aggregation per 100 columns. A column without values is double; a boolean column has no
    missing value. Works on text whose missing tokens are already NULL."""
    names = [f.name for f in df.schema.fields if cells.is_text(f.dataType)]
    kinds: dict[str, str] = {}
    for start in range(0, len(names), BATCH):
        part = names[start:start + BATCH]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, n in enumerate(part):
            c = cells.quoted(n)
            aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.rlike(_NUMBER)).alias(f"d{i}"), F.count_if(c.rlike(_WHOLE)).alias(f"w{i}"),
                     F.count_if(c.isin(fixed.TRUE_TOKENS + fixed.FALSE_TOKENS)).alias(f"b{i}")]
        row = df.agg(*aggs).first()
        for i, n in enumerate(part):
            filled = row[f"n{i}"]
            if filled == 0:
                kinds[n] = "double"
            elif row[f"w{i}"] == filled:
                kinds[n] = "bigint"
            elif row[f"d{i}"] == filled:
                kinds[n] = "double"
            elif row[f"b{i}"] == row["rows"]:
                kinds[n] = "boolean"
            else:
                kinds[n] = "string"
    return kinds


def _as_kind(name: str, kind: str) -> Column:
    c = cells.quoted(name)
    if kind == "boolean":
        return c.isin(fixed.TRUE_TOKENS)
    if kind in ("bigint", "double"):
        return F.trim(c).try_cast(kind)
    return c


def typed(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """Cast string columns to their inferred (or given) type."""
    kinds = kinds if kinds is not None else infer_kinds(df)
    return df.select(*[_as_kind(c, kinds.get(c, "string")).alias(c) if c in kinds else cells.quoted(c) for c in df.columns])


MALFORMED = "_malformed"


def _from_records(spark: SparkSession, path: str, options: dict, delimiter: str, names: list[str], malformed: bool) -> DataFrame:
    """Text columns of delimited records, the first record of each file left out."""
    found = records.delimited_records(spark, path, delimiter)
    heads = found.groupBy("path").agg(F.min(F.struct("start", "nth")).alias("at"))
    # one row a file
    found = found.withColumn("at", F.struct("start", "nth")).join(F.broadcast(heads), ["path", "at"], "left_anti")
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, *([MALFORMED] if malformed else [])])
    plain = {k: str(v) for k, v in options.items() if k in ("sep", "quote", "escape", "mode")} | ({"columnNameOfCorruptRecord": MALFORMED} if malformed else {})
    return found.select(F.from_csv("record", ddl, plain).alias("r")).select("r.*")


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool | str = False,
                   kinds: dict[str, str] | None = None, malformed: bool = False) -> DataFrame:
    """Text with a header line. `multi_line` allows line breaks inside quotes: True reads a file as one task, "records" reads
    its byte ranges apart (the text is scanned twice and its records are stored once).

    With `malformed` a column of that name holds the raw text of lines with too many or too few cells (else NULL), so
    nothing of them is lost. Pass `kinds` to skip the inference pass over a large source."""
    options = {"header": True, "sep": delimiter, "quote": '"', "escape": '"', "multiLine": multi_line, "mode": "PERMISSIVE", "enforceSchema": True}
    apart = multi_line == "records"
    options["multiLine"] = bool(multi_line)
    raw = spark.read.options(**options).csv(path)
    if apart and raw.columns:
        raw = _from_records(spark, path, options, delimiter, raw.columns, malformed)
    if malformed and raw.columns:
        # lines are judged by all their cells, whichever columns a query reads
        if not apart:
            full = T.StructType([*raw.schema.fields, T.StructField(MALFORMED, T.StringType())])
            raw = spark.read.options(**options, columnNameOfCorruptRecord=MALFORMED, columnPruning=False).schema(full).csv(path)
        data = na_to_null(raw.drop(MALFORMED))
        kinds = kinds if kinds is not None else infer_kinds(data)
        whole = raw.select(*[F.when(~cells.quoted(c).isin(fixed.NA_TOKENS), cells.quoted(c)).alias(c) for c in data.columns], MALFORMED)
        return typed(whole, {c: k for c, k in kinds.items() if c != MALFORMED})
    return typed(na_to_null(raw), kinds)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, ",", **options)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_delimited(spark, path, "\t", **options)


def read_json(spark: SparkSession, path: str, lines: bool = False, malformed: bool = False, apart: bool = False) -> DataFrame:
    """Records array, or one record per line with `lines`, which splits. With `apart` an array of objects is read by byte ranges as well: its
    records are stored as lines first. Time-like names become timestamps.

    Text that is no record is not data: it is left out, or kept in the column `_malformed` when that is asked for."""
    if apart and not lines:
        out = scratch_path(spark, "json-records")
        # a JSON string holds no raw line break, so those between its parts can go
        records.json_records(spark, path).select(F.regexp_replace("record", r"[\r\n]+", " ")).write.text(out)
        return read_json(spark, out, lines=True, malformed=malformed)
    df = spark.read.options(multiLine=not lines, columnNameOfCorruptRecord=MALFORMED).json(path)
    keep = [f for f in df.schema.fields if f.name != MALFORMED]
    told = [cells.quoted(MALFORMED)] if MALFORMED in df.columns else [F.lit(None).cast("string").alias(MALFORMED)]
    if MALFORMED in df.columns and keep and not malformed:
        df = df.where(cells.quoted(MALFORMED).isNull() | F.coalesce(*[cells.quoted(f.name).isNotNull() for f in keep]))
    return df.select(*[F.try_to_timestamp(cells.quoted(f.name)).alias(f.name)
                       if cells.is_text(f.dataType) and _TIME_NAME.match(f.name) else cells.quoted(f.name) for f in keep], *(told if malformed else []))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "parquet": read_parquet}


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


# What Spark reports for content that cannot be parsed; anything else (a missing path, a lost executor) is raised.
PARSE_ERRORS = ("UNABLE_TO_INFER_SCHEMA", "is not a Parquet file", "MALFORMED_RECORD", "MALFORMED_CSV_RECORD")


@dataclass
class Ingested:
    data: DataFrame
    malformed_rows: int
    read_error: str | None


def _condition(error: Exception) -> str:
    return f"{getattr(error, 'getCondition', lambda: None)() or type(error).__name__} {error}"


def ingest(spark: SparkSession, path: str, file_format: str | None, **options) -> Ingested:
    """Read by format name (unknown formats as CSV). Content that cannot be parsed at all gives an empty table with the
    reason in `read_error`; malformed lines are counted; every other failure is raised."""
    kind = (file_format or "csv").lower()
    reader = READERS.get(kind, read_csv)
    try:
        if kind == "parquet":
            return Ingested(reader(spark, path, **options), 0, None)
        df = reader(spark, path, malformed=True, **options)
        if [c for c in df.columns if c != MALFORMED] == []:
            return Ingested(empty(spark), 0, "no record could be read")
        data = next(c for c in df.columns if c != MALFORMED)
        bad = df.agg(F.count(MALFORMED).alias("n"), F.count(cells.quoted(data))).first()["n"] if MALFORMED in df.columns else 0
        return Ingested(reader(spark, path, **options) if kind == "json" else df.drop(MALFORMED), bad, None)
    except (PySparkException, Py4JJavaError) as error:
        if not any(x in _condition(error) for x in PARSE_ERRORS):
            raise
        return Ingested(empty(spark), 0, next(x for x in PARSE_ERRORS if x in _condition(error)))


def read_dataset(spark: SparkSession, path: str, file_format: str | None) -> DataFrame:
    """The data of `ingest`."""
    return ingest(spark, path, file_format).data
