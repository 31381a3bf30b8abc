"""Dataset-level facts of many datasets in one job: every group of a key is a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells, fixed
from assayframe.operators import columns as col
from assayframe.operators import headers
from assayframe.operators import rows as rowops
from assayframe.plans.profile import DATASET_SCHEMA
from assayframe.session import stored

CLASS_MAP_LIMIT = 1000  # up to Spark's threshold for limiting ranks before the shuffle
KEY = "dataset_id"


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with the right columns of the same dataset; the dataset without a name is one too."""
    renamed = right.withColumnRenamed(KEY, "_right")
    return left.join(renamed, left[KEY].eqNullSafe(renamed["_right"]), "left").drop("_right")


def column_states(df: DataFrame, key: str) -> DataFrame:
    """One mergeable state per (dataset, column): rows, present values, rule violations, code matches and age bands.

    Cells are unpivoted and summed in one scan, whatever the number of columns; map-side sums keep a hot dataset from
    reaching one task with its rows. A state of order -1 and no name counts the rows."""
    def cell(ord: int, name: str | None, present: Column, bad: Column, age: Column, codes: dict[str, Column]) -> Column:
        return F.struct(F.lit(ord).alias("ord"), F.lit(name).cast("string").alias("column_name"), present.alias("present"), bad.alias("bad"),
                        age.cast("double").alias("age"), *[codes.get(k, F.lit(None).cast("boolean")).alias(k) for k in fixed.CODE_PATTERNS])

    none, parts = F.lit(None).cast("double"), [cell(-1, None, F.lit(True), F.lit(0), F.lit(None), {})]
    for i, f in enumerate(x for x in df.schema.fields if x.name != key):
        c, kind = cells.quoted(f.name), col.dtype_class(f.dataType)
        number = cells.nan_to_null(c.cast("double"), T.DoubleType()) if kind == "numeric" else none
        bad = F.lit(0)
        for low, high in headers.word_rules(f.name) if kind == "numeric" else []:
            bad = bad + F.when((number < low) | (number > high), 1).otherwise(0)
        codes = {k: col.code_match(c, k) for k in fixed.CODE_PATTERNS} if kind == "text" else {}
        parts.append(cell(i, f.name, ~cells.missing(c, f.dataType), bad, number if f.name.lower() in fixed.AGE_NAMES else none, codes))
    long = df.select(_named(df, key), F.inline(F.array(*parts)))
    a = F.col("age")
    return long.groupBy(KEY, "ord", "column_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("present").alias("present"), F.sum("bad").cast("bigint").alias("bad"),
        F.count(a).alias("ages"), F.min(a).alias("age_min"), F.max(a).alias("age_max"), F.count_if(a < 18).alias("age_low"),
        F.count_if(a.between(18, 60)).alias("age_mid"), F.count_if(a > 60).alias("age_high"),
        *[F.count_if(k).alias(k) for k in fixed.CODE_PATTERNS])


def _named(df: DataFrame, key: str) -> Column:
    return cells.nan_to_null(cells.quoted(key), df.schema[key].dataType).cast("string").alias(KEY)


def class_counts_by(df: DataFrame, key: str) -> DataFrame:
    """(dataset_id, column_name, class_value, cnt) of every column that could be a label; missing values are left out."""
    parts = []
    for f in df.schema.fields:
        if f.name != key and f.name.lower() in fixed.LABEL_NAMES and col.dtype_class(f.dataType) != "unknown":
            c = cells.nan_to_null(cells.quoted(f.name), f.dataType)
            shown = F.when(c.isNotNull(), cells.text_of_flag(c)) if isinstance(f.dataType, T.BooleanType) else c.cast("string")
            parts.append(F.struct(F.lit(f.name).alias("column_name"), shown.alias("class_value")))
    if not parts:
        return df.sparkSession.createDataFrame([], f"{KEY} string, column_name string, class_value string, cnt bigint")
    long = df.select(_named(df, key), F.inline(F.array(*parts)))
    return long.where(F.col("class_value").isNotNull()).groupBy(KEY, "column_name", "class_value").agg(F.count(F.lit(1)).alias("cnt"))


def duplicates_by(df: DataFrame, key: str) -> DataFrame:
    """(dataset_id, exact_duplicate_rows) of rows that repeat an earlier row of their dataset, by 128 bits of row hash."""
    flat = rowops._comparable(df)
    hashed = flat.select(_named(flat, key), *rowops.fingerprint(flat.drop(key)))
    groups = hashed.groupBy(KEY, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(KEY).agg(F.sum(F.col("_n") - 1).alias("exact_duplicate_rows"))


def _label_facts(counted: DataFrame, roles: DataFrame, limit: int) -> DataFrame:
    """Label summary and bounded class map of every dataset whose label has values."""
    label = roles.select(F.col(KEY).alias("_k"), F.col("label_column").alias("_label")).where("_label is not null")
    own = counted.join(label, counted[KEY].eqNullSafe(label["_k"]) & (counted["column_name"] == label["_label"])).select(KEY, "class_value", "cnt")
    summary = own.groupBy(KEY).agg(F.count(F.lit(1)).alias("classes"), F.max("cnt").alias("_hi"), F.min("cnt").alias("_lo"))
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("cnt"), "class_value"))).where(F.col("_rank") <= limit)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "class_value", "cnt"))), lambda x: F.struct(x["class_value"], x["cnt"]))
    return _beside(summary, ranked.groupBy(KEY).agg(F.map_from_entries(entries).alias("class_map")))


def profile_datasets(df: DataFrame, key: str, columns: DataFrame | None = None, files: DataFrame | None = None, file_format: str = "csv",
                     fhir: bool = False, class_map_limit: int = CLASS_MAP_LIMIT) -> DataFrame:
    """One row of the dataset profile per value of `key`, as `profile.profile` gives it for that part of the table alone.

    `df` is scanned three times: for column states, class counts and row hashes; all of them merge map-side. Datasets of
    different layouts come as one table with absent columns NULL (`unionByName(..., allowMissingColumns=True)`) and
    `columns(dataset_id, column_name, ord)`, each dataset's own columns in order; without it every dataset has all columns but the key,
    and a named column that `df` lacks is ignored. `files(dataset_id, filename, file_format, size_bytes)` describes the sources. Ids are text.

    Rows with a NULL key are a dataset without id. Repeated rows count as duplicates, an empty table gives no rows, a dataset of
    missing values only is 0 % complete, a dataset none of whose columns is listed has no columns. The class map holds the `class_map_limit`
    most frequent classes (ties by value) and says whether it is cut; ratio and binary flag are those of all classes."""
    states = column_states(df, key)
    if columns is not None:
        own = columns.select(F.col(KEY).cast("string").alias("_k"), F.col("column_name").alias("_c"), F.col("ord").alias("_o")).dropDuplicates(["_k", "_c"])
        own = states.where("ord >= 0").drop("ord").join(own, F.col(KEY).eqNullSafe(F.col("_k")) & (F.col("column_name") == F.col("_c")))
        states = states.where("ord < 0").unionByName(own.withColumn("ord", F.col("_o").cast("int")).drop("_k", "_c", "_o"))
    states = stored(states, "dataset-states")  # summed once, read by what follows
    named = states.where("column_name is not null")
    counted = stored(class_counts_by(df, key), "dataset-classes")

    rows, present = F.col("rows"), F.col("present")
    total = states.where("column_name is null").select(KEY, "rows")
    pick = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ord", "column_name")))), lambda x: x["column_name"])
    sums = named.groupBy(KEY).agg(
        F.count(F.lit(1)).cast("int").alias("n_columns"), F.sum("present").alias("present"), F.sum("rows").alias("cells"), F.sum("bad").alias("bad"),
        pick(present * 10 < rows * 9).alias("below_90"), pick(present * 2 < rows).alias("below_50"),
        *[pick(F.col(k) * 2 > present).alias(f"{k}_list") for k in fixed.CODE_PATTERNS])
    roles = headers.detect_roles(named)
    ages = named.where("ages > 0 or age_min is not null").select(
        F.col(KEY).alias("_k"), F.col("column_name").alias("_c"), "ages", "age_min", "age_max", "age_low", "age_mid", "age_high")
    numeric = [f.name for f in df.schema.fields if f.name.lower() in fixed.AGE_NAMES and cells.is_numeric(f.dataType)]
    roles = roles.join(ages, roles[KEY].eqNullSafe(ages["_k"]) & (roles["age_column"] == ages["_c"]), "left").drop("_k", "_c")

    out = total
    for part in (sums, headers.scan_headers(named), roles, _label_facts(counted, roles, class_map_limit), duplicates_by(df, key)):
        out = _beside(out, part)
    if files is not None:
        out = _beside(out, files.select(F.col(KEY).cast("string").alias(KEY), "filename", "file_format", F.col("size_bytes").cast("bigint").alias("size_bytes")))
    else:
        out = out.withColumns({"filename": F.lit(None).cast("string"), "file_format": F.lit(file_format), "size_bytes": F.lit(0).cast("bigint")})

    empty, number = F.array().cast("array<string>"), lambda name: F.coalesce(name if isinstance(name, Column) else F.col(name), F.lit(0))
    listed = lambda name: F.coalesce(F.col(name), empty)
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    good, classes = rows - number("bad"), number("classes")
    codes = [c for k in fixed.CODE_PATTERNS for c in ((F.size(listed(f"{k}_list")) > 0).alias(f"{k}_codes_present"), listed(f"{k}_list").alias(f"{k}_columns"))]
    has_columns = number("n_columns") > 0
    repeats = F.when(has_columns, number("exact_duplicate_rows")).otherwise(0)
    shaped = out.select(
        KEY, F.struct("filename", F.lower("file_format").alias("format"), "size_bytes", F.lit("UTF-8").alias("encoding")).alias("file"),
        F.struct("rows", number("n_columns").alias("columns")).alias("shape"),
        F.struct(flag("direct_identifiers_detected").alias("direct_identifiers_detected"), *[listed(f"{f}_columns").alias(f"{f}_columns") for f in ("name", "phone", "id", "gps", "dob")]).alias("pii_scan"),
        F.struct(F.coalesce(cells.pct(F.col("present"), F.col("cells")), F.lit(0.0)).alias("overall_pct"), listed("below_90").alias("columns_below_90pct"), listed("below_50").alias("columns_below_50pct")).alias("completeness"),
        F.struct(repeats.alias("exact_duplicate_rows"), cells.pct(repeats, rows).alias("exact_duplicate_pct")).alias("duplicates"),
        F.struct(*codes, F.lit(fhir).alias("fhir_structure")).alias("standards_detected"),
        F.struct(flag("split_column_detected").alias("split_column_detected"), flag("fold_column_detected").alias("fold_column_detected")).alias("split_columns"),
        F.struct((classes == 2).alias("binary_label_detected"), "label_column", F.coalesce(F.col("class_map"), F.create_map().cast("map<string,bigint>")).alias("class_distribution"),
                 F.when(classes >= 2, cells.pct(F.col("_hi"), F.col("_lo") * 100)).alias("imbalance_ratio"), (classes > class_map_limit).alias("class_distribution_truncated")).alias("label_columns"),
        F.when(F.col("age_column").isin(numeric) if numeric else F.lit(False), F.struct(
            F.col("age_min").alias("min"), F.col("age_max").alias("max"), *[cells.pct(number(c), number("ages")).alias(name) for c, name in (
                ("age_low", "under_18_pct"), ("age_mid", "18_to_60_pct"), ("age_high", "over_60_pct"))])).alias("age_distribution"),
        F.struct(F.when(good >= 0, cells.pct(good, rows, 100.0)).otherwise(-cells.pct(-good, rows)).alias("conformant_rows_pct"), number("bad").alias("schema_violations")).alias("schema_consistency"),
        F.lit(False).alias("sampled"), F.lit(None).cast("bigint").alias("sample_rows"), F.lit(fixed.PROFILER_VERSION).alias("profiler_version"),
        F.lit(0).cast("bigint").alias("malformed_rows"), F.lit(None).cast("string").alias("read_error"))
    return shaped.to(T.StructType.fromDDL(DATASET_SCHEMA))
