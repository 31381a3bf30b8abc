"""Full profile of one table: one dataset row, one row per column, and the value counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import cells, fixed
from assayframe.operators import columns as col
from assayframe.operators import headers, quantiles
from assayframe.operators import rows as rowops
from assayframe.session import scratch_path

CLASS_MAP_LIMIT = 10_000

DATASET_SCHEMA = (
    "dataset_id string, "
    "file struct<filename:string,format:string,size_bytes:bigint,encoding:string>, "
    "shape struct<rows:bigint,columns:int>, "
    "pii_scan struct<direct_identifiers_detected:boolean,name_columns:array<string>,phone_columns:array<string>,"
    "id_columns:array<string>,gps_columns:array<string>,dob_columns:array<string>>, "
    "completeness struct<overall_pct:double,columns_below_90pct:array<string>,columns_below_50pct:array<string>>, "
    "duplicates struct<exact_duplicate_rows:bigint,exact_duplicate_pct:double>, "
    "standards_detected struct<icd_codes_present:boolean,icd_columns:array<string>,snomed_codes_present:boolean,"
    "snomed_columns:array<string>,loinc_codes_present:boolean,loinc_columns:array<string>,fhir_structure:boolean>, "
    "split_columns struct<split_column_detected:boolean,fold_column_detected:boolean>, "
    "label_columns struct<binary_label_detected:boolean,label_column:string,class_distribution:map<string,bigint>,"
    "imbalance_ratio:double,class_distribution_truncated:boolean>, "
    "age_distribution struct<min:double,max:double,under_18_pct:double,`18_to_60_pct`:double,over_60_pct:double>, "
    "schema_consistency struct<conformant_rows_pct:double,schema_violations:bigint>, "
    "sampled boolean, sample_rows bigint, profiler_version string, malformed_rows bigint, read_error string")


@dataclass
class TableProfile:
    dataset: DataFrame  # one row, DATASET_SCHEMA
    columns: DataFrame  # one row per column, columns.COLUMN_SCHEMA
    value_counts: DataFrame  # (column_name, unique_values, value, cnt) of the categorical columns
    class_counts: DataFrame | None  # (class_value, cnt) of the label column


def profile(df: DataFrame, dataset_id: str | None = None, file_format: str = "csv", size_bytes: int = 0,
            filename: str | None = None, sample_limit: int | None = None, duplicates: str = "fingerprint",
            map_limit: int = quantiles.MAP_LIMIT, fhir: bool = False, class_map_limit: int = CLASS_MAP_LIMIT,
            sample_key: list[str] | None = None, malformed_rows: int = 0, read_error: str | None = None) -> TableProfile:
    """Profile a table of any size.

    Scans: fused column facts, quartiles, outliers, duplicates, value counts. The driver receives
    only per-column numbers and the value counts of categorical columns (at most 50 values each).
    With `sample_limit` a larger table is reduced to that many rows first, drawn once and stored, so that every part of
    the profile describes the same rows; the row count stays full. The one-row class map holds the `class_map_limit` most
    frequent classes (ties by value) and says whether it is cut; `class_counts` always has all of them, and the ratio
    and the binary flag are those of all classes. `malformed_rows` and `read_error` come from `readers.ingest`."""
    spark = df.sparkSession
    full_rows, sampled = None, False
    if sample_limit is not None:
        full_rows = df.count()
        if full_rows > sample_limit:
            path = scratch_path(spark, "profile-sample")
            rowops.sample_rows(df, sample_limit, key=sample_key).write.parquet(path)
            df, sampled = spark.read.schema(df.schema).parquet(path), True
    kept = df.schema.fields
    flat = col.prepared(df)
    rows, facts = col.scan(flat)
    col.add_spread(flat, rows, facts, map_limit)

    near = [f.name for f in facts if f.kind in ("text", "boolean") and f.stats["distinct"] <= col.CANDIDATE_LIMIT]
    counts = col.exact_categories(flat, near)
    by_column: dict[str, dict[str, int]] = {}
    if rows and near:
        for r in counts.collect():  # at most 50 values per column
            by_column.setdefault(r["column_name"], {})[r["value"]] = r["cnt"]
    for f in facts:  # all-missing text counts as categorical with no values
        if f.kind in ("text", "boolean") and f.missing == rows:
            by_column[f.name] = {}

    names = [f.name for f in kept] if rows else []
    found = headers.table_headers([f.name for f in kept])
    roles = headers.table_roles([f.name for f in kept])
    total_missing, cell_count = sum(f.missing for f in facts), rows * len(facts)
    codes = col.standards(facts, rows)
    dup = rowops.duplicate_counts(df, duplicates).first() if rows and facts else None

    label, label_counts, class_map, binary, ratio, cut = roles["label_column"], None, {}, False, None, False
    if label:
        label_counts = rowops.class_counts(df, label)
        if label in by_column:
            class_map = dict(sorted(by_column[label].items(), key=lambda kv: (-kv[1], kv[0])))
            classes = len(class_map)
            binary = classes == 2
            if classes >= 2:
                ratio = col.pct_of(max(class_map.values()), 100 * min(class_map.values()))
        else:
            summary = rowops.label_summary(label_counts).first()
            binary, ratio = summary["binary_label_detected"], summary["imbalance_ratio"]
            top = label_counts.orderBy(F.desc("cnt"), "class_value").limit(class_map_limit)
            class_map = {r["class_value"]: r["cnt"] for r in top.collect()}
            cut = summary["classes"] > class_map_limit

    age, bands = roles["age_column"], None
    if age and cells.is_numeric(df.schema[age].dataType):
        bands = tuple(rowops.age_bands(df, age).first())
    violations = sum(v or 0 for f in facts for k, v in f.stats.items() if k.startswith("word"))

    size = len(names)
    row = (
        dataset_id, (filename, file_format.lower(), size_bytes, "UTF-8"), (full_rows if sampled else rows, size),
        (any(found[f] for f in fixed.DIRECT_FAMILIES), *[found[f] for f in ("name", "phone", "id", "gps", "dob")]),
        (col.pct_of(cell_count - total_missing, cell_count),
         [f.name for f in facts if rows and 10 * (rows - f.missing) < 9 * rows],
         [f.name for f in facts if rows and 2 * (rows - f.missing) < rows]),
        (dup["exact_duplicate_rows"], dup["exact_duplicate_pct"]) if dup else (0, 0.0),
        (bool(codes["icd"]), codes["icd"], bool(codes["snomed"]), codes["snomed"], bool(codes["loinc"]), codes["loinc"], fhir),
        (roles["split_column_detected"], roles["fold_column_detected"]),
        (binary, label, class_map, ratio, cut), bands,
        (col.pct_of(rows - violations, rows, 100.0) if violations <= rows
         else -col.pct_of(violations - rows, rows), violations),
        sampled, sample_limit if sampled else None, fixed.PROFILER_VERSION, malformed_rows, read_error,
    )
    dataset = spark.createDataFrame([row], DATASET_SCHEMA)
    column_rows = [tuple(col.column_row(f, rows, by_column.get(f.name))) for f in facts]
    return TableProfile(dataset, spark.createDataFrame(column_rows, col.COLUMN_SCHEMA), counts, label_counts)


def facts_of(dataset: DataFrame) -> DataFrame:
    """The profile facts scorers read, one flat row per dataset."""
    return dataset.select(
        "dataset_id", F.col("file.format").alias("file_format"), F.col("file.size_bytes").alias("size_bytes"),
        F.col("shape.rows").alias("rows"), F.col("shape.columns").alias("columns"),
        F.col("completeness.overall_pct").alias("overall_completeness_pct"),
        F.col("pii_scan.direct_identifiers_detected").alias("direct_identifiers_detected"),
        *[F.col(f"standards_detected.{c}") for c in ("icd_codes_present", "snomed_codes_present",
                                                     "loinc_codes_present", "fhir_structure")],
        F.col("label_columns.imbalance_ratio").alias("imbalance_ratio"), "sampled", "sample_rows")
