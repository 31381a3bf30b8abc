"""Profile operators over the derived patient, code, column and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions import cells, fixed
from assayframe.operators import columns as col
from assayframe.operators import grouped, headers
from assayframe.operators import rows as rowops
from assayframe.plans import datasets, incremental
from assayframe.plans import profile as plan
from assayframe.session import scratch_path
from registered.fixtures import cte, table, view

QUERIES = {}
ORACLE = {}


def pct_sql(part: str, whole: str, empty: str = "0.0") -> str:
    return f"CASE WHEN ({whole}) > 0 THEN ((20000 * ({part}) + ({whole})) // (2 * ({whole}))) / 100.0 ELSE {empty} END"


PATIENT_NUMERIC = ["id", "age", "bmi", "district_id", "balance"]
PATIENT_TEXT = ["sex", "patient_name", "site", "treatment_outcome"]
LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NUMERIC_COLS = ["name", "dtype", "missing_count", "completeness_pct", "min", "max", "mean", "median", "std", "outlier_pct", "range_violation"]


def _numeric_profile(df):
    flat = col.prepared(df)
    rows, facts = col.scan(flat)
    col.add_spread(flat, rows, facts)
    out = [tuple(col.column_row(f, rows, None)) for f in facts if f.kind == "numeric"]
    return df.sparkSession.createDataFrame(out, col.COLUMN_SCHEMA).select(*_NUMERIC_COLS)


def _numeric_sql(source: str, names: list[str]) -> str:
    parts = []
    for c in names:
        rule = headers.range_rule(c)
        bad = f"coalesce(bool_or(v < {rule[0]} OR v > {rule[1]}), false)" if rule else "false"
        parts.append(f"""SELECT '{c}' AS name, 'numeric' AS dtype, count(*) - count(v) AS missing_count, {pct_sql('count(v)', 'count(*)')} AS completeness_pct,
  min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(any_value(q2), 4) AS median, round(coalesce(stddev_samp(v), 0.0), 4) AS std,
  {pct_sql('count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))', 'count(v)')} AS outlier_pct, {bad} AS range_violation
FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source}), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
  quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source})""")
    return "\nUNION ALL ".join(parts)


QUERIES["profile_numeric"] = lambda s, d: _numeric_profile(view(s, d, "fx_patients"))
ORACLE["profile_numeric"] = cte("fx_patients") + _numeric_sql("fx_patients", PATIENT_NUMERIC)
QUERIES["profile_numeric_lineitem"] = lambda s, d: _numeric_profile(table(s, d, "lineitem"))
ORACLE["profile_numeric_lineitem"] = _numeric_sql("lineitem", LINE_NUMERIC)


def q_completeness(spark, sf_dir):
    df = col.prepared(view(spark, sf_dir, "fx_patients"))
    names = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(cells.quoted(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)])
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"m{i}").alias("missing_count")) for i, n in enumerate(names)])
    overall = cells.pct(F.col("rows") * len(names) - sum((F.col(f"m{i}") for i in range(len(names))), F.lit(0)),
                        F.col("rows") * len(names))
    rows = agg.select("rows", overall.alias("overall_pct"), F.inline(items))
    present = F.col("rows") - F.col("missing_count")
    return rows.select("name", "rows", "missing_count", cells.pct(present, F.col("rows")).alias("completeness_pct"),
                       (present * 10 < F.col("rows") * 9).alias("below_90pct"),
                       (present * 2 < F.col("rows")).alias("below_50pct"), "overall_pct")


QUERIES["profile_completeness"] = q_completeness
_ALL = PATIENT_NUMERIC + PATIENT_TEXT
ORACLE["profile_completeness"] = (
    cte("fx_patients") + ", m AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS missing_count FROM fx_patients" for c in _ALL)
    + f""") SELECT name, rows, missing_count, {pct_sql('rows - missing_count', 'rows')} AS completeness_pct,
  (rows - missing_count) * 10 < rows * 9 AS below_90pct, (rows - missing_count) * 2 < rows AS below_50pct,
  (SELECT {pct_sql('CAST(sum(rows - missing_count) AS BIGINT)', 'CAST(sum(rows) AS BIGINT)')} FROM m) AS overall_pct FROM m""")

QUERIES["profile_value_counts"] = lambda s, d: col.value_counts(view(s, d, "fx_patients"))
ORACLE["profile_value_counts"] = (
    cte("fx_patients") + ", v AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM fx_patients WHERE {c} IS NOT NULL GROUP BY {c}" for c in PATIENT_TEXT)
    + "), u AS (SELECT column_name, count(*) AS unique_values FROM v GROUP BY column_name HAVING count(*) <= 50) "
      "SELECT column_name, unique_values, value, cnt FROM v JOIN u USING (column_name)")
QUERIES["value_counts_orders"] = lambda s, d: col.value_counts(table(s, d, "orders"))
ORACLE["value_counts_orders"] = (
    "WITH v AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM orders GROUP BY {c}" for c in ["o_orderstatus", "o_orderpriority"])
    + "), u AS (SELECT column_name, count(*) AS unique_values FROM v GROUP BY column_name HAVING count(*) <= 50) "
      "SELECT column_name, unique_values, value, cnt FROM v JOIN u USING (column_name)")


def q_types(spark, sf_dir):
    """dtype of every column of every supplied table with its missing count."""
    flat = col.prepared(view(spark, sf_dir, "fx_codes"))
    rows, facts = col.scan(flat)
    near = [f.name for f in facts if f.kind == "text" and f.stats["distinct"] <= col.CANDIDATE_LIMIT]
    sizes = {r["column_name"]: r["unique_values"] for r in
             col.exact_categories(flat, near).select("column_name", "unique_values").distinct().collect()}
    out = [(f.name, f.kind if f.kind != "text" else
            "categorical" if f.name in sizes or f.missing == rows else "string", f.missing) for f in facts]
    return spark.createDataFrame(out, "name string, dtype string, missing_count bigint")


QUERIES["profile_dtypes"] = q_types
ORACLE["profile_dtypes"] = cte("fx_codes") + " UNION ALL ".join(
    ["SELECT 'id' AS name, 'numeric' AS dtype, count(*) - count(id) AS missing_count FROM fx_codes"] + [
        f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'string' END, count(*) - count({c}) FROM fx_codes"
        for c in ["icd_col", "loinc_col", "snomed_col", "mixed_col", "rare_code_col", "empty_col"]])

_DUP_COLS = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_suppkey"]
for _m in ("fingerprint", "rows"):
    QUERIES[f"profile_duplicates_{_m}" if _m == "rows" else "profile_duplicates"] = (
        lambda s, d, m=_m: rowops.duplicate_counts(table(s, d, "lineitem").select(*_DUP_COLS), m))
    ORACLE[f"profile_duplicates_{_m}" if _m == "rows" else "profile_duplicates"] = (
        f"SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_rows, "
        f"{pct_sql('CAST(sum(n - 1) AS BIGINT)', 'CAST(sum(n) AS BIGINT)')} AS exact_duplicate_pct "
        f"FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(_DUP_COLS)})")
QUERIES["duplicates_all_columns"] = lambda s, d: rowops.duplicate_counts(table(s, d, "lineitem"))
ORACLE["duplicates_all_columns"] = (
    f"SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS exact_duplicate_rows, "
    f"{pct_sql('CAST(sum(n - 1) AS BIGINT)', 'CAST(sum(n) AS BIGINT)')} AS exact_duplicate_pct FROM (SELECT count(*) AS n FROM lineitem GROUP BY ALL l_orderkey)")
ORACLE["duplicates_all_columns"] = ORACLE["duplicates_all_columns"].replace(
    "GROUP BY ALL l_orderkey", "GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")

_GROUP_COLS = ["dtype", "rows", "missing_count", "completeness_pct", "min", "max", "mean", "median", "std", "outlier_pct", "range_violation", "distinct_values"]


def _grouped_sql(source: str, key: str, numeric: list[str], text: list[str], stamps: list[str] = ()) -> str:
    parts = []
    for c in numeric:
        rule = headers.range_rule(c)
        bad = f"coalesce(bool_or(v < {rule[0]} OR v > {rule[1]}), false)" if rule else "false"
        parts.append(f"""SELECT {key}, '{c}' AS column_name, 'numeric' AS dtype, count(*) AS rows, count(*) - count(v) AS missing_count,
  {pct_sql('count(v)', 'count(*)')} AS completeness_pct, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(any_value(q2), 4) AS median,
  CASE WHEN count(v) > 0 THEN round(coalesce(stddev_samp(v), 0.0), 4) END AS std,
  CASE WHEN count(v) > 0 THEN {pct_sql('count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1))', 'count(v)')} END AS outlier_pct,
  CASE WHEN count(v) > 0 THEN {bad} END AS range_violation, CAST(NULL AS BIGINT) AS distinct_values
FROM (SELECT {key}, CAST({c} AS DOUBLE) AS v FROM {source}) JOIN (SELECT {key}, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
  quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {source} GROUP BY {key}) USING ({key}) GROUP BY {key}""")
    for c in [*text, *stamps]:
        kind = "'datetime'" if c in stamps else f"CASE WHEN count(DISTINCT {c}) <= 50 THEN 'categorical' ELSE 'string' END"
        parts.append(f"""SELECT {key}, '{c}', {kind}, count(*), count(*) - count({c}), {pct_sql(f'count({c})', 'count(*)')},
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(DISTINCT {c}) FROM {source} GROUP BY {key}""")
    return "\nUNION ALL ".join(parts)


QUERIES["profile_by_group"] = lambda s, d: grouped.profile_by(table(s, d, "events"), ["event_type"]).select("event_type", "column_name", *_GROUP_COLS)
ORACLE["profile_by_group"] = _grouped_sql("events", "event_type", ["event_id", "user_id", "value"], ["props"], ["ts"])
QUERIES["profile_patients_by_site"] = lambda s, d: grouped.profile_by(
    view(s, d, "fx_patients"), ["treatment_outcome"]).select("treatment_outcome", "column_name", *_GROUP_COLS)
ORACLE["profile_patients_by_site"] = cte("fx_patients") + _grouped_sql("fx_patients", "treatment_outcome", PATIENT_NUMERIC, ["sex", "patient_name", "site"])


def _joined(names):
    return [F.array_join(n, ",").alias(n) for n in names]


_FAMILY_COLS = [f"{f}_columns" for f in fixed.HEADER_FAMILIES]


def q_headers(spark, sf_dir):
    found = headers.scan_headers(view(spark, sf_dir, "fx_columns"))
    return found.select("dataset_id", "direct_identifiers_detected", *_joined(_FAMILY_COLS))


def _rx(family: str) -> str:
    return f"regexp_matches(column_name, '{headers.family_pattern(family)}')"


QUERIES["pii_header_scan"] = q_headers
ORACLE["pii_header_scan"] = (
    cte("fx_columns") + "SELECT dataset_id, bool_or(" + " OR ".join(_rx(f) for f in fixed.DIRECT_FAMILIES)
    + ") AS direct_identifiers_detected, " + ", ".join(
        f"coalesce(string_agg(column_name, ',' ORDER BY ord) FILTER ({_rx(f)}), '') AS {f}_columns" for f in fixed.HEADER_FAMILIES)
    + " FROM fx_columns GROUP BY dataset_id")

QUERIES["column_pii_flag"] = lambda s, d: headers.flag_columns(view(s, d, "fx_columns"))
_FLAG = "CASE " + " ".join(f"WHEN {_rx(f)} THEN '{f}_pattern'" for f in fixed.HEADER_FAMILIES) + " END"
ORACLE["column_pii_flag"] = cte("fx_columns") + f"SELECT dataset_id, ord, column_name, {_FLAG} AS pii_flag, CASE WHEN {_FLAG} IS NOT NULL THEN 'High' END AS pii_confidence FROM fx_columns"

QUERIES["split_label_age_detect"] = lambda s, d: headers.detect_roles(view(s, d, "fx_columns"))


def _first_sql(words: list[str]) -> str:
    rank = "CASE lower(column_name) " + " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(words)) + " END"
    return f"arg_min(column_name, ({rank}) * 1000 - ord) FILTER (({rank}) IS NOT NULL)"


_IN = lambda words: "bool_or(lower(column_name) IN (" + ", ".join(f"'{w}'" for w in words) + "))"
ORACLE["split_label_age_detect"] = (
    cte("fx_columns") + f"SELECT dataset_id, {_IN(fixed.SPLIT_NAMES)} AS split_column_detected, {_IN(fixed.FOLD_NAMES)} AS fold_column_detected, "
    f"{_first_sql(fixed.LABEL_NAMES)} AS label_column, {_first_sql(fixed.AGE_NAMES)} AS age_column FROM fx_columns GROUP BY dataset_id")


def q_standards(spark, sf_dir):
    df = view(spark, sf_dir, "fx_codes")
    names = [f.name for f in df.schema.fields if cells.is_text(f.dataType)]
    aggs = [F.count(cells.quoted(n)).alias(f"n{i}") for i, n in enumerate(names)]
    for i, n in enumerate(names):
        aggs += [F.count_if(col.code_match(cells.quoted(n), c)).alias(f"{c}{i}") for c in fixed.CODE_PATTERNS]
    agg = df.agg(*aggs)
    rows = agg.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("column_name"), F.col(f"n{i}").alias("present"),
        *[F.col(f"{c}{i}").alias(f"{c}_matches") for c in fixed.CODE_PATTERNS]) for i, n in enumerate(names)])))
    return rows.select("*", *[(F.col(f"{c}_matches") * 2 > F.col("present")).alias(f"{c}_detected") for c in fixed.CODE_PATTERNS])


QUERIES["standards_detect"] = q_standards
ORACLE["standards_detect"] = cte("fx_codes") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS present, " + ", ".join(
        f"count(*) FILTER (regexp_matches(trim({c}), '{p}')) AS {k}_matches" for k, p in fixed.CODE_PATTERNS.items()) + ", " + ", ".join(
        f"count(*) FILTER (regexp_matches(trim({c}), '{p}')) * 2 > count({c}) AS {k}_detected" for k, p in fixed.CODE_PATTERNS.items())
    + " FROM fx_codes" for c in ["icd_col", "loinc_col", "snomed_col", "mixed_col", "rare_code_col", "empty_col"])

QUERIES["class_distribution"] = lambda s, d: rowops.class_counts(view(s, d, "fx_patients"), "treatment_outcome")
ORACLE["class_distribution"] = cte("fx_patients") + "SELECT treatment_outcome AS class_value, count(*) AS cnt FROM fx_patients WHERE treatment_outcome IS NOT NULL GROUP BY 1"
QUERIES["label_balance"] = lambda s, d: rowops.label_summary(rowops.class_counts(view(s, d, "fx_patients"), "treatment_outcome"))
ORACLE["label_balance"] = (cte("fx_patients") + ", c AS (SELECT count(*) AS n FROM fx_patients WHERE treatment_outcome IS NOT NULL GROUP BY treatment_outcome) "
                           f"SELECT count(*) AS classes, count(*) = 2 AS binary_label_detected, CASE WHEN count(*) >= 2 THEN {pct_sql('max(n)', 'min(n) * 100')} END AS imbalance_ratio FROM c")
QUERIES["age_bands"] = lambda s, d: rowops.age_bands(view(s, d, "fx_patients"), "age")
ORACLE["age_bands"] = (cte("fx_patients") + f"SELECT min(age) AS min, max(age) AS max, {pct_sql('count(*) FILTER (age < 18)', 'count(age)')} AS under_18_pct, "
                       f"{pct_sql('count(*) FILTER (age BETWEEN 18 AND 60)', 'count(age)')} AS \"18_to_60_pct\", {pct_sql('count(*) FILTER (age > 60)', 'count(age)')} AS over_60_pct FROM fx_patients")
QUERIES["schema_violations"] = lambda s, d: rowops.conformance(view(s, d, "fx_patients"))
_VIOL = "count(*) FILTER (age < 0 OR age > 150) + count(*) FILTER (bmi < 5 OR bmi > 100)"
ORACLE["schema_violations"] = (cte("fx_patients") + f"SELECT count(*) AS rows, {_VIOL} AS schema_violations, {pct_sql(f'count(*) - ({_VIOL})', 'count(*)')} AS conformant_rows_pct FROM fx_patients")

QUERIES["sample_rows"] = lambda s, d: rowops.sample_rows(
    table(s, d, "lineitem"), 5000, key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")
_SKEY = "concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
ORACLE["sample_rows"] = f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY substr(md5({_SKEY}), 1, 13), l_orderkey, l_linenumber, l_partkey LIMIT 5000"


def q_profile_table(spark, sf_dir):
    """Headline facts of the full single-table profile."""
    done = plan.profile(view(spark, sf_dir, "fx_patients"), dataset_id="patients", file_format="parquet")
    return done.dataset.select(
        "dataset_id", "shape.rows", "shape.columns", "completeness.overall_pct",
        F.array_join("completeness.columns_below_90pct", ",").alias("below_90"),
        F.array_join("completeness.columns_below_50pct", ",").alias("below_50"),
        "duplicates.exact_duplicate_rows", "pii_scan.direct_identifiers_detected",
        F.array_join("pii_scan.name_columns", ",").alias("name_columns"), F.array_join("pii_scan.id_columns", ",").alias("id_columns"),
        "label_columns.label_column", "label_columns.binary_label_detected", "label_columns.imbalance_ratio",
        F.col("age_distribution.under_18_pct"), "schema_consistency.schema_violations", "schema_consistency.conformant_rows_pct")


QUERIES["profile_table"] = q_profile_table
_N = len(_ALL)
_FILLED = " + ".join(f"count({c})" for c in _ALL)
ORACLE["profile_table"] = (
    cte("fx_patients") + f"""SELECT 'patients' AS dataset_id, count(*) AS rows, {_N} AS columns, {pct_sql(_FILLED, f'count(*) * {_N}')} AS overall_pct,
  concat_ws(',', {', '.join(f"CASE WHEN count({c}) * 10 < count(*) * 9 THEN '{c}' END" for c in ['age', 'bmi', 'sex', 'patient_name', 'site', 'treatment_outcome'])}) AS below_90,
  concat_ws(',', {', '.join(f"CASE WHEN count({c}) * 2 < count(*) THEN '{c}' END" for c in ['age', 'bmi', 'sex', 'patient_name', 'site', 'treatment_outcome'])}) AS below_50,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fx_patients)) AS exact_duplicate_rows, true AS direct_identifiers_detected,
  'patient_name' AS name_columns, 'id' AS id_columns, 'treatment_outcome' AS label_column, false AS binary_label_detected,
  (SELECT {pct_sql('max(n)', 'min(n) * 100')} FROM (SELECT count(*) AS n FROM fx_patients GROUP BY treatment_outcome)) AS imbalance_ratio,
  {pct_sql('count(*) FILTER (age < 18)', 'count(age)')} AS under_18_pct, {_VIOL} AS schema_violations,
  {pct_sql(f'count(*) - ({_VIOL})', 'count(*)')} AS conformant_rows_pct FROM fx_patients""")


# ---- many datasets in one job ----------------------------------------------------------

CODE_COLS = ["id", "icd_col", "loinc_col", "snomed_col", "mixed_col", "rare_code_col", "empty_col"]


def datasets_of(spark, sf_dir):
    """Patients by site and codes in seven parts: datasets of two layouts in one table, and each dataset's own columns."""
    patients = view(spark, sf_dir, "fx_patients").withColumnRenamed("site", "ds")
    codes = view(spark, sf_dir, "fx_codes").withColumn("ds", F.concat(F.lit("codes-"), (F.col("id") % 7).cast("string")))
    own = []
    for df in (patients, codes):
        names = [c for c in df.columns if c != "ds"]
        listed = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(i).alias("ord")) for i, n in enumerate(names)])
        own.append(df.select(F.col("ds").alias("dataset_id")).distinct().select("dataset_id", F.inline(listed)))
    return patients.unionByName(codes, allowMissingColumns=True), own[0].unionAll(own[1])


def q_facts_by_group(spark, sf_dir):
    """Every fact of the dataset profile for every dataset."""
    df, own = datasets_of(spark, sf_dir)
    found = datasets.profile_datasets(df, "ds", own, file_format="parquet")
    classes = F.array_sort(F.transform(F.map_entries("label_columns.class_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    joined = [F.array_join(c, ",").alias(c.split(".")[1]) for c in (
        "completeness.columns_below_90pct", "completeness.columns_below_50pct", "pii_scan.name_columns", "pii_scan.phone_columns", "pii_scan.id_columns",
        "pii_scan.gps_columns", "pii_scan.dob_columns", "standards_detected.icd_columns", "standards_detected.snomed_columns", "standards_detected.loinc_columns")]
    return found.select("dataset_id", "file.format", "shape.rows", "shape.columns", "completeness.overall_pct", *joined, "pii_scan.direct_identifiers_detected", "duplicates.*",
                        "standards_detected.icd_codes_present", "standards_detected.snomed_codes_present", "standards_detected.loinc_codes_present", "split_columns.*",
                        "label_columns.label_column", "label_columns.binary_label_detected", "label_columns.imbalance_ratio", F.array_join(classes, ",").alias("classes"),
                        F.col("age_distribution.min").alias("age_min"), F.col("age_distribution.max").alias("age_max"),
                        *[F.col(f"age_distribution.{c}").alias(f"age_{c}") for c in ("under_18_pct", "18_to_60_pct", "over_60_pct")], "schema_consistency.*")


def _below(names: list[str], test: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN count({c}) * {test} THEN '{c}' END" for c in names) + ")"


def _codes_in(code: str) -> str:
    pattern = {"icd": r"^[A-Z]\d{2}(\.\d{1,4})?$", "snomed": r"^\d{6,18}$", "loinc": r"^\d{1,5}-\d$"}[code]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN count(*) FILTER (regexp_matches(trim({c}), '{pattern}')) * 2 > count({c}) THEN '{c}' END" for c in CODE_COLS[1:]) + ")"


_SITE_COLS = ["id", "age", "bmi", "sex", "patient_name", "treatment_outcome", "district_id", "balance"]


def code_facts_sql() -> str:
    return f"""SELECT concat('codes-', id % 7) AS dataset_id, 'parquet' AS format, count(*) AS rows, 7 AS columns, {pct_sql(' + '.join(f'count({c})' for c in CODE_COLS), 'count(*) * 7')} AS overall_pct,
  {_below(CODE_COLS, '10 < count(*) * 9')} AS columns_below_90pct, {_below(CODE_COLS, '2 < count(*)')} AS columns_below_50pct, '' AS name_columns, '' AS phone_columns, 'id' AS id_columns, '' AS gps_columns, '' AS dob_columns,
  {_codes_in('icd')} AS icd_columns, {_codes_in('snomed')} AS snomed_columns, {_codes_in('loinc')} AS loinc_columns, false AS direct_identifiers_detected,
  count(*) - count(DISTINCT ({', '.join(CODE_COLS)})) AS exact_duplicate_rows, {pct_sql(f"count(*) - count(DISTINCT ({', '.join(CODE_COLS)}))", 'count(*)')} AS exact_duplicate_pct,
  {_codes_in('icd')} <> '' AS icd_codes_present, {_codes_in('snomed')} <> '' AS snomed_codes_present, {_codes_in('loinc')} <> '' AS loinc_codes_present,
  false AS split_column_detected, false AS fold_column_detected, NULL AS label_column, false AS binary_label_detected, CAST(NULL AS DOUBLE) AS imbalance_ratio, '' AS classes, CAST(NULL AS DOUBLE) AS age_min, CAST(NULL AS DOUBLE) AS age_max,
  CAST(NULL AS DOUBLE) AS age_under_18_pct, CAST(NULL AS DOUBLE) AS age_18_to_60_pct, CAST(NULL AS DOUBLE) AS age_over_60_pct, 100.0 AS conformant_rows_pct, 0 AS schema_violations FROM fx_codes GROUP BY id % 7"""


QUERIES["facts_by_group"] = q_facts_by_group
ORACLE["facts_by_group"] = cte("fx_patients", "fx_codes") + f""", n AS (SELECT site, treatment_outcome AS value, count(*) AS n FROM fx_patients WHERE treatment_outcome IS NOT NULL GROUP BY ALL),
c AS (SELECT site, count(*) AS classes, {pct_sql('max(n)', 'min(n) * 100')} AS ratio, string_agg(concat(value, ':', n), ',' ORDER BY value) AS shown FROM n GROUP BY site),
p AS (SELECT site AS dataset_id, 'parquet' AS format, count(*) AS rows, 8 AS columns, {pct_sql(' + '.join(f'count({c})' for c in _SITE_COLS), 'count(*) * 8')} AS overall_pct,
  {_below(_SITE_COLS, '10 < count(*) * 9')} AS columns_below_90pct, {_below(_SITE_COLS, '2 < count(*)')} AS columns_below_50pct, 'patient_name' AS name_columns, '' AS phone_columns, 'id' AS id_columns, '' AS gps_columns, '' AS dob_columns,
  '' AS icd_columns, '' AS snomed_columns, '' AS loinc_columns, true AS direct_identifiers_detected, count(*) - count(DISTINCT ({', '.join(_SITE_COLS)})) AS exact_duplicate_rows,
  {pct_sql(f"count(*) - count(DISTINCT ({', '.join(_SITE_COLS)}))", 'count(*)')} AS exact_duplicate_pct, false AS icd_codes_present, false AS snomed_codes_present, false AS loinc_codes_present, false AS split_column_detected, false AS fold_column_detected,
  'treatment_outcome' AS label_column, any_value(classes) = 2 AS binary_label_detected, CASE WHEN any_value(classes) >= 2 THEN any_value(ratio) END AS imbalance_ratio, any_value(shown) AS classes, min(age) AS age_min, max(age) AS age_max,
  {pct_sql('count(*) FILTER (age < 18)', 'count(age)')} AS age_under_18_pct, {pct_sql('count(*) FILTER (age BETWEEN 18 AND 60)', 'count(age)')} AS age_18_to_60_pct, {pct_sql('count(*) FILTER (age > 60)', 'count(age)')} AS age_over_60_pct,
  {pct_sql(f'count(*) - ({_VIOL})', 'count(*)')} AS conformant_rows_pct, {_VIOL} AS schema_violations FROM (SELECT t.*, c.classes, c.ratio, c.shown FROM fx_patients t JOIN c ON t.site IS NOT DISTINCT FROM c.site) GROUP BY site)
SELECT * FROM p UNION ALL BY NAME """ + code_facts_sql()


# ---- profile that grows by partitions --------------------------------------------------

def q_incremental(spark, sf_dir):
    """Line items arrive by year, in two loads and one year again; the whole is put together from states and held against all rows."""
    df = table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    path = scratch_path(spark, "profile-states")
    for load in (df.where("year < 1995"), df.where("year >= 1995 or year is null"), df.where("year = 1994")):
        incremental.add_parts(load, "year", path)
    found = incremental.merged(incremental.read_states(spark, path))
    errors = incremental.rank_errors(df, found).withColumnRenamed("column_name", "_c")
    exact = grouped.unpivot(df, ["year"]).groupBy("column_name", "num", "txt").count().where("num is not null or txt is not null").groupBy(F.col("column_name").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    top = F.when(F.col("kind") == "text", F.col("top_values")[0])
    return (found.join(errors, F.col("column_name") == F.col("_c"), "left").join(exact, F.col("column_name") == F.col("_d")).select(
        "column_name", "kind", "parts", "rows", "missing_count", "completeness_pct", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        (F.col("rank_error") <= incremental.RANK_ERROR).alias("quartiles_hold"), (F.abs(F.col("distinct_estimate") - F.col("_n")) <= F.col("_n") * incremental.DISTINCT_ERROR).alias("distinct_holds"),
        top["item"].alias("most_frequent"), top["count"].alias("most_frequent_count")))


QUERIES["profile_incremental"] = q_incremental
_YEARS = "(SELECT count(*) FROM (SELECT DISTINCT year(l_shipdate) FROM lineitem))"
_SHIPPED = "UNION ALL SELECT 'l_shipdate', 'datetime', {y}, count(*), count(*) - count(l_shipdate), {p}, NULL, NULL, NULL, NULL, NULL, true, NULL, NULL FROM lineitem"
ORACLE["profile_incremental"] = "\nUNION ALL ".join(
    [f"SELECT '{c}' AS column_name, 'numeric' AS kind, {_YEARS} AS parts, count(*) AS rows, count(*) - count({c}) AS missing_count, {pct_sql(f'count({c})', 'count(*)')} AS completeness_pct, CAST(min({c}) AS DOUBLE) AS min, "
     f"CAST(max({c}) AS DOUBLE) AS max, round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, true AS quartiles_hold, true AS distinct_holds, CAST(NULL AS VARCHAR) AS most_frequent, CAST(NULL AS BIGINT) AS most_frequent_count FROM lineitem"
     for c in LINE_NUMERIC]
    + [f"SELECT '{c}', 'text', {_YEARS}, count(*), count(*) - count({c}), {pct_sql(f'count({c})', 'count(*)')}, NULL, NULL, NULL, NULL, NULL, true, "
       f"(SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC LIMIT 1), (SELECT count(*) FROM lineitem GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) FROM lineitem" for c in ("l_returnflag", "l_linestatus")]
) + "\n" + _SHIPPED.format(y=_YEARS, p=pct_sql("count(l_shipdate)", "count(*)"))


# ---- codes among the first values ------------------------------------------------------

QUERIES["standards_ordered"] = lambda s, d: col.standards_in_order(view(s, d, "fx_codes"), ["id"])
ORACLE["standards_ordered"] = cte("fx_codes") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS judged, " + ", ".join(f"count(*) FILTER (regexp_matches(trim(v), '{p}')) AS {k}_matches" for k, p in fixed.CODE_PATTERNS.items()) + ", "
    + ", ".join(f"count(*) FILTER (regexp_matches(trim(v), '{p}')) * 2 > count(*) AS {k}_detected" for k, p in fixed.CODE_PATTERNS.items())
    + f" FROM (SELECT {c} AS v, row_number() OVER (ORDER BY id) AS place FROM fx_codes WHERE {c} IS NOT NULL) WHERE place <= 500" for c in CODE_COLS[1:])
