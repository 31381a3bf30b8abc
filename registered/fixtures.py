"""Deterministic views over the supplied tables. One text serves Spark SQL and the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = {'fx_patients': 'customer',
           'fx_codes': 'part',
           'fx_columns': 'nation',
           'fx_catalog': 'orders',
           'fx_assessments': 'orders',
           'fx_results': 'orders',
           'fx_audit': 'events'}

SQL = {}

SQL["fx_patients"] = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 97 = 5 THEN CAST(-1 AS DOUBLE)
       WHEN c_custkey % 97 = 6 THEN CAST(151 AS DOUBLE)
       ELSE CAST((c_custkey * 37) % 101 AS DOUBLE) END AS age,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 89 = 3 THEN CAST(120 AS DOUBLE)
       ELSE CAST(150 + (c_custkey * 13) % 250 AS DOUBLE) / 10 END AS bmi,
  CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
  c_name AS patient_name,
  CASE WHEN c_custkey % 3 <> 0 THEN NULL ELSE c_mktsegment END AS site,
  CASE WHEN c_custkey % 10 < 7 THEN 'cured' WHEN c_custkey % 10 < 9 THEN 'completed' ELSE 'failed' END AS treatment_outcome,
  c_nationkey AS district_id, c_acctbal AS balance
FROM customer
"""

SQL["fx_codes"] = """
SELECT p_partkey AS id,
  concat(substr('ABEIJ', CAST(1 + p_partkey % 5 AS INT), 1), lpad(CAST(p_partkey % 100 AS STRING), 2, '0')) AS icd_col,
  concat(CAST(1 + p_partkey % 99999 AS STRING), '-', CAST(p_partkey % 10 AS STRING)) AS loinc_col,
  CAST(100000 + p_partkey * 7 AS STRING) AS snomed_col,
  CASE WHEN p_partkey % 2 = 0 THEN concat('A', lpad(CAST(p_partkey % 100 AS STRING), 2, '0')) ELSE p_brand END AS mixed_col,
  CASE WHEN p_partkey % 4 = 0 THEN 'A09.9' ELSE p_type END AS rare_code_col,
  CASE WHEN p_partkey >= 0 THEN NULL ELSE p_name END AS empty_col
FROM part
"""

SQL["fx_columns"] = """
SELECT n_nationkey AS dataset_id, v.ord, v.column_name
FROM nation CROSS JOIN (VALUES
  (1,'id'),(2,'patient_name'),(3,'c_name'),(4,'Full-Name'),(5,'patient id'),(6,'phone'),(7,'contact_no'),(8,'mobile'),
  (9,'lat'),(10,'lon'),(11,'geo_code'),(12,'dob'),(13,'birth_year'),(14,'age'),(15,'age_years'),(16,'dosage'),
  (17,'bmi'),(18,'sex'),(19,'split'),(20,'cv_fold'),(21,'label'),(22,'outcome'),(23,'diagnosis'),(24,'mrn'),
  (25,'page'),(26,'BMI score'),(27,'result'),(28,'subset'),(29,'Y'),(30,'value')) AS v(ord, column_name)
WHERE (n_nationkey * 7 + v.ord * 5) % 4 <> 0
"""

SQL["fx_catalog"] = """
SELECT o_orderkey AS dataset_id,
  CASE WHEN o_orderkey % 13 = 0 THEN '   ' ELSE concat('dataset ', CAST(o_orderkey AS STRING)) END AS dataset_name,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '1.0.0' END AS dataset_version,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'tabular' END AS dataset_type,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'cohort' END AS study_type,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Adults screened at public clinics' END AS target_population,
  CASE o_orderkey % 7 WHEN 0 THEN 'village' WHEN 1 THEN 'taluk' WHEN 2 THEN 'district' WHEN 3 THEN 'state'
       WHEN 4 THEN 'national' WHEN 5 THEN 'multi_country' ELSE NULL END AS geographic_coverage,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS num_sites,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'both' END AS sex_distribution,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS collection_start_date,
  CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE 'Two readers labelled every image independently using one protocol' END AS annotation_methodology,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS num_annotators,
  CASE WHEN o_orderkey % 5 = 2 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS irr_value,
  CASE WHEN o_orderkey % 2 = 0 THEN 'clinician' ELSE NULL END AS annotator_qualifications,
  CASE o_orderkey % 4 WHEN 0 THEN 'ICD-10' WHEN 1 THEN 'none' WHEN 2 THEN 'Custom / Internal coding system'
       WHEN 3 THEN CASE WHEN o_orderkey % 8 = 3 THEN 'SNOMED CT, LOINC' END ELSE NULL END AS standards_used,
  CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE 'IEC/2024/001' END AS ethics_approval_ref,
  CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 'individual' END AS consent_type,
  CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE 'HIPAA Safe Harbor' END AS deidentification_method,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 14 AS INT) END AS k_anonymity_value,
  (o_orderkey % 6 = 1) AS differential_privacy_applied,
  CASE o_orderkey % 8 WHEN 0 THEN 'village' WHEN 1 THEN 'taluk' WHEN 2 THEN 'district' WHEN 3 THEN 'state'
       WHEN 4 THEN 'national' WHEN 5 THEN 'multi_country' WHEN 6 THEN 'none' ELSE NULL END AS location_granularity,
  (o_orderkey % 2 = 0) AS rare_condition_flag,
  CASE WHEN o_orderkey % 10 < 6 THEN 'standard' WHEN o_orderkey % 10 < 9 THEN 'high_stigma' ELSE 'critical' END AS sensitivity_class,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'CC BY-NC 4.0' END AS license_type,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS synthetic_data_pct,
  (o_orderkey % 3 <> 0) AS synthetic_utility_evaluated, (o_orderkey % 5 < 3) AS synthetic_privacy_tested,
  (o_orderkey % 7 < 2) AS equity_analysis_performed, (o_orderkey % 11 < 3) AS community_engagement,
  (o_orderkey % 2 = 1) AS redressal_mechanism_exists, (o_orderkey % 3 = 1) AS dua_required,
  (o_orderkey % 4 <> 2) AS named_steward_exists,
  CASE o_orderkey % 5 WHEN 0 THEN 'fully_compliant' WHEN 1 THEN 'partially_compliant' WHEN 2 THEN 'not_compliant' ELSE NULL END AS dpdp_compliance_status,
  CASE o_orderkey % 6 WHEN 0 THEN 'Publicly downloadable' WHEN 1 THEN 'Formal access request process' WHEN 2 THEN 'Role-based secure enclave'
       WHEN 3 THEN 'named collaborators' WHEN 4 THEN '  ' ELSE NULL END AS access_control_method,
  CAST(o_orderkey % 4 AS INT) AS num_linked_models,
  (o_orderkey % 3 = 0) AS data_dictionary_uploaded, (o_orderkey % 4 < 2) AS provenance_pipeline_available,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://example.org/repo' ELSE NULL END AS github_repo_url,
  (o_orderkey % 5 < 2) AS changelog_provided,
  CASE o_orderkey % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'none' ELSE NULL END AS version_format,
  (o_orderkey % 17 = 0) AS sustainability_info_provided, (o_orderkey % 9 < 4) AS feedback_mechanism_exists,
  CASE o_orderkey % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'parquet' WHEN 2 THEN 'json' WHEN 3 THEN 'xlsx' ELSE 'dcm' END AS file_format,
  (o_orderkey * 1009) % 30000000 AS size_bytes,
  CAST((o_orderkey * 31) % 1001 AS DOUBLE) / 10 AS overall_completeness_pct,
  (o_orderkey % 4 = 0) AS direct_identifiers_detected, (o_orderkey % 5 = 1) AS icd_codes_present,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 60 AS DOUBLE) / 10 END AS imbalance_ratio,
  (o_orderkey % 11 = 2) AS snomed_codes_present, (o_orderkey % 13 = 3) AS loinc_codes_present, (o_orderkey % 17 = 4) AS fhir_structure,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 18 AS INT) END AS age_range_min,
  CASE WHEN o_orderkey % 4 < 2 THEN NULL ELSE CAST(60 + o_orderkey % 40 AS INT) END AS age_range_max,
  CASE o_orderkey % 4 WHEN 0 THEN 'cohen_kappa' WHEN 1 THEN 'fleiss_kappa' WHEN 2 THEN '' ELSE NULL END AS irr_method,
  CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_orderkey % 3 = 2 THEN split('range', ',') ELSE split('range,duplicates,units', ',') END AS dq_checks_applied,
  CASE WHEN o_orderkey % 5 < 3 THEN NULL WHEN o_orderkey % 5 = 3 THEN split('name', ',') ELSE split('name,phone', ',') END AS direct_identifiers_present,
  CASE WHEN o_orderkey % 6 < 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS collection_end_date,
  CASE o_orderkey % 5 WHEN 0 THEN 'daily' WHEN 1 THEN ' monthly ' WHEN 2 THEN '' ELSE NULL END AS temporal_granularity
FROM orders
"""

SQL["fx_assessments"] = """
SELECT o_orderkey AS assessment_id, concat('dataset_', CAST(o_custkey % 200 AS STRING)) AS dataset_id,
  o_custkey AS user_id, o_orderdate AS submission_timestamp,
  CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'complete' END AS status,
  concat('uploads/', CAST(o_orderkey AS STRING), '/file.', CASE o_orderkey % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'parquet'
    WHEN 2 THEN 'exe' WHEN 3 THEN 'JSON' WHEN 4 THEN 'zip' ELSE 'tar.gz' END) AS file_key
FROM orders
"""

SQL["fx_results"] = """
SELECT o_orderkey AS assessment_id, CAST((o_orderkey * 17) % 1001 AS DOUBLE) / 10 AS cqi,
  CAST((o_orderkey * 7) % 101 AS INT) AS prs
FROM orders WHERE o_orderkey % 5 IN (3, 4)
"""

SQL["fx_audit"] = """
SELECT event_id AS log_id, user_id AS assessment_id, ts AS event_timestamp,
  CASE event_type WHEN 'signup' THEN 'assessment_submitted' WHEN 'view' THEN 'assessment_started'
    WHEN 'purchase' THEN 'assessment_complete' WHEN 'error' THEN 'assessment_failed' ELSE 'webhook_sent' END AS event_type,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value, props AS event_detail
FROM events
"""

# fx_catalog with the list-valued field the model linkage score reads
SQL["fx_catalog"] = SQL["fx_catalog"].replace(
    "  CAST(o_orderkey % 4 AS INT) AS num_linked_models,\n",
    "  CAST(o_orderkey % 4 AS INT) AS num_linked_models, o_orderdate AS submitted_at, o_custkey AS owner_id,\n")

HEADER_WORDS = [
    "id", "patient_name", "c_name", "Full-Name", "patient id", "phone", "contact_no", "mobile", "lat", "lon",
    "geo_code", "dob", "birth_year", "age", "age_years", "dosage", "bmi", "sex", "split", "cv_fold", "label",
    "outcome", "diagnosis", "mrn", "page", "BMI score", "result", "subset", "Y", "value",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


PART_ROWS = 200_000  # rows of one part at most, about


def part_count(df: DataFrame, rows: int) -> int:
    """Parts of about `rows` rows, one per core at least. The count reads the files' footers."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, `PART_ROWS` to a part.

    A supplied table is one file with one row group, hence one task; work that is heavy per row gains
    from the extra exchange. The setting `assayframe.spread` = false leaves tables of many files as they are."""
    session = df.sparkSession
    if session.conf.get("assayframe.spread", "true") != "true":
        return df
    # parts of bounded rows keep a task as short and small on a larger table
    return df.repartition(part_count(df, PART_ROWS))


def run_sql(spark: SparkSession, sf_dir: str, text: str, source: str, heavy: bool = False, by: tuple[str, int] | None = None) -> DataFrame:
    """Run a one-table SELECT text over a supplied table, dealt as for `spread` if heavy, or `by` a column into a number of parts."""
    escaped = text.replace("{", "{{").replace("}", "}}")
    base = table(spark, sf_dir, source)
    base = base.repartition(by[1], by[0]) if by else spread(base) if heavy else base
    return spark.sql(escaped.replace(f"FROM {source}", "FROM {base}"), base=base)


def view(spark: SparkSession, sf_dir: str, name: str, by: tuple[str, int] | None = None) -> DataFrame:
    """The named fixture as a DataFrame; `by`: column of its source and number of parts to deal it into."""
    if name == "fx_columns":
        words = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(w).alias("column_name"))
                          for i, w in enumerate(HEADER_WORDS)])
        rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dataset_id"), F.inline(words))
        return rows.where((F.col("dataset_id") * 7 + F.col("ord") * 5) % 4 != 0)
    df = run_sql(spark, sf_dir, SQL[name], SOURCES[name], heavy=name == "fx_catalog", by=by)
    if name == "fx_catalog":
        df = df.withColumn("linked_model_ids", F.expr(
            "transform(slice(array(1, 2, 3), 1, num_linked_models), x -> concat('model-', cast(x as string)))"))
    return df


def cte(*names: str) -> str:
    """WITH clause defining the named fixtures for the checking engine."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in names) + "\n"
