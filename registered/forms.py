"""Form validation, defaults, merges, wizard gating and upload manifests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from assayframe.functions import fixed, schema
from assayframe.operators import validation as val
from assayframe.sources import files
from registered.fixtures import cte, run_sql, view

QUERIES = {}
ORACLE = {}

AS_OF = dt.date(1998, 1, 1)

# Broken forms: values out of range, dates out of order, wrong words, short texts.
FORM_SQL = """
SELECT o_orderkey AS dataset_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'abc' ELSE 'dataset name' END AS dataset_name,
  CASE WHEN o_orderkey % 50 = 3 THEN repeat('9', 101) ELSE '1.0.0' END AS dataset_version,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN 'video' ELSE 'tabular' END AS dataset_type,
  CASE WHEN o_orderkey % 6 = 0 THEN 'survey' ELSE 'RCT' END AS study_type,
  CASE WHEN o_orderkey % 5 = 0 THEN 'adults' ELSE 'Adults screened at public clinics' END AS target_population,
  CASE o_orderkey % 4 WHEN 0 THEN 'galaxy' WHEN 1 THEN NULL ELSE 'state' END AS geographic_coverage,
  CAST(o_orderkey % 140 - 10 AS INT) AS age_range_min, CAST(o_orderkey % 125 AS INT) AS age_range_max,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'both' END AS sex_distribution,
  CAST(o_orderkey % 3 AS INT) AS num_sites,
  CAST(o_orderdate AS DATE) AS collection_start_date,
  CASE WHEN o_orderkey % 11 = 0 THEN CAST('1995-06-01' AS DATE) WHEN o_orderkey % 11 = 1 THEN CAST('2030-01-01' AS DATE) ELSE NULL END AS collection_end_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'short' ELSE NULL END AS annotation_methodology,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 4 - 1 AS INT) END AS num_annotators,
  CASE WHEN o_orderkey % 2 = 0 THEN 'kappa' ELSE NULL END AS irr_method,
  CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE CAST(o_orderkey % 13 AS DOUBLE) / 10 END AS irr_value,
  CASE WHEN o_orderkey % 6 = 2 THEN 'robot' ELSE NULL END AS annotator_qualifications,
  CASE WHEN o_orderkey % 10 = 4 THEN NULL ELSE 'ICD-10' END AS standards_used,
  CASE WHEN o_orderkey % 3 = 1 THEN 'IEC/2024/001' WHEN o_orderkey % 3 = 2 THEN 'pending' ELSE NULL END AS ethics_approval_ref,
  CASE WHEN o_orderkey % 7 = 3 THEN NULL ELSE 'waiver' END AS consent_type,
  CASE WHEN o_orderkey % 4 = 2 THEN 'k-Anonymity' ELSE 'HIPAA Safe Harbor' END AS deidentification_method,
  CASE WHEN o_orderkey % 8 = 2 THEN NULL ELSE CAST(o_orderkey % 5 AS INT) END AS k_anonymity_value,
  (o_orderkey % 5 = 2) AS differential_privacy_applied,
  CASE WHEN o_orderkey % 10 = 2 THEN NULL ELSE CAST(o_orderkey % 7 AS DOUBLE) - 1 END AS dp_epsilon,
  CASE WHEN o_orderkey % 9 = 5 THEN 'secret' ELSE 'standard' END AS sensitivity_class,
  CASE WHEN o_orderkey % 3 = 0 THEN '10.1234/abc.5' WHEN o_orderkey % 3 = 1 THEN 'not a doi' ELSE NULL END AS persistent_identifier,
  'MIT' AS license_type,
  CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderkey % 130 AS DOUBLE) END AS synthetic_data_pct,
  CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE true END AS synthetic_utility_evaluated,
  CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE true END AS synthetic_privacy_tested,
  'request form' AS access_control_method,
  CASE WHEN o_orderkey % 12 = 7 THEN NULL ELSE true END AS dua_required,
  CASE WHEN o_orderkey % 2 = 0 THEN 'https://example.org/repo' WHEN o_orderkey % 2 = 1 THEN 'http://example.org' ELSE NULL END AS github_repo_url,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'semantic' END AS version_format,
  concat('{"dataset_name":"raw ', CAST(o_orderkey AS STRING), '","num_sites":', CAST(o_orderkey % 9 AS STRING),
    CASE WHEN o_orderkey % 4 = 0 THEN ',"favourite_colour":"red"' ELSE '' END,
    CASE WHEN o_orderkey % 3 = 0 THEN ',"temporal_granularity":"month"' ELSE '' END,
    ',"sex_distribution":"not_specified"}') AS raw_form_json
FROM orders
"""


def forms(spark, sf_dir):
    return run_sql(spark, sf_dir, FORM_SQL, "orders", heavy=True)


_FORMS = f"WITH forms AS ({FORM_SQL}) "
_HAVE = ["dataset_name", "dataset_type", "study_type", "target_population", "geographic_coverage", "standards_used",
         "deidentification_method", "sensitivity_class", "license_type", "access_control_method"]
_PRESENT_ENUMS = ["dataset_type", "study_type", "geographic_coverage", "sex_distribution", "annotator_qualifications", "consent_type",
                  "sensitivity_class", "version_format"]


def _v(field: str, rule: str, cond: str, value: str | None = None) -> str:
    shown = f"CAST({value or field} AS VARCHAR)" if value != "NULL" else "CAST(NULL AS VARCHAR)"
    return f"SELECT dataset_id, '{field}' AS field, '{rule}' AS rule, {shown} AS value FROM forms WHERE {cond}"


def _bounds(expr: str, least, most) -> str:
    return " OR ".join(x for x in ([f"{expr} < {least}"] if least is not None else []) + ([f"{expr} > {most}"] if most is not None else []))


_RULES = [_v(n, "required", f"{n} IS NULL", "NULL") for n in _HAVE]
_RULES += [_v(n, "enum", f"{n} NOT IN ({', '.join(repr(x) for x in fixed.FORM_ENUMS[n])})") for n in _PRESENT_ENUMS]
_RULES += [_v(n, "length", _bounds(f"length({n})", *b)) for n, b in fixed.FORM_LENGTHS.items()]
_RULES += [_v(n, "range", _bounds(n, *b)) for n, b in fixed.FORM_RANGES.items()]
_RULES += [_v("collection_end_date", "order", "collection_end_date < collection_start_date"),
           _v("age_range_max", "order", "age_range_max < age_range_min")]
_RULES += [_v(n, "future", f"{n} > DATE '{AS_OF}'") for n in ("collection_start_date", "collection_end_date")]
_RULES += ["SELECT dataset_id, 'favourite_colour', 'unknown_field', NULL FROM forms WHERE dataset_id % 4 = 0"]

QUERIES["metadata_violations"] = lambda s, d: val.violations(forms(s, d), as_of=AS_OF, raw="raw_form_json")
ORACLE["metadata_violations"] = _FORMS + " UNION ALL ".join(_RULES)

_ANN = "annotation_methodology IS NOT NULL"
_SYN = "synthetic_data_pct > 0"
_COND = [("irr_value", "irr_method IS NOT NULL"), ("num_annotators", _ANN), ("annotator_qualifications", _ANN),
         ("k_anonymity_value", "regexp_matches(lower(deidentification_method), 'k-anonymity|l-diversity')"),
         ("dp_epsilon", "differential_privacy_applied"), ("synthetic_utility_evaluated", _SYN), ("synthetic_privacy_tested", _SYN),
         ("dua_required", "access_control_method IS NOT NULL")]
QUERIES["conditional_answers"] = lambda s, d: val.conditional_violations(forms(s, d))
ORACLE["conditional_answers"] = _FORMS + " UNION ALL ".join(
    [_v(f, "conditional", f"{w} AND {f} IS NULL", "NULL") for f, w in _COND]
    + [_v("dp_epsilon", "positive", "differential_privacy_applied AND dp_epsilon <= 0")])

QUERIES["format_checks"] = lambda s, d: val.format_checks(forms(s, d))
ORACLE["format_checks"] = _FORMS + " UNION ALL ".join(
    f"SELECT dataset_id, '{n}' AS field, {n} AS value, regexp_matches({n}, '{p}') AS well_formed FROM forms WHERE {n} IS NOT NULL"
    for n, p in fixed.FORMAT_PATTERNS.items())

_DEFAULTED = ["dataset_id", "sex_distribution", "consent_type", "differential_privacy_applied", "dua_required", "version_format", "num_sites"]
QUERIES["metadata_defaults"] = lambda s, d: val.fill_defaults(forms(s, d)).select(*_DEFAULTED)
ORACLE["metadata_defaults"] = _FORMS + ("SELECT dataset_id, coalesce(sex_distribution, 'not_specified') AS sex_distribution, coalesce(consent_type, 'not_applicable') AS consent_type, "
                                       "coalesce(differential_privacy_applied, false) AS differential_privacy_applied, coalesce(dua_required, false) AS dua_required, "
                                       "coalesce(version_format, 'none') AS version_format, num_sites FROM forms")

QUERIES["metadata_merge"] = lambda s, d: val.merge_raw(forms(s, d)).select(
    "dataset_id", "dataset_name", "sex_distribution", "num_sites", "temporal_granularity", "license_type", "geographic_coverage")
ORACLE["metadata_merge"] = _FORMS + ("SELECT dataset_id, coalesce(dataset_name, raw_form_json->>'dataset_name') AS dataset_name, coalesce(sex_distribution, raw_form_json->>'sex_distribution') AS sex_distribution, "
                                    "coalesce(num_sites, CAST(raw_form_json->>'num_sites' AS INT)) AS num_sites, raw_form_json->>'temporal_granularity' AS temporal_granularity, license_type, geographic_coverage FROM forms")

QUERIES["known_fields"] = lambda s, d: val.known_fields(forms(s, d).select("dataset_id", "raw_form_json")).select(
    "dataset_id", F.inline(F.map_entries("known"))).withColumnsRenamed({"key": "field"})
ORACLE["known_fields"] = _FORMS + ("SELECT dataset_id, 'dataset_name' AS field, raw_form_json->>'dataset_name' AS value FROM forms UNION ALL SELECT dataset_id, 'num_sites', raw_form_json->>'num_sites' FROM forms "
                                  "UNION ALL SELECT dataset_id, 'temporal_granularity', 'month' FROM forms WHERE dataset_id % 3 = 0 UNION ALL SELECT dataset_id, 'sex_distribution', 'not_specified' FROM forms")

WIZARD_SQL = """
SELECT o_orderkey AS dataset_id, (o_orderkey % 3 = 0) AS is_annotated, 'Two independent readers' AS annotation_methodology,
  CAST(o_orderkey % 5 AS INT) AS num_annotators, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS irr_value,
  concat(' m', CAST(o_orderkey % 4 AS STRING), ' , ,b ,', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ' c' END) AS linked_models_text,
  CASE WHEN o_orderkey % 4 = 0 THEN 'dictionary.csv' ELSE NULL END AS dictionary_file, (o_orderkey % 7 = 0) AS data_dictionary_uploaded,
  CASE WHEN o_orderkey % 5 = 0 THEN 'run.py' ELSE '' END AS lineage_file, (o_orderkey % 6 = 0) AS provenance_pipeline_available
FROM orders
"""


def q_wizard(spark, sf_dir):
    answers = run_sql(spark, sf_dir, WIZARD_SQL, "orders")
    return val.gate_answers(answers).withColumn("linked_model_ids", F.array_join("linked_model_ids", "|"))


QUERIES["wizard_gating"] = q_wizard
ORACLE["wizard_gating"] = f"WITH w AS ({WIZARD_SQL}) " + (
    "SELECT dataset_id, CASE WHEN is_annotated THEN annotation_methodology END AS annotation_methodology, CASE WHEN is_annotated THEN num_annotators END AS num_annotators, "
    "CASE WHEN is_annotated THEN irr_value END AS irr_value, array_to_string(list_filter(list_transform(string_split(linked_models_text, ','), lambda x: trim(x)), lambda x: length(x) > 0), '|') AS linked_model_ids, "
    "(dictionary_file IS NOT NULL AND dictionary_file <> '') OR data_dictionary_uploaded AS data_dictionary_uploaded, "
    "(lineage_file IS NOT NULL AND lineage_file <> '') OR provenance_pipeline_available AS provenance_pipeline_available FROM w")

# Stored rows with planted constraint breaks.
_R = "SELECT o_orderkey - (CASE WHEN o_orderkey % 997 = 5 THEN 1 ELSE 0 END) AS assessment_id, CAST(o_orderkey % 104 AS INT) AS prs FROM orders"
_S = ("SELECT l_orderkey AS assessment_id, CAST(l_linenumber + (CASE WHEN l_partkey % 500 = 7 THEN 15 ELSE 0 END) AS INT) AS domain_number, "
      "CAST(l_suppkey % 6 AS INT) AS score FROM lineitem")


def q_result_violations(spark, sf_dir):
    results = run_sql(spark, sf_dir, _R, "orders")
    scores = run_sql(spark, sf_dir, _S, "lineitem")
    return val.result_violations(results, scores)


QUERIES["result_violations"] = q_result_violations
ORACLE["result_violations"] = f"""WITH r AS ({_R}), s AS ({_S})
SELECT assessment_id, 'prs_range' AS rule FROM r WHERE prs < 0 OR prs > 100
UNION ALL SELECT assessment_id, 'result_unique' FROM r GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT assessment_id, 'domain_range' FROM s WHERE domain_number < 1 OR domain_number > 15
UNION ALL SELECT assessment_id, 'score_range' FROM s WHERE score < 1 OR score > 4
UNION ALL SELECT assessment_id, 'score_unique' FROM s GROUP BY assessment_id, domain_number HAVING count(*) > 1"""

QUERIES["upload_allow_list"] = lambda s, d: files.allowed_uploads(view(s, d, "fx_assessments").select(
    "assessment_id", F.element_at(F.split("file_key", "/"), -1).alias("filename"),
    F.when(F.col("assessment_id") % 5 == 0, "exe").otherwise("CSV").alias("file_format")))
_EXTS = ", ".join(f"'{e}'" for e in fixed.UPLOAD_EXTENSIONS)
ORACLE["upload_allow_list"] = cte("fx_assessments") + f""", u AS (SELECT assessment_id, split_part(file_key, '/', 3) AS filename, CASE WHEN assessment_id % 5 = 0 THEN 'exe' ELSE 'CSV' END AS file_format FROM fx_assessments),
e AS (SELECT *, CASE WHEN contains(filename, '.') THEN lower(list_last(string_split(filename, '.'))) ELSE lower(file_format) END AS ext FROM u)
SELECT assessment_id, filename, file_format, ext, ext IN ({_EXTS}) AND lower(file_format) IN ({_EXTS}) AS accepted FROM e"""

MANIFEST_SQL = """
SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN concat('uploads/', substr(md5(CAST(o_orderkey AS STRING)), 1, 8), '-', substr(md5(CAST(o_orderkey AS STRING)), 9, 4), '-', substr(md5(CAST(o_orderkey AS STRING)), 13, 4),
      '-', substr(md5(CAST(o_orderkey AS STRING)), 17, 4), '-', substr(md5(CAST(o_orderkey AS STRING)), 21, 12), '/file.csv')
    WHEN 1 THEN concat('uploads/', CAST(o_orderkey AS STRING), '/file.tar.gz') WHEN 2 THEN 'nofolder' ELSE concat('uploads/{', md5(CAST(o_orderkey AS STRING)), '}/t.parquet') END AS file_key,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('reg-', CAST(o_orderkey AS STRING)) END AS registry_dataset_id,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS synthetic_data_pct
FROM orders
"""


def q_manifest(spark, sf_dir):
    keys = run_sql(spark, sf_dir, MANIFEST_SQL, "orders")
    made = F.concat(F.lit("new-"), F.col("o_orderkey").cast("string"))
    return files.manifest(keys, registry_id="registry_dataset_id", synthetic="synthetic_data_pct", fresh_id=made, fresh_dataset=made)


QUERIES["manifest_from_key"] = q_manifest
ORACLE["manifest_from_key"] = f"WITH k AS ({MANIFEST_SQL}), h AS (SELECT *, md5(CAST(o_orderkey AS STRING)) AS m FROM k) " + """
SELECT o_orderkey, file_key, registry_dataset_id, synthetic_data_pct,
  CASE WHEN o_orderkey % 4 IN (0, 3) THEN concat(substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12))
    ELSE 'new-' || o_orderkey END AS assessment_id,
  coalesce(registry_dataset_id, 'dataset_new-' || o_orderkey) AS dataset_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'gz' WHEN 2 THEN 'csv' ELSE 'parquet' END AS file_format,
  coalesce(synthetic_data_pct > 0, false) AS domain_11_applicable FROM h"""
