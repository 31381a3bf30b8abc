"""Documented data checks, catalog analytics, event-log operators, files and archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from assayframe.functions import fixed
from assayframe.operators import catalog, documents, grouped, numbering, privacy, quality, reads, throttle
from assayframe.plans import assess as plan
from assayframe.plans import datasets, profile
from assayframe.session import scratch_path, stored, stored_by
from assayframe.sources import archives, commits, files, fhir, readers, sinks
from assayframe.streaming import events as ev
from registered import profiling, scoring
from registered.fixtures import SQL, cte, part_count, run_sql, spread, table, view
from registered.profiling import pct_sql

QUERIES = {}
ORACLE = {}

# ---- privacy ---------------------------------------------------------------------------

QUERIES["k_anonymity"] = lambda s, d: privacy.anonymity(view(s, d, "fx_patients"), ["sex", "site", "district_id", "treatment_outcome"])
ORACLE["k_anonymity"] = cte("fx_patients") + f""", c AS (SELECT count(*) AS n FROM fx_patients GROUP BY sex, site, district_id, treatment_outcome)
SELECT min(n) AS k, count(*) AS classes, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n = 1) AS unique_rows,
  CAST(coalesce(sum(n) FILTER (n < 5), 0) AS BIGINT) AS rows_below, {pct_sql('count(*)', 'CAST(sum(n) AS BIGINT)')} AS baseline_risk FROM c"""

_TEXTS = ["text", "lang", "source"]
QUERIES["pii_value_scan"] = lambda s, d: privacy.scan_values(table(s, d, "documents"), _TEXTS)
ORACLE["pii_value_scan"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{fam}' AS family, count({c}) AS present, count(*) FILTER (regexp_matches({c}, '{p}')) AS hits, "
    f"{pct_sql(f'''count(*) FILTER (regexp_matches({c}, '{p}'))''', f'count({c})')} AS hit_pct FROM documents"
    for c in _TEXTS for fam, p in fixed.VALUE_PATTERNS.items())
QUERIES["pii_value_extract"] = lambda s, d: privacy.extract_values(table(s, d, "documents"), "doc_id", "text")
ORACLE["pii_value_extract"] = " UNION ALL ".join(
    f"SELECT doc_id, '{fam}' AS family, unnest(regexp_extract_all(text, '{p}')) AS value FROM documents" for fam, p in fixed.VALUE_PATTERNS.items())

_PAIR_SQL = """SELECT c_custkey AS id, CAST(c_custkey % 181 AS DOUBLE) - 90 AS lat, CAST(c_custkey % 361 AS DOUBLE) - 180 AS lon,
  CAST(c_custkey % 400 AS DOUBLE) AS x, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS y,
  CASE WHEN c_custkey % 3 = 0 THEN '1980-05-17' WHEN c_custkey % 3 = 1 THEN '3/11/1975' ELSE '1990' END AS birth,
  CASE WHEN c_custkey % 2 = 0 THEN '1980' ELSE '1980-01-02' END AS seen FROM customer"""
QUERIES["gps_pairs"] = lambda s, d: privacy.gps_pairs(run_sql(s, d, _PAIR_SQL, "customer"), [("lat", "lon"), ("x", "y")])
ORACLE["gps_pairs"] = f"WITH p AS ({_PAIR_SQL}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS latitude_column, '{b}' AS longitude_column, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS present, "
    f"count(*) FILTER ({a} BETWEEN -90 AND 90 AND {b} BETWEEN -180 AND 180) AS in_range, "
    f"count(*) FILTER ({a} BETWEEN -90 AND 90 AND {b} BETWEEN -180 AND 180) = count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS is_pair FROM p"
    for a, b in (("lat", "lon"), ("x", "y")))
QUERIES["birth_date_precision"] = lambda s, d: privacy.full_dates(run_sql(s, d, _PAIR_SQL, "customer"))
ORACLE["birth_date_precision"] = f"WITH p AS ({_PAIR_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS present, count(*) FILTER (regexp_matches({c}, '{fixed.FULL_DATE_PATTERN}')) AS full_dates, "
    f"count(*) FILTER (regexp_matches({c}, '{fixed.FULL_DATE_PATTERN}')) * 2 > count({c}) AS day_precision FROM p" for c in ("birth", "seen"))
QUERIES["name_like_columns"] = lambda s, d: privacy.name_like(table(s, d, "customer")).select("column_name", "present", "matches", "name_like")
_NL = r"^[A-Z][\w''.#-]+([ ][A-Z]?[\w''.#-]*)*$"
ORACLE["name_like_columns"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS present, count(*) FILTER (regexp_matches({c}, '{_NL}')) AS matches, "
    f"count(*) FILTER (regexp_matches({c}, '{_NL}')) * 2 > count({c}) AND count(DISTINCT {c}) > count({c}) * 0.5 AS name_like FROM customer" for c in ("c_name", "c_mktsegment"))

# ---- quality ---------------------------------------------------------------------------

def _orders_with_gaps(s, d):
    return run_sql(s, d, "SELECT o_orderkey, CASE WHEN o_orderkey % 37 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS ref FROM orders", "orders")


_REF = "WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 37 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS ref FROM orders) "
QUERIES["ref_integrity"] = lambda s, d: quality.orphan_counts(_orders_with_gaps(s, d), "ref", table(s, d, "customer"), "c_custkey")
ORACLE["ref_integrity"] = _REF + """SELECT count(*) AS child_rows, count(*) FILTER (c_custkey IS NULL) AS orphan_rows, count(DISTINCT CASE WHEN c_custkey IS NULL THEN ref END) AS orphan_keys
FROM c LEFT JOIN customer ON ref = c_custkey"""
QUERIES["orphan_rows"] = lambda s, d: quality.orphans(_orders_with_gaps(s, d), "ref", table(s, d, "customer"), "c_custkey")
ORACLE["orphan_rows"] = _REF + "SELECT ref, o_orderkey FROM c WHERE ref NOT IN (SELECT c_custkey FROM customer)"


def _dictionary(s, d):
    return view(s, d, "fx_columns").where(F.col("ord") % 3 != 1).withColumn("column_name", F.upper("column_name"))


QUERIES["dictionary_coverage"] = lambda s, d: quality.dictionary_coverage(view(s, d, "fx_columns"), _dictionary(s, d))
ORACLE["dictionary_coverage"] = cte("fx_columns") + f"""SELECT dataset_id, count(*) AS columns, count(*) FILTER (hit) AS described, {pct_sql('count(*) FILTER (hit)', 'count(*)')} AS described_pct
FROM (SELECT dataset_id, (dataset_id, lower(column_name)) IN (SELECT dataset_id, lower(column_name) FROM fx_columns WHERE ord % 3 <> 1) AS hit FROM fx_columns) GROUP BY dataset_id"""
QUERIES["undescribed_columns"] = lambda s, d: quality.undescribed(view(s, d, "fx_columns"), _dictionary(s, d))
ORACLE["undescribed_columns"] = cte("fx_columns") + """SELECT dataset_id, ord, column_name FROM fx_columns
WHERE (dataset_id, lower(column_name)) NOT IN (SELECT dataset_id, lower(column_name) FROM fx_columns WHERE ord % 3 <> 1)"""

_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
QUERIES["feature_corr"] = lambda s, d: quality.correlations(table(s, d, "lineitem"), _NUM)
ORACLE["feature_corr"] = " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", round(corr({a}, {b}), 6) AS r, abs(round(corr({a}, {b}), 6)) >= 0.95 AS leak FROM lineitem"
    for i, a in enumerate(_NUM) for b in _NUM[i + 1:])
QUERIES["label_leakage"] = lambda s, d: quality.correlations(
    table(s, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))), ["l_quantity", "l_discount", "net"], F.col("l_extendedprice"))
ORACLE["label_leakage"] = "WITH n AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", 'label' AS \"right\", round(corr({a}, l_extendedprice), 6) AS r, abs(round(corr({a}, l_extendedprice), 6)) >= 0.95 AS leak FROM n" for a in ("l_quantity", "l_discount", "net"))

QUERIES["parity_gap"] = lambda s, d: quality.parity(table(s, d, "customer"), "c_mktsegment")
ORACLE["parity_gap"] = """WITH c AS (SELECT c_mktsegment AS group_value, count(*) AS cnt FROM customer GROUP BY 1),
s AS (SELECT group_value, cnt, round(CAST(cnt AS DOUBLE) / (SELECT sum(cnt) FROM c), 6) AS share, round(1.0::DOUBLE / (SELECT count(*) FROM c), 6) AS expected FROM c)
SELECT *, round(share - expected, 6) AS gap, abs(round(share - expected, 6)) > 0.1 AS flagged FROM s"""
_EXPECT = {"F": 0.52, "M": 0.48}
QUERIES["parity_vs_reference"] = lambda s, d: quality.parity(view(s, d, "fx_patients"), "sex", _EXPECT, 0.01)
ORACLE["parity_vs_reference"] = cte("fx_patients") + """, c AS (SELECT sex AS group_value, count(*) AS cnt FROM fx_patients GROUP BY 1),
s AS (SELECT group_value, cnt, round(CAST(cnt AS DOUBLE) / (SELECT sum(cnt) FROM c), 6) AS share, CASE group_value WHEN 'F' THEN 0.52::DOUBLE ELSE 0.48::DOUBLE END AS expected FROM c)
SELECT *, round(share - expected, 6) AS gap, abs(round(share - expected, 6)) > 0.01 AS flagged FROM s"""

QUERIES["date_ranges"] = lambda s, d: quality.date_ranges(table(s, d, "lineitem"))
ORACLE["date_ranges"] = "SELECT 'l_shipdate' AS column_name, min(l_shipdate) AS earliest, max(l_shipdate) AS latest FROM lineitem"
QUERIES["text_quality"] = lambda s, d: quality.text_quality(table(s, d, "documents"), ["text", "lang"])
_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
ORACLE["text_quality"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS "values", CAST(0 AS BIGINT) AS invalid, CAST(sum(k) AS BIGINT) AS control_chars, CAST(sum(r) AS BIGINT) AS replacement_chars, count(*) FILTER (k > 0 OR r > 0) AS affected
FROM (SELECT {c}, len(regexp_extract_all({c}, '{_CTRL}')) AS k, len(regexp_extract_all({c}, '�')) AS r FROM documents)""" for c in ("text", "lang"))
QUERIES["extended_types"] = lambda s, d: quality.text_types(view(s, d, "fx_patients").select("sex", "patient_name", "site", "treatment_outcome"))
ORACLE["extended_types"] = cte("fx_patients") + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS present, round(avg(length({c})), 4) AS mean_length, count(DISTINCT {c}) = 2 AS two_valued, "
    f"CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(DISTINCT {c}) = 2 THEN 'binary' WHEN avg(length({c})) > 50 THEN 'free_text' ELSE 'text' END AS extended_type FROM fx_patients"
    for c in ("sex", "patient_name", "site", "treatment_outcome"))
QUERIES["description_words"] = lambda s, d: quality.word_threshold(table(s, d, "documents"), "doc_id", "text", 100)
ORACLE["description_words"] = r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), w AS (SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE CAST(len(regexp_split_to_array(t, '\s+')) AS INT) END AS words FROM t)
SELECT doc_id, words, words >= 100 AS enough FROM w"""
QUERIES["declared_vs_detected"] = lambda s, d: quality.declared_vs_detected(view(s, d, "fx_catalog"))
_DECLARED = "SELECT dataset_id, '{0}' AS \"check\", contains(upper(coalesce(standards_used, '')), '{1}') AS declared, {0}_codes_present AS detected FROM fx_catalog"
ORACLE["declared_vs_detected"] = cte("fx_catalog") + "SELECT *, declared <> detected AS mismatch FROM (" + " UNION ALL ".join(
    [_DECLARED.format(c, c.upper()) for c in ("icd", "snomed", "loinc")]
    + ["SELECT dataset_id, 'direct_identifiers', coalesce(len(direct_identifiers_present) > 0, false), direct_identifiers_detected FROM fx_catalog"]) + ")"

# ---- near copies -----------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
_BANDS_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS gram FROM w WHERE len(w) > 0),
h AS (SELECT doc_id, sha256(gram) AS h FROM g),
m AS (SELECT doc_id, {', '.join(f'min(substr(h, {1 + 8 * i}, 8)) AS m{i}' for i in range(8))} FROM h GROUP BY doc_id),
bands AS ({' UNION ALL '.join(f"SELECT doc_id, {b} AS band, m{2 * b} || m{2 * b + 1} AS value FROM m" for b in range(4))}),
heads AS (SELECT band, value, min(doc_id) AS head FROM bands GROUP BY band, value HAVING count(*) > 1),
copies AS (SELECT doc_id, min(head) AS copy_of FROM bands JOIN heads USING (band, value) WHERE head <> doc_id GROUP BY doc_id) """
QUERIES["near_copies"] = lambda s, d: quality.near_copies(spread(table(s, d, "documents")), "doc_id", "text")
ORACLE["near_copies"] = _BANDS_SQL + "SELECT doc_id, copy_of FROM copies"
QUERIES["near_copy_share"] = lambda s, d: quality.near_copy_share(spread(table(s, d, "documents")), "doc_id", "text")
ORACLE["near_copy_share"] = _BANDS_SQL + f""", n AS (SELECT (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM copies) AS near_copy_rows)
SELECT rows, near_copy_rows, {pct_sql('near_copy_rows', 'rows')} AS near_copy_pct FROM n"""

# ---- catalog ---------------------------------------------------------------------------

def _results(s, d):
    done = plan.assess(view(s, d, "fx_catalog"), texts=False)
    return done.select("dataset_id", "dataset_type", "file_format", "sensitivity_class", "submitted_at", "owner_id", "cqi", "cqi_band", "prs", "prs_band", "release_class")


_ASSESSED = cte("fx_catalog") + scoring.assessed_ctes()


def q_deltas(s, d):
    r = _results(s, d).select(F.concat(F.lit("ds-"), (F.col("owner_id") % 50).cast("string")).alias("series"), F.col("dataset_id").alias("assessment_id"), "submitted_at", "cqi", "prs")
    return catalog.score_deltas(r, "series")


QUERIES["score_delta"] = q_deltas
ORACLE["score_delta"] = _ASSESSED + """, r AS (SELECT 'ds-' || (owner_id % 50) AS series, dataset_id AS assessment_id, submitted_at, cqi, prs FROM assessed),
p AS (SELECT *, lag(cqi) OVER w AS prev_cqi, lag(prs) OVER w AS prev_prs FROM r WINDOW w AS (PARTITION BY series ORDER BY submitted_at, assessment_id))
SELECT *, round(cqi - prev_cqi, 1) AS cqi_delta, prs - prev_prs AS prs_delta FROM p"""
QUERIES["cqi_rollup"] = lambda s, d: catalog.distribution(_results(s, d), "sensitivity_class", "cqi_band", "release_class")
ORACLE["cqi_rollup"] = _ASSESSED + """ SELECT sensitivity_class, cqi_band, release_class, CAST(grouping(sensitivity_class, cqi_band, release_class) AS INT) AS level, count(*) AS datasets,
  round(avg(cqi), 4) AS mean_cqi, round(avg(prs), 4) AS mean_prs FROM assessed GROUP BY ROLLUP (sensitivity_class, cqi_band, release_class)"""
QUERIES["cqi_cube"] = lambda s, d: catalog.cross_distribution(_results(s, d), "file_format", "prs_band")
ORACLE["cqi_cube"] = _ASSESSED + """ SELECT file_format, prs_band, CAST(grouping(file_format, prs_band) AS INT) AS level, count(*) AS datasets, round(avg(cqi), 4) AS mean_cqi FROM assessed GROUP BY CUBE (file_format, prs_band)"""
QUERIES["cqi_percent_rank"] = lambda s, d: catalog.with_percent_rank(_results(s, d).select("dataset_id", "cqi"))
ORACLE["cqi_percent_rank"] = _ASSESSED + " SELECT dataset_id, cqi, round(percent_rank() OVER (ORDER BY cqi), 6) AS percent_rank FROM assessed"
QUERIES["price_percent_rank"] = lambda s, d: numbering.with_ranks(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
ORACLE["price_percent_rank"] = "SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice NULLS FIRST) AS rank, round(percent_rank() OVER (ORDER BY o_totalprice NULLS FIRST), 6) AS percent_rank FROM orders"
QUERIES["band_search"] = lambda s, d: catalog.search(_results(s, d), ["Gold", "Platinum"], ["Low", "Moderate"], ["Open", "Controlled"]).select("dataset_id", "cqi", "prs", "release_class")
ORACLE["band_search"] = _ASSESSED + " SELECT dataset_id, cqi, prs, release_class FROM assessed WHERE cqi_band IN ('Gold', 'Platinum') AND prs_band IN ('Low', 'Moderate') AND release_class IN ('Open', 'Controlled')"

# ---- raw table to result ---------------------------------------------------------------

_TABLES = [("fx_patients", "parquet", 1000), ("customer", "csv", 20_000_000), ("part", "json", 500), ("supplier", "xlsx", 30_000_000)]


def q_assess_tables(s, d):
    """Four tables are profiled; every form, dealt to one of them, is assessed with what was measured."""
    facts = None
    for i, (name, kind, size) in enumerate(_TABLES):
        df = view(s, d, name) if name.startswith("fx_") else table(s, d, name)
        one = profile.facts_of(profile.profile(df, dataset_id=str(i), file_format=kind, size_bytes=size).dataset)
        facts = one if facts is None else facts.unionAll(one)
    facts = facts.withColumn("table_no", F.col("dataset_id").cast("bigint")).drop("dataset_id")
    measured = ["overall_completeness_pct", "direct_identifiers_detected", "icd_codes_present", "snomed_codes_present", "loinc_codes_present", "fhir_structure", "imbalance_ratio"]  # a form has none of these
    forms = view(s, d, "fx_catalog").drop(*measured).withColumn("table_no", F.col("dataset_id") % len(_TABLES))
    done = plan.assess(plan.combine(forms, facts, "table_no"), texts=False)
    return done.select("dataset_id", "file_format", "size_bytes", "overall_completeness_pct", "imbalance_ratio", "cqi", "cqi_band", "prs", "prs_band", "release_class")


QUERIES["assess_tables"] = q_assess_tables
_PATIENT_COLS = ["id", "age", "bmi", "sex", "patient_name", "site", "treatment_outcome", "district_id", "balance"]
ORACLE["assess_tables"] = cte("fx_patients") + f""", forms AS ({SQL["fx_catalog"].strip()}),
facts(t, kind, size, pct, ids, ratio) AS (
  SELECT 0, 'parquet', 1000, (SELECT {pct_sql(' + '.join(f'count({c})' for c in _PATIENT_COLS), f'count(*) * {len(_PATIENT_COLS)}')} FROM fx_patients), true,
    (SELECT {pct_sql('max(n)', 'min(n) * 100')} FROM (SELECT count(*) AS n FROM fx_patients GROUP BY treatment_outcome))
  UNION ALL SELECT 1, 'csv', 20000000, 100.0, false, NULL UNION ALL SELECT 2, 'json', 500, 100.0, false, NULL UNION ALL SELECT 3, 'xlsx', 30000000, 100.0, false, NULL),
fx_catalog AS (SELECT forms.* REPLACE (kind AS file_format, CAST(size AS BIGINT) AS size_bytes, pct AS overall_completeness_pct, ids AS direct_identifiers_detected,
  false AS icd_codes_present, false AS snomed_codes_present, false AS loinc_codes_present, false AS fhir_structure, ratio AS imbalance_ratio) FROM forms JOIN facts ON dataset_id % 4 = t)""" + scoring.assessed_ctes() + """
SELECT dataset_id, file_format, size_bytes, overall_completeness_pct, imbalance_ratio, cqi, cqi_band, prs, prs_band, release_class FROM assessed"""


def q_assess_by_group(s, d):
    """All code datasets are profiled in one job; every form, dealt to one of them, is assessed with what was measured in the same plan."""
    df, own = profiling.datasets_of(s, d)
    facts = profile.facts_of(datasets.profile_datasets(df, "ds", own, file_format="parquet")).withColumnRenamed("dataset_id", "table_no")
    measured = ["overall_completeness_pct", "direct_identifiers_detected", "icd_codes_present", "snomed_codes_present", "loinc_codes_present", "fhir_structure", "imbalance_ratio"]
    forms = view(s, d, "fx_catalog").drop(*measured).withColumn("table_no", F.concat(F.lit("codes-"), (F.col("dataset_id") % 7).cast("string")))
    done = plan.assess(plan.combine(forms, facts, "table_no"), texts=False)
    return done.select("dataset_id", "overall_completeness_pct", "icd_codes_present", "snomed_codes_present", "loinc_codes_present", "cqi", "cqi_band", "prs", "prs_band", "release_class")


QUERIES["assess_by_group"] = q_assess_by_group
ORACLE["assess_by_group"] = cte("fx_codes") + f""", forms AS ({SQL["fx_catalog"].strip()}), facts AS ({profiling.code_facts_sql()}),
fx_catalog AS (SELECT forms.* REPLACE ('parquet' AS file_format, CAST(0 AS BIGINT) AS size_bytes, facts.overall_pct AS overall_completeness_pct, false AS direct_identifiers_detected,
  facts.icd_codes_present AS icd_codes_present, facts.snomed_codes_present AS snomed_codes_present, facts.loinc_codes_present AS loinc_codes_present, false AS fhir_structure, CAST(NULL AS DOUBLE) AS imbalance_ratio)
  FROM forms JOIN facts ON concat('codes-', forms.dataset_id % 7) = facts.dataset_id)""" + scoring.assessed_ctes() + """
SELECT dataset_id, overall_completeness_pct, icd_codes_present, snomed_codes_present, loinc_codes_present, cqi, cqi_band, prs, prs_band, release_class FROM assessed"""

# ---- event log -------------------------------------------------------------------------

_FIRST = "min(event_timestamp) FILTER (event_type = 'assessment_{}')"
QUERIES["lifecycle_latest"] = lambda s, d: catalog.lifecycle(view(s, d, "fx_audit"))
ORACLE["lifecycle_latest"] = cte("fx_audit") + f""", a AS (SELECT assessment_id, last(event_type ORDER BY event_timestamp, log_id) AS last_event, max(event_timestamp) AS last_at, count(*) AS events,
  {_FIRST.format('submitted')} AS submitted_at, {_FIRST.format('started')} AS started_at, least({_FIRST.format('complete')}, {_FIRST.format('failed')}) AS ended_at FROM fx_audit GROUP BY assessment_id)
SELECT *, CAST(trunc((epoch_us(started_at) - epoch_us(submitted_at)) / 1000000.0) AS BIGINT) AS queue_seconds, CAST(trunc((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0) AS BIGINT) AS processing_seconds FROM a"""
QUERIES["slo"] = lambda s, d: catalog.service_levels(view(s, d, "fx_audit")).select("hour", "runs", "failed", "failure_rate", "webhook_failures", "unsubmitted", "reversed", "longest_seconds", "p95_seconds")
ORACLE["slo"] = cte("fx_audit") + f""", r AS (SELECT assessment_id, {_FIRST.format('submitted')} AS submitted, {_FIRST.format('complete')} AS complete, {_FIRST.format('failed')} AS failed,
  count(*) FILTER (event_type = 'webhook_failed') AS unsent FROM fx_audit GROUP BY assessment_id),
t AS (SELECT *, CAST(trunc((epoch_us(coalesce(complete, failed)) - epoch_us(submitted)) / 1000000.0) AS BIGINT) AS took FROM r)
SELECT date_trunc('hour', submitted) AS hour, count(*) AS runs, count(failed) AS failed, round(count(failed) / count(*), 6) AS failure_rate, CAST(sum(unsent) AS BIGINT) AS webhook_failures, count(*) FILTER (submitted IS NULL) AS unsubmitted, count(*) FILTER (took < 0) AS reversed,
  max(took) FILTER (took >= 0) AS longest_seconds, round(quantile_cont(took, 0.95) FILTER (took >= 0), 4) AS p95_seconds FROM t GROUP BY 1"""


# The supplied events are sparse; a thousand times the pace makes bursts.
def _bursts(s, d):
    t = table(s, d, "events")
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.select((F.col("user_id") % 20).alias("client"), F.timestamp_micros(base + F.call_function("div", micros - base, F.lit(1000))).alias("ts"))


_BURST_SQL = """WITH RECURSIVE b AS (SELECT user_id % 20 AS client, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 1000 AS t FROM events),
chain AS (SELECT client, min(t) AS opened FROM b GROUP BY client
  UNION ALL SELECT chain.client, (SELECT min(t) FROM b WHERE b.client = chain.client AND b.t >= chain.opened + 60000000) AS opened FROM chain
  WHERE (SELECT max(t) FROM b WHERE b.client = chain.client) >= chain.opened + 60000000) """
QUERIES["throttle_60s"] = lambda s, d: throttle.throttled(_bursts(s, d), "client", "ts").select("client", F.unix_micros("opened").alias("opened"), "attempts", "rejected")
ORACLE["throttle_60s"] = _BURST_SQL + """SELECT client, opened, attempts, attempts - 5 AS rejected FROM (SELECT c.client, c.opened, count(*) AS attempts FROM chain c JOIN b ON b.client = c.client AND b.t >= c.opened AND b.t < c.opened + 60000000
GROUP BY 1, 2) WHERE attempts > 5"""
QUERIES["throttle_tumbling"] = lambda s, d: throttle.tumbling_attempts(_bursts(s, d), "client", "ts").select("client", F.unix_micros("opened").alias("opened"), "attempts")
ORACLE["throttle_tumbling"] = """SELECT user_id % 20 AS client, t // 60000000 * 60000000 AS opened, count(*) AS attempts FROM (SELECT user_id, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 1000 AS t FROM events)
GROUP BY 1, 2 HAVING count(*) > 5"""

_ENTRY = "concat_ws('|', log_id, event_type, epoch_us(event_timestamp), event_detail)"


def q_chain(s, d):
    return catalog.chain_blocks(view(s, d, "fx_audit"))


QUERIES["hash_chain"] = q_chain
ORACLE["hash_chain"] = cte("fx_audit") + f""", d AS (SELECT assessment_id, CAST(event_timestamp AS DATE) AS block, count(*) AS entries,
  list({_ENTRY} ORDER BY event_timestamp, log_id) AS items FROM fx_audit GROUP BY 1, 2),
g AS (SELECT assessment_id, block, entries, list_reduce(list_prepend('', items), lambda acc, x: sha256(acc || '|' || x)) AS digest FROM d),
c AS (SELECT *, list(digest) OVER (PARTITION BY assessment_id ORDER BY block) AS past FROM g)
SELECT assessment_id, block, entries, digest, list_reduce(list_prepend('', past), lambda acc, x: sha256(acc || '|' || x)) AS chained FROM c"""


def q_verify(s, d):
    """Blocks of a log with planted changes that no longer match the stored chain."""
    audit = view(s, d, "fx_audit")
    stored = catalog.chain_blocks(audit)
    moved = F.col("event_timestamp") + F.expr("INTERVAL '0.000001' SECOND")  # one microsecond later, same second
    touched = audit.withColumns({"event_detail": F.when(F.col("log_id") % 2003 == 1, F.lit("{}")).otherwise(F.col("event_detail")),
                                 "event_timestamp": F.when(F.col("log_id") % 4001 == 2, moved).otherwise(F.col("event_timestamp"))})
    return catalog.verify_chain(touched, stored)


QUERIES["hash_chain_verify"] = q_verify
ORACLE["hash_chain_verify"] = cte("fx_audit") + """, t AS (SELECT assessment_id, min(CAST(event_timestamp AS DATE)) AS since FROM fx_audit WHERE (log_id % 2003 = 1 AND event_detail <> '{}') OR log_id % 4001 = 2 GROUP BY 1)
SELECT DISTINCT assessment_id, CAST(event_timestamp AS DATE) AS block FROM fx_audit JOIN t USING (assessment_id) WHERE CAST(event_timestamp AS DATE) >= since"""

# ---- streams ---------------------------------------------------------------------------

def _event_stream(s, d):
    schema = table(s, d, "events").schema
    return ev.read_stream(s, d, schema, "events.parquet")


def q_stream_counters(s, d):
    """Events arrive in four loads by day; every 97th of the earlier ones comes with the last load, most of them too late."""
    schema = table(s, d, "events").schema
    source, out = scratch_path(s, "arrivals"), scratch_path(s, "counters")
    days = F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))
    arrivals = table(s, d, "events").withColumn("load", F.when(F.col("event_id") % 97 == 0, 3).otherwise(days))
    for load in range(4):
        arrivals.where(F.col("load") == load).drop("load").write.mode("append").parquet(source)
        counters = ev.quality_counters(ev.read_stream(s, source, schema), "ts", "value", ["event_type"], 1.0, 400.0, "1 hour", "10 minutes")
        ev.run_available(counters, out, out + "-checkpoint", "update")
    return ev.latest(s.read.parquet(out), ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_COUNT_SQL = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS rows, CAST(0 AS BIGINT) AS missing, count(*) FILTER (value < 1 OR value > 400) AS violations FROM events GROUP BY 1, 2"
QUERIES["stream_profile"] = q_stream_counters
ORACLE["stream_profile"] = """WITH a AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 3 ELSE least((day(ts) - 1) // 8, 3) END AS load FROM events),
kept AS (SELECT a.* FROM a WHERE coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(b.ts) FROM a b WHERE b.load < a.load) - INTERVAL 10 MINUTE, true))
""" + _COUNT_SQL.replace("FROM events", "FROM kept")
QUERIES["batch_counters"] = lambda s, d: ev.quality_counters(table(s, d, "events"), "ts", "value", ["event_type"], 1.0, 400.0).withColumn(
    "window_start", F.col("window_start").cast("timestamp_ntz"))
ORACLE["batch_counters"] = _COUNT_SQL


def q_stream_lifecycle(s, d):
    audit = _event_stream(s, d).select(
        F.col("event_id").alias("log_id"), F.col("user_id").alias("assessment_id"), F.col("ts").alias("event_timestamp"), "event_type")
    out = scratch_path(s, "lifecycle")
    ev.run_available(ev.lifecycle_stream(audit), out, out + "-checkpoint", "update")
    return ev.latest(s.read.parquet(out), ["assessment_id"])


QUERIES["stream_lifecycle"] = q_stream_lifecycle
ORACLE["stream_lifecycle"] = "SELECT user_id AS assessment_id, last(event_type ORDER BY ts, event_id) AS last_event, max(ts) AS last_at, count(*) AS events FROM events GROUP BY 1"


_RUN_TIMES = ["opened_at", "last_at", "submitted_at", "started_at", "ended_at"]


def q_stream_runs(s, d):
    """The audit log arrives in four loads by time; runs that cross loads are put together, told once and dropped. A last event of
    another assessment, years on, closes all of them."""
    audit = view(s, d, "fx_audit").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    source, out = scratch_path(s, "run-arrivals"), scratch_path(s, "runs")
    kind = audit.schema["assessment_id"].dataType
    last = audit.agg(F.max("event_timestamp").alias("m")).select(*[(F.col("m") + F.expr("INTERVAL 3 YEARS")).alias(c) if c == "event_timestamp" else F.lit(None).cast(audit.schema[c].dataType).alias(c) for c in audit.columns])
    cuts = audit.agg(F.expr("percentile(unix_micros(event_timestamp), array(0.25, 0.5, 0.75))").alias("c")).first()["c"]
    load = sum(((F.unix_micros("event_timestamp") > c).cast("int") for c in cuts), F.lit(0))
    for n in range(5):
        (audit.where(load == n) if n < 4 else last).write.mode("append").parquet(source)
        ev.run_available(ev.closed_runs(ev.read_stream(s, source, audit.schema)), out, out + "-checkpoint")
    told = s.read.parquet(out).withColumn("assessment_id", F.col("assessment_id").cast(kind))
    return told.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in _RUN_TIMES else F.col(c) for c in told.columns])


QUERIES["stream_runs"] = q_stream_runs
_RUN_SQL = cte("fx_audit") + """, g AS (SELECT *, CASE WHEN event_timestamp <= lag(event_timestamp) OVER (PARTITION BY assessment_id ORDER BY event_timestamp, log_id) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM fx_audit),
r AS (SELECT *, sum(opens) OVER (PARTITION BY assessment_id ORDER BY event_timestamp, log_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT assessment_id, min(event_timestamp) AS opened_at, max(event_timestamp) AS last_at, last(event_type ORDER BY event_timestamp, log_id) AS last_event, count(*) AS events,
  min(event_timestamp) FILTER (event_type = 'assessment_submitted') AS submitted_at, min(event_timestamp) FILTER (event_type = 'assessment_started') AS started_at,
  min(event_timestamp) FILTER (event_type IN ('assessment_complete', 'assessment_failed')) AS ended_at FROM r GROUP BY assessment_id, run"""
ORACLE["stream_runs"] = _RUN_SQL
QUERIES["batch_runs"] = lambda s, d: (lambda t: t.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in _RUN_TIMES else F.col(c) for c in t.columns]))(ev.closed_runs(view(s, d, "fx_audit")))
ORACLE["batch_runs"] = _RUN_SQL


def q_stream_throttle(s, d):
    stream = _event_stream(s, d)
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    fast = stream.select((F.col("user_id") % 20).alias("client"), F.timestamp_micros(base + F.call_function("div", micros - base, F.lit(1000))).alias("ts"))
    out = scratch_path(s, "throttle")
    ev.run_available(ev.throttle_stream(fast, "client", "ts"), out, out + "-checkpoint", "append")
    return s.read.parquet(out).groupBy("client").agg(F.count(F.lit(1)).alias("rejected"))


QUERIES["stream_throttle"] = q_stream_throttle
ORACLE["stream_throttle"] = _BURST_SQL + """SELECT client, CAST(sum(attempts - 5) AS BIGINT) AS rejected FROM (SELECT c.client, c.opened, count(*) AS attempts FROM chain c
JOIN b ON b.client = c.client AND b.t >= c.opened AND b.t < c.opened + 60000000 GROUP BY 1, 2) WHERE attempts > 5 GROUP BY client"""


def q_audit_sink(s, d):
    """Events appended in two batches, read back and counted."""
    audit = view(s, d, "fx_audit")
    out = scratch_path(s, "audit")
    sinks.append_events(sinks.events(audit.where(F.col("event_type") == "assessment_failed"), "assessment_id", "assessment_failed",
                                     F.struct(F.col("event_detail").alias("error")), severity="ERROR", at=F.col("event_timestamp")), out)
    sinks.append_events(sinks.events(audit.where(F.col("event_type") != "assessment_failed"), "assessment_id", F.col("event_type"),
                                     at=F.col("event_timestamp")), out)
    return s.read.parquet(out).groupBy("event_type", "severity").agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("log_id").alias("ids"))


QUERIES["audit_sink"] = q_audit_sink
ORACLE["audit_sink"] = cte("fx_audit") + "SELECT event_type, severity, count(*) AS cnt, count(*) AS ids FROM fx_audit GROUP BY 1, 2"


def q_result_sink(s, d):
    done = plan.assess(view(s, d, "fx_catalog"), texts=False)
    out = scratch_path(s, "results")
    sinks.write_results(done, out, "dataset_id")
    stored = s.read.parquet(out)
    return stored.groupBy("release_classification").agg(F.count(F.lit(1)).alias("cnt"), F.sum("cqi").cast("double").alias("cqi_sum"),
                                                        F.sum("prs_baseline_risk").cast("double").alias("risk_sum"))


QUERIES["result_sink"] = q_result_sink
ORACLE["result_sink"] = _ASSESSED + " SELECT release_class AS release_classification, count(*) AS cnt, CAST(sum(CAST(cqi AS DECIMAL(5,1))) AS DOUBLE) AS cqi_sum, sum(baseline_risk) AS risk_sum FROM assessed GROUP BY 1"


def q_audit_stream(s, d):
    """The audit log arrives in three loads; every seventh event is sent again with a later load, and the first load is committed once more by hand."""
    audit = view(s, d, "fx_audit")
    source, out = scratch_path(s, "audit-arrivals"), scratch_path(s, "audit-store")
    by_load = F.pmod(F.xxhash64("log_id"), F.lit(3))
    for load in range(3):
        sent = audit.where((by_load == load) | ((by_load < load) & (F.pmod(F.xxhash64("log_id", F.lit(1)), F.lit(7)) == 0)))
        sent.write.mode("append").parquet(source)
        commits.stream_events(ev.read_stream(s, source, audit.schema), out, out + "-checkpoint")
    again = audit.where(by_load == 0).withColumn("event_date", F.to_date("event_timestamp"))
    commits.commit_batch(again, out, 0, ["log_id"], ("event_date",))
    kept = s.read.parquet(out)
    return kept.groupBy("event_date", "event_type", "severity").agg(F.count(F.lit(1)).alias("cnt"), F.countDistinct("log_id").alias("ids"), F.countDistinct("assessment_id").alias("assessments"))


QUERIES["audit_stream_sink"] = q_audit_stream
ORACLE["audit_stream_sink"] = cte("fx_audit") + """SELECT CAST(event_timestamp AS DATE) AS event_date, event_type, severity, count(*) AS cnt, count(DISTINCT log_id) AS ids, count(DISTINCT assessment_id) AS assessments
FROM fx_audit GROUP BY 1, 2, 3"""


def q_assessment_sinks(s, d):
    """Profiles, scores, results and reports in two batches that overlap, the second committed twice; what the stores hold."""
    df, own = profiling.datasets_of(s, d)
    profiles = stored(datasets.profile_datasets(df, "ds", own), "profiles")
    parts = part_count(table(s, d, "orders"), reads.DETAIL_ROWS)
    # dealt by its key while it is narrow: what is committed of it lies by key, so no text is moved to be compared with a store
    done = stored_by(plan.assess(view(s, d, "fx_catalog", by=("o_orderkey", parts))), "assessed", "dataset_id", parts)
    reports = documents.report(done)
    name = F.coalesce(F.col("dataset_id"), F.lit(""))
    paths = {n: scratch_path(s, f"store-{n}") for n in ("profiles", "scores", "results", "reports")}
    for number in (0, 1, 1):
        part = lambda rows, test: rows.where(test) if number == 0 else rows  # noqa: B023, E731
        commits.commit_profiles(part(profiles, name.startswith("codes")), paths["profiles"], number)
        commits.commit_scores(part(done, F.col("dataset_id") % 3 == 0), paths["scores"], number, "dataset_id")
        commits.commit_results(part(done, F.col("dataset_id") % 3 == 0), paths["results"], number, "dataset_id")
        commits.commit_reports(part(reports, F.col("dataset_id") % 3 == 0), paths["reports"], number, "dataset_id")
    told = None
    for n, keys, total in (("profiles", ["dataset_id"], F.sum("shape.rows")), ("scores", ["dataset_id", "domain_number"], F.sum("score")),
                           ("results", ["assessment_id"], F.sum("total_domain_score")), ("reports", ["dataset_id"], F.sum(F.get_json_object("report_json", "$.cqi.total_score").cast("bigint")))):
        held = s.read.parquet(paths[n])
        one = held.agg(F.lit(n).alias("sink"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("batch_no") == 0).alias("first_batch"), total.cast("double").alias("total"))
        repeated = sinks.repeated_keys(held, keys).agg(F.count(F.lit(1)).alias("repeated_keys"))
        one = one.select("*", repeated.select("repeated_keys").scalar().alias("repeated_keys"))
        told = one if told is None else told.unionAll(one)
    return told


QUERIES["assessment_sinks"] = q_assessment_sinks
ORACLE["assessment_sinks"] = _ASSESSED + ", " + cte("fx_patients", "fx_codes").strip().removeprefix("WITH ") + """
SELECT 'profiles' AS sink, (SELECT count(*) FROM (SELECT DISTINCT site FROM fx_patients)) + 7 AS rows, CAST(7 AS BIGINT) AS first_batch, CAST((SELECT count(*) FROM fx_patients) + (SELECT count(*) FROM fx_codes) AS DOUBLE) AS total, CAST(0 AS BIGINT) AS repeated_keys
UNION ALL SELECT 'scores', 15 * count(*), 15 * count(*) FILTER (dataset_id % 3 = 0), CAST(sum(total_score) AS DOUBLE), 0 FROM assessed
UNION ALL SELECT 'results', count(*), count(*) FILTER (dataset_id % 3 = 0), CAST(sum(total_score) AS DOUBLE), 0 FROM assessed
UNION ALL SELECT 'reports', count(*), count(*) FILTER (dataset_id % 3 = 0), CAST(sum(total_score) AS DOUBLE), 0 FROM assessed"""

# ---- text sources ----------------------------------------------------------------------

_RAW_SQL = """SELECT CAST(c_custkey AS STRING) AS id, CASE c_custkey % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN 'null' WHEN 2 THEN 'none' WHEN 3 THEN '' WHEN 4 THEN '-1.#IND' ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 7 = 0 THEN 'NaN' WHEN c_custkey % 7 = 1 THEN '#N/A' ELSE CAST(c_nationkey AS STRING) END AS nation,
  CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'FALSE' END AS flag, CASE WHEN c_custkey % 5 = 0 THEN '<NA>' ELSE 'true' END AS half_flag,
  concat(CAST(c_custkey % 100 AS STRING), '.', '5e0') AS amount, CASE WHEN c_custkey < 0 THEN 'x' ELSE 'nan' END AS nothing FROM customer"""


def _raw(s, d):
    return run_sql(s, d, _RAW_SQL, "customer")


QUERIES["na_tokens"] = lambda s, d: readers.na_to_null(_raw(s, d)).select("id", "segment", "nation", "half_flag", "nothing")
_NA = ", ".join(f"'{t}'" for t in fixed.NA_TOKENS)
ORACLE["na_tokens"] = f"WITH r AS ({_RAW_SQL}) SELECT id, " + ", ".join(f"CASE WHEN {c} NOT IN ({_NA}) THEN {c} END AS {c}" for c in ("segment", "nation", "half_flag", "nothing")) + " FROM r"


def q_types(s, d):
    kinds = readers.infer_kinds(readers.na_to_null(_raw(s, d)))
    return s.createDataFrame(list(kinds.items()), "column_name string, kind string")


_KINDS = {"id": "bigint", "segment": "string", "nation": "bigint", "flag": "boolean", "half_flag": "string", "amount": "double", "nothing": "double"}
QUERIES["infer_types"] = q_types
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"
ORACLE["infer_types"] = f"WITH r0 AS ({_RAW_SQL}), r AS (SELECT " + ", ".join(f"CASE WHEN {c} NOT IN ({_NA}) THEN {c} END AS {c}" for c in _KINDS) + " FROM r0) " + " UNION ALL ".join(
    rf"SELECT '{c}' AS column_name, CASE WHEN count({c}) = 0 THEN 'double' WHEN bool_and(regexp_matches({c}, '^\s*[+-]?\d{{1,18}}\s*$')) THEN 'bigint' "
    rf"WHEN bool_and(regexp_matches({c}, '{_NUMBER}')) THEN 'double' WHEN count(*) FILTER ({c} IN ('true', 'True', 'TRUE', 'false', 'False', 'FALSE')) = count(*) THEN 'boolean' ELSE 'string' END AS kind FROM r"
    for c in _KINDS)


def _written(kind: str):
    def run(s, d):
        out = scratch_path(s, kind)
        raw = _raw(s, d)
        if kind == "json":
            raw.write.json(out)
            return readers.read_json(s, out, lines=True).groupBy("flag").agg(F.count(F.lit(1)).alias("rows"), F.count("segment").alias("segments"))
        raw.write.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(out)
        df = readers.read_dataset(s, out, kind)
        return df.groupBy("flag").agg(F.count(F.lit(1)).alias("rows"), F.count("segment").alias("segments"), F.count("nation").alias("nations"),
                                      F.sum("nation").alias("nation_sum"), F.round(F.sum("amount"), 2).alias("amount_sum"))
    return run


_READ = f"WITH r AS ({_RAW_SQL}) "
for _kind in ("csv", "tsv"):
    QUERIES[f"read_{_kind}"] = _written(_kind)
    ORACLE[f"read_{_kind}"] = _READ + f"""SELECT flag = 'True' AS flag, count(*) AS rows, count(*) FILTER (segment NOT IN ({_NA})) AS segments, count(*) FILTER (nation NOT IN ({_NA})) AS nations,
  CAST(sum(TRY_CAST(nation AS BIGINT)) AS BIGINT) AS nation_sum, round(sum(CAST(amount AS DOUBLE)), 2) AS amount_sum FROM r GROUP BY 1"""
    ORACLE[f"read_{_kind}"] = ORACLE[f"read_{_kind}"].replace("TRY_CAST(nation AS BIGINT)", f"CASE WHEN nation NOT IN ({_NA}) THEN CAST(nation AS BIGINT) END")


def q_read_parquet(s, d):
    """Every supplied relational table read by its format and profiled by column: rows, missing cells, least and greatest number."""
    told = None
    for name in ("lineitem", "orders", "customer", "part", "supplier"):
        df = readers.ingest(s, f"{d.rstrip('/')}/{name}.parquet", "parquet").data
        one = grouped.unpivot(df, []).groupBy("column_name").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("num").isNull() & F.col("txt").isNull()).alias("missing"),
                                                                 F.min("num").alias("min"), F.max("num").alias("max"))
        one = one.select(F.lit(name).alias("table_name"), "*")
        told = one if told is None else told.unionAll(one)
    return told


_PARQUET_COLS = {
    "lineitem": (profiling.LINE_NUMERIC, ["l_returnflag", "l_linestatus", "l_shipdate"]),
    "orders": (["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderdate", "o_orderpriority"]),
    "customer": (["c_custkey", "c_nationkey", "c_acctbal"], ["c_name", "c_mktsegment"]),
    "part": (["p_partkey", "p_size", "p_retailprice"], ["p_name", "p_brand", "p_type"]),
    "supplier": (["s_suppkey", "s_nationkey", "s_acctbal"], ["s_name"])}
QUERIES["read_parquet"] = q_read_parquet
ORACLE["read_parquet"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS missing, " + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max" if c in numbers else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max")
    + f" FROM {t}" for t, (numbers, others) in _PARQUET_COLS.items() for c in [*numbers, *others])
QUERIES["read_json"] = _written("json")
ORACLE["read_json"] = _READ + "SELECT flag, count(*) AS rows, count(segment) AS segments FROM r GROUP BY flag"


# ---- archives and files ----------------------------------------------------------------

def _zip(batches):
    for pdf in batches:
        out = []
        for key, name in zip(pdf["c_custkey"], pdf["c_name"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as z:
                z.writestr("__MACOSX/data.csv", "no")
                z.writestr("folder/.hidden.csv", "no")
                z.writestr("notes.txt", "no")
                if key % 5:
                    z.writestr("folder/data.csv" if key % 2 else "data.json", f"id,name\n{key},{name}\n" if key % 2 else f'[{{"id":{key}}}]')
                z.writestr("LATE.CSV", "no")
            out.append((f"archive-{key}.zip", buffer.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def _archives(s, d):
    return spread(table(s, d, "customer").select("c_custkey", "c_name")).mapInPandas(_zip, "path string, content binary")


QUERIES["zip_first_member"] = lambda s, d: archives.first_members(_archives(s, d))
ORACLE["zip_first_member"] = r"""SELECT 'archive-' || c_custkey || '.zip' AS archive, CASE WHEN c_custkey % 5 <> 0 THEN 3 END AS member_ordinal,
  CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 2 = 1 THEN 'folder/data.csv' ELSE 'data.json' END END AS member,
  CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 2 = 1 THEN 'csv' ELSE 'json' END END AS ext,
  CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 2 = 1 THEN 'id,name' || chr(10) || c_custkey || ',' || c_name || chr(10) ELSE '[{"id":' || c_custkey || '}]' END END AS content FROM customer"""
QUERIES["zip_lines"] = lambda s, d: archives.member_lines(archives.first_members(_archives(s, d))).where(F.col("line_no") > 0).select(
    "archive", F.col("fields")[0].alias("id"), F.col("fields")[1].alias("name"))
ORACLE["zip_lines"] = "SELECT 'archive-' || c_custkey || '.zip' AS archive, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 2 = 1"

_PATHS = "SELECT concat('store/', source, '/doc.', CAST(doc_id AS STRING), CASE doc_id % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '' WHEN 2 THEN '.json' ELSE '.tar.gz' END) AS path, n_chars AS length FROM documents"
QUERIES["file_facts"] = lambda s, d: files.facts_of_files(run_sql(s, d, _PATHS, "documents"))
ORACLE["file_facts"] = """SELECT 'doc.' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.CSV' WHEN 1 THEN '' WHEN 2 THEN '.json' ELSE '.tar.gz' END AS filename,
  CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN CAST(doc_id AS VARCHAR) WHEN 2 THEN 'json' ELSE 'gz' END AS format, n_chars AS size_bytes, 'UTF-8' AS encoding FROM documents"""


def _contents(s, d):
    return table(s, d, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))


QUERIES["content_digests"] = lambda s, d: files.file_digests(_contents(s, d))
ORACLE["content_digests"] = "SELECT 'doc-' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size_bytes, sha256(text) AS sha256, true AS valid_utf8 FROM documents"
QUERIES["duplicate_contents"] = lambda s, d: files.duplicate_files(files.file_digests(_contents(s, d)))
ORACLE["duplicate_contents"] = """WITH h AS (SELECT 'doc-' || doc_id AS path, sha256(text) AS sha256 FROM documents), f AS (SELECT sha256, min(path) AS first_path FROM h GROUP BY 1 HAVING count(*) > 1)
SELECT path, first_path, sha256 FROM h JOIN f USING (sha256) WHERE path <> first_path"""
_SIZES = "SELECT o_orderkey AS id, o_orderkey * 100 AS size_bytes, o_orderkey % 97 * 13 AS compressed_size_bytes FROM orders"
QUERIES["compression_ratio"] = lambda s, d: files.compression_ratio(run_sql(s, d, _SIZES, "orders"))
ORACLE["compression_ratio"] = f"WITH z AS ({_SIZES}) SELECT *, CASE WHEN compressed_size_bytes > 0 THEN round(CAST(size_bytes AS DOUBLE) / compressed_size_bytes, 4) END AS compression_ratio FROM z"

_BUNDLE_SQL = """SELECT c_nationkey AS id, CASE WHEN c_nationkey % 5 = 0 THEN '{"resourceType":"Patient"}' ELSE concat('{"resourceType":"Bundle","entry":[{"resource":{"resourceType":"Patient","id":"p',
  CAST(c_custkey AS STRING), '","gender":"female"}},{"resource":{"resourceType":"Observation","id":"o', CAST(c_custkey AS STRING), '"}}]}') END AS doc, c_custkey AS k FROM customer"""
QUERIES["fhir_entries"] = lambda s, d: fhir.bundle_entries(run_sql(s, d, _BUNDLE_SQL, "customer"), "k", "doc")
ORACLE["fhir_entries"] = f"WITH b AS ({_BUNDLE_SQL}) " + """SELECT k, 0 AS entry_no, 'Patient' AS resource_type, 'p' || k AS resource_id FROM b WHERE id % 5 <> 0
UNION ALL SELECT k, 1, 'Observation', 'o' || k FROM b WHERE id % 5 <> 0"""
QUERIES["fhir_detect"] = lambda s, d: fhir.detect(run_sql(s, d, _BUNDLE_SQL, "customer"), "k", "doc")
ORACLE["fhir_detect"] = f"WITH b AS ({_BUNDLE_SQL}) SELECT k, CASE WHEN id % 5 = 0 THEN 'Patient' ELSE 'Bundle' END AS resource_type, id % 5 <> 0 AS is_bundle FROM b"


# ---- records that no line break ends -----------------------------------------------------

_ID_AND_CELLS = ["CAST(doc_id AS STRING) AS id", "coalesce(text, '') AS body", "coalesce(lang, '') AS lang"]


def q_multiline(s, d):
    """Every document as a quoted cell with its line breaks, commas and quotes; files are read by byte ranges."""
    out = scratch_path(s, "multiline")
    cells_ = table(s, d, "documents").selectExpr(*_ID_AND_CELLS)
    cells_.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxRecordsPerFile=100_000).csv(out)
    df = readers.read_csv(s, out, multi_line="records")
    return df.select(F.col("id").alias("doc_id"), F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"), "lang")


def q_json_array(s, d):
    """Every document as an object of arrays that stand in one line each; files are read by byte ranges."""
    out = scratch_path(s, "arrays")
    objects = table(s, d, "documents").select(F.to_json(F.struct(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("body"),
        F.struct("lang", F.array(*map(F.lit, ("]", "}", '"', "{"))).alias("marks")).alias("about"))).alias("object"))
    dealt = objects.withColumn("file", F.pmod(F.xxhash64("object"), F.lit(2)))
    part = dealt.groupBy("file", F.spark_partition_id().alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("object"), ", "), F.lit("]")).alias("value"))
    part.select("value").write.text(out)
    df = readers.read_json(s, out, apart=True)
    return df.select(F.col("id").alias("doc_id"), F.length("body").cast("long").alias("n_chars"), F.md5("body").alias("body_md5"), F.col("about.lang").alias("lang"), F.size("about.marks").alias("marks"))


_BODY = "doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS body_md5, lang"
QUERIES["read_csv_records"] = q_multiline
ORACLE["read_csv_records"] = f"SELECT {_BODY} FROM documents"
QUERIES["read_json_array"] = q_json_array
ORACLE["read_json_array"] = f"SELECT {_BODY}, 4 AS marks FROM documents"
