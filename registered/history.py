"""Read paths, dashboard analytics and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions import fixed
from assayframe.operators import documents, reads
from assayframe.operators import domains as dom
from assayframe.plans import assess as plan
from registered import scoring
from registered.fixtures import cte, view

QUERIES = {}
ORACLE = {}


def _assessments(s, d):
    return view(s, d, "fx_assessments")


_PAGE = ["assessment_id", "dataset_id", "status", "submission_timestamp", "cqi", "prs", "position", "total"]


def q_history(spark, sf_dir):
    """First page of every dataset's history with its results."""
    pages = reads.pages_of(_assessments(spark, sf_dir), "dataset_id", limit=10)
    return pages.join(view(spark, sf_dir, "fx_results"), "assessment_id", "left").select(*_PAGE)


QUERIES["dataset_history"] = q_history
ORACLE["dataset_history"] = cte("fx_assessments", "fx_results") + """, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY submission_timestamp DESC, assessment_id) AS INT) AS position,
  count(*) OVER (PARTITION BY dataset_id) AS total FROM fx_assessments)
SELECT assessment_id, dataset_id, status, submission_timestamp, cqi, prs, position, total FROM p LEFT JOIN fx_results USING (assessment_id) WHERE position <= 10"""

QUERIES["dataset_history_page"] = lambda s, d: reads.history_page(
    _assessments(s, d), view(s, d, "fx_results"), "dataset_7", status="complete", limit=10, offset=2).select(
    "assessment_id", "dataset_id", "submission_timestamp", "cqi", "prs", "total")
ORACLE["dataset_history_page"] = cte("fx_assessments", "fx_results") + """, m AS (SELECT * FROM fx_assessments WHERE dataset_id = 'dataset_7' AND status = 'complete')
SELECT assessment_id, dataset_id, submission_timestamp, cqi, prs, (SELECT count(*) FROM m) AS total
FROM (SELECT * FROM m ORDER BY submission_timestamp DESC, assessment_id LIMIT 10 OFFSET 2) LEFT JOIN fx_results USING (assessment_id)"""

QUERIES["user_history"] = lambda s, d: reads.pages_of(_assessments(s, d), "user_id", limit=5).select(
    "user_id", "assessment_id", "status", "submission_timestamp", "position", "total")
ORACLE["user_history"] = cte("fx_assessments") + """SELECT user_id, assessment_id, status, submission_timestamp, position, total FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY submission_timestamp DESC, assessment_id) AS INT) AS position, count(*) OVER (PARTITION BY user_id) AS total FROM fx_assessments) WHERE position <= 5"""
QUERIES["user_history_page"] = lambda s, d: reads.user_page(_assessments(s, d), 37, skip=1, limit=10)
ORACLE["user_history_page"] = cte("fx_assessments") + "SELECT * FROM fx_assessments WHERE user_id = 37 ORDER BY submission_timestamp DESC, assessment_id LIMIT 10 OFFSET 1"

QUERIES["audit_trail"] = lambda s, d: reads.audit_trail(view(s, d, "fx_audit"))
ORACLE["audit_trail"] = cte("fx_audit") + "SELECT * FROM fx_audit"
QUERIES["audit_positions"] = lambda s, d: reads.audit_positions(view(s, d, "fx_audit")).select("log_id", "assessment_id", "event_timestamp", "position")
ORACLE["audit_positions"] = cte("fx_audit") + "SELECT log_id, assessment_id, event_timestamp, row_number() OVER (ORDER BY assessment_id, event_timestamp, log_id) AS position FROM fx_audit"
QUERIES["completion_log_pick"] = lambda s, d: reads.completion_log(view(s, d, "fx_audit"))
ORACLE["completion_log_pick"] = cte("fx_audit") + """SELECT assessment_id, coalesce(first(log_id ORDER BY event_timestamp, log_id) FILTER (event_type = 'assessment_complete'),
  first(log_id ORDER BY event_timestamp, log_id)) AS audit_log_id FROM fx_audit GROUP BY assessment_id"""

for _role, _who, _cond in (("submitter", 37, "user_id = 37"), ("reviewer", None, "true"), ("admin", None, "false")):
    QUERIES[f"visible_{_role}"] = lambda s, d, r=_role, w=_who: reads.visible_to(_assessments(s, d), r, w)
    ORACLE[f"visible_{_role}"] = cte("fx_assessments") + f"SELECT * FROM fx_assessments WHERE {_cond}"

def q_detail(spark, sf_dir):
    catalog = view(spark, sf_dir, "fx_catalog")
    told = plan.assess(reads.by_key(catalog, "dataset_id")).withColumnRenamed("dataset_id", "assessment_id")
    scores = dom.long_scores(told, "assessment_id")
    done = plan.assess(catalog).withColumnRenamed("dataset_id", "assessment_id")
    results = plan.results(done, "assessment_id")  # narrower than the catalog's rows
    meta = catalog.select(F.col("dataset_id").alias("assessment_id"), "dataset_name", "sensitivity_class")
    facts = catalog.select(F.col("dataset_id").alias("assessment_id"), "overall_completeness_pct", "file_format",
                                                     "size_bytes", "direct_identifiers_detected", "icd_codes_present")
    doc = reads.detail(_assessments(spark, sf_dir), results, scores, meta, facts, view(spark, sf_dir, "fx_audit"))
    return doc.select(
        "assessment_id", "status", "dataset_id", "dataset_name", F.col("cqi.value").alias("cqi_value"), F.col("cqi.band").alias("cqi_band"),
        F.col("prs.value").alias("prs_value"), F.col("prs.adjusted_risk").alias("adjusted_risk"), F.col("release.classification").alias("release_class"),
        F.when(F.col("domain_scores").isNotNull(), F.size("domain_scores")).alias("n_scores"),
        F.col("domain_scores")[0]["score"].alias("first_score"), F.col("domain_scores")[10]["max_score"].isNull().alias("skipped"),
        F.col("profile_summary.rows").alias("rows_seen"), F.col("profile_summary.overall_completeness_pct").alias("completeness"), "audit_log_id")


QUERIES["assessment_detail"] = q_detail
ORACLE["assessment_detail"] = (
    cte("fx_catalog", "fx_assessments", "fx_audit") + scoring.assessed_ctes() + """,
pick AS (SELECT assessment_id, coalesce(first(log_id ORDER BY event_timestamp, log_id) FILTER (event_type = 'assessment_complete'),
  first(log_id ORDER BY event_timestamp, log_id)) AS log FROM fx_audit GROUP BY assessment_id)
SELECT a.assessment_id, a.status, a.dataset_id, CASE WHEN ok THEN r.dataset_name END AS dataset_name, CASE WHEN ok THEN r.cqi END AS cqi_value,
  CASE WHEN ok THEN r.cqi_band END AS cqi_band, CASE WHEN ok THEN r.prs END AS prs_value, CASE WHEN ok THEN r.baseline_risk * r.sensitivity_multiplier END AS adjusted_risk,
  CASE WHEN ok THEN r.release_class END AS release_class, CASE WHEN ok THEN 15 END AS n_scores, CASE WHEN ok THEN r.d01 END AS first_score,
  CASE WHEN ok THEN r.d11 IS NULL ELSE true END AS skipped, CASE WHEN ok THEN 0 END AS rows_seen, CASE WHEN ok THEN r.overall_completeness_pct END AS completeness,
  CASE WHEN ok THEN coalesce(CAST(log AS VARCHAR), CAST(a.assessment_id AS VARCHAR)) END AS audit_log_id
FROM (SELECT *, status = 'complete' AS ok FROM fx_assessments) a JOIN assessed r ON r.dataset_id = a.assessment_id LEFT JOIN pick ON pick.assessment_id = a.assessment_id""")

QUERIES["run_counters"] = lambda s, d: reads.run_counters(_assessments(s, d))
ORACLE["run_counters"] = cte("fx_assessments") + "SELECT count(*) AS total, count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status IN ('processing', 'queued')) AS in_progress FROM fx_assessments"


def _scores(spark, sf_dir):
    """Stored score rows without texts."""
    done = dom.with_scores(view(spark, sf_dir, "fx_catalog"))
    return dom.score_rows(done)


def q_gaps(spark, sf_dir):
    return reads.gap_panel(dom.long_scores(plan.assess(view(spark, sf_dir, "fx_catalog"))))


QUERIES["gap_panel"] = q_gaps
_NAME = {n: name for n, name, _ in fixed.DOMAINS}
ORACLE["gap_panel"] = cte("fx_catalog") + ", weak AS (" + " UNION ALL ".join(
    f"SELECT dataset_id, {n} AS domain_number, '{_NAME[n]}' AS domain_name, score, list_filter([{', '.join('CAST(' + g + ' AS VARCHAR)' for g in gaps)}], lambda x: x IS NOT NULL) AS gaps "
    f"FROM (SELECT *, CAST({scoring.score_sql(n)} AS INT) AS score FROM fx_catalog) WHERE score <= 2" for n, (_, _, gaps) in scoring.TEXTS.items()) + """),
spread AS (SELECT *, CAST(unnest(range(0, greatest(len(gaps), 1))) AS INT) AS gap_index FROM weak)
SELECT dataset_id, domain_number, domain_name, score, gap_index, coalesce(gaps[gap_index + 1], 'General quality improvement recommended.') AS gap FROM spread"""

_LONG = cte("fx_catalog") + f", scored AS ({scoring.scored_sql()}), l AS (" + " UNION ALL ".join(
    f"SELECT dataset_id, {n} AS domain_number, d{n:02d} AS score FROM scored" for n in scoring.SCORES) + ") "
QUERIES["radar"] = lambda s, d: reads.radar(_scores(s, d))
ORACLE["radar"] = _LONG + "SELECT dataset_id, 'D' || domain_number AS label, coalesce(score, 0) AS value, 4 AS full_mark FROM l"
QUERIES["radar_wide"] = lambda s, d: reads.radar_wide(_scores(s, d))
ORACLE["radar_wide"] = _LONG + "SELECT dataset_id, " + ", ".join(f"coalesce(max(CASE WHEN domain_number = {n} THEN score END), 0) AS D{n}" for n in range(1, 16)) + " FROM l GROUP BY dataset_id"
QUERIES["score_progress"] = lambda s, d: reads.score_progress(_scores(s, d))
ORACLE["score_progress"] = _LONG + "SELECT dataset_id, domain_number, score, CAST(score AS DOUBLE) / 4 * 100 AS progress_pct FROM l"
QUERIES["gaps_and_strengths"] = lambda s, d: reads.gaps_and_strengths(_scores(s, d)).select(
    "dataset_id", F.array_join("weak_domains", ",").alias("weak"), F.array_join("strong_domains", ",").alias("strong"))
ORACLE["gaps_and_strengths"] = _LONG + """SELECT dataset_id, coalesce(string_agg(CAST(domain_number AS VARCHAR), ',' ORDER BY score, domain_number) FILTER (score <= 2), '') AS weak,
  coalesce(string_agg(CAST(domain_number AS VARCHAR), ',' ORDER BY domain_number) FILTER (score >= 3), '') AS strong FROM l GROUP BY dataset_id"""

QUERIES["history_listing"] = lambda s, d: _assessments(s, d).join(view(s, d, "fx_results"), "assessment_id", "left").select(
    "assessment_id", "dataset_id", "submission_timestamp", "status", "cqi", "prs")
ORACLE["history_listing"] = cte("fx_assessments", "fx_results") + "SELECT assessment_id, dataset_id, submission_timestamp, status, cqi, prs FROM fx_assessments LEFT JOIN fx_results USING (assessment_id)"


def q_report(spark, sf_dir):
    """Reports parsed back to a few of their leaves."""
    doc = documents.report(plan.assess(view(spark, sf_dir, "fx_catalog")), computed_at=F.lit("2024-01-01T00:00:00"))
    told = doc.select("dataset_id", F.from_json("report_json", (
        "dataset_name string, cqi struct<value:double,formula_trace:string>, prs struct<value:int>, release struct<classification:string>, "
        "domain_scores array<struct<score:int,confidence:string>>, domain_11_applicable boolean, "
        "profile_summary struct<overall_completeness_pct:double>")).alias("r"))
    return told.select("dataset_id", "r.dataset_name", F.col("r.cqi.value").alias("cqi"), F.col("r.cqi.formula_trace").alias("cqi_trace"),
                       F.col("r.prs.value").alias("prs"), F.col("r.release.classification").alias("release_class"),
                       F.col("r.domain_scores")[6]["score"].alias("d07"), F.col("r.domain_scores")[10]["confidence"].alias("d11_confidence"),
                       F.col("r.domain_11_applicable").alias("d11_applicable"),
                       F.col("r.profile_summary.overall_completeness_pct").alias("completeness"))


QUERIES["report_json"] = q_report
ORACLE["report_json"] = (cte("fx_catalog") + scoring.assessed_ctes() + " SELECT dataset_id, dataset_name, cqi, cqi_trace, prs, release_class, d07, 'Low' AS d11_confidence, "
                         "d11 IS NOT NULL AS d11_applicable, overall_completeness_pct AS completeness FROM assessed")


def q_payload(spark, sf_dir):
    doc = documents.payload(plan.assess(view(spark, sf_dir, "fx_catalog")), assessed_at=F.lit("2024-01-01T00:00:00"))
    told = doc.select("dataset_id", F.from_json("payload_json", (
        "cqi_band string, prs int, report_url string, domain_scores map<string,struct<score:int,confidence:string>>")).alias("p"))
    privacy, synthetic = (F.col("p.domain_scores")[k] for k in ("7_privacy_identifiability", "11_synthetic_simulated_data"))
    return told.select("dataset_id", "p.cqi_band", "p.prs", "p.report_url", privacy["score"].alias("d07"),
                       privacy["confidence"].alias("d07_confidence"), synthetic["confidence"].alias("d11_confidence"))


QUERIES["payload"] = q_payload
ORACLE["payload"] = (cte("fx_catalog") + scoring.assessed_ctes() + " SELECT dataset_id, cqi_band, prs, 'http://localhost:8000/api/v1/assess/' || dataset_id || '/report?format=html' AS report_url, d07, "
                     "CASE WHEN direct_identifiers_detected THEN 'High' ELSE 'Medium' END AS d07_confidence, CASE WHEN d11 IS NOT NULL THEN 'Low' END AS d11_confidence FROM assessed")
QUERIES["headline"] = lambda s, d: documents.headline(plan.assess(view(s, d, "fx_catalog"), texts=False))
ORACLE["headline"] = cte("fx_catalog") + scoring.assessed_ctes() + " SELECT dataset_id, dataset_name, cqi, cqi_band, prs, prs_band, release_class FROM assessed"
