"""Score ladders, composite cases and the release grid."""

import itertools

import pytest

from assayframe.operators import composite
from assayframe.operators import domains as dom
from assayframe.plans import criteria as crit

# --- fixed values: (domain, fields, expected score) ---
CASES = [
    (1, {}, 1), (1, {"annotation_methodology": "Manual"}, 1), (1, {"annotation_methodology": "Manual", "irr_value": 0.5, "num_annotators": 2}, 2),
    (1, {"annotation_methodology": "Manual", "irr_value": 0.7, "num_annotators": 2}, 3),
    (1, {"annotation_methodology": "Manual", "irr_value": 0.85, "num_annotators": 2, "annotator_qualifications": "MDs"}, 4),
    (1, {"annotation_methodology": "Manual", "irr_value": 0.85, "num_annotators": 0, "annotator_qualifications": "MDs"}, 2),
    (2, {"dataset_name": "Test"}, 1), (2, {"dataset_name": "T", "dataset_version": "1", "dataset_type": "t", "study_type": "RCT"}, 2),
    (3, {}, 1), (3, {"data_dictionary_uploaded": True, "ethics_approval_ref": "E"}, 2), (3, {"ethics_approval_ref": "  \t"}, 1),
    (4, {}, 1), (4, {"geographic_coverage": "village", "num_sites": 1}, 2), (4, {"geographic_coverage": "state", "num_sites": 3}, 3),
    (4, {"geographic_coverage": "national", "num_sites": 5, "sex_distribution": "both"}, 4), (4, {"geographic_coverage": "multi_country"}, 1),
    (5, {"overall_completeness_pct": 45.0}, 1), (5, {"overall_completeness_pct": 60.0}, 1), (5, {"overall_completeness_pct": 80.0}, 2),
    (5, {"overall_completeness_pct": 95.0}, 3), (5, {"overall_completeness_pct": 95.0, "icd_codes_present": True}, 4), (5, {"standards_used": "None"}, 3),
    (6, {"file_format": "pdf"}, 1), (6, {"file_format": "CSV"}, 2), (6, {"data_dictionary_uploaded": True}, 3),
    (6, {"data_dictionary_uploaded": True, "provenance_pipeline_available": True}, 4),
    (6, {"data_dictionary_uploaded": True, "provenance_pipeline_available": True, "imbalance_ratio": 3.5}, 3),
    (7, {"direct_identifiers_detected": True}, 1), (7, {}, 1), (7, {"deidentification_method": "a"}, 2), (7, {"deidentification_method": "  "}, 2),
    (7, {"deidentification_method": "a", "k_anonymity_value": 5}, 3), (7, {"deidentification_method": "a", "k_anonymity_value": 10}, 4),
    (7, {"deidentification_method": "a", "differential_privacy_applied": True}, 4),
    (8, {}, 1), (8, {"access_control_method": "Public"}, 2), (8, {"access_control_method": "approval required", "dua_required": True}, 3),
    (8, {"access_control_method": "role-based access", "dua_required": True}, 4), (8, {"access_control_method": "friends"}, 2),
    (9, {}, 1), (9, {"version_format": "none"}, 2), (9, {"provenance_pipeline_available": True}, 3), (9, {"changelog_provided": True}, 4),
    (10, {}, 1), (10, {"ethics_approval_ref": "E"}, 1), (10, {"ethics_approval_ref": "E", "consent_type": "w"}, 2),
    (10, {"ethics_approval_ref": "E", "consent_type": "w", "community_engagement": True}, 3),
    (10, {"ethics_approval_ref": "E", "consent_type": "w", "equity_analysis_performed": True, "redressal_mechanism_exists": True}, 4),
    (11, {}, None), (11, {"synthetic_data_pct": 0.0}, None), (11, {"synthetic_data_pct": 10.0}, 1),
    (11, {"synthetic_data_pct": 10.0, "synthetic_privacy_tested": True}, 1), (11, {"synthetic_data_pct": 10.0, "synthetic_utility_evaluated": True}, 2),
    (11, {"synthetic_data_pct": 10.0, "synthetic_utility_evaluated": True, "synthetic_privacy_tested": True}, 3),
    (11, {"synthetic_data_pct": 60.0, "synthetic_utility_evaluated": True, "synthetic_privacy_tested": True}, 4),
    (12, {}, 1), (12, {"named_steward_exists": True}, 2), (12, {"named_steward_exists": True, "dpdp_compliance_status": "partially_compliant"}, 3),
    (12, {"named_steward_exists": True, "dpdp_compliance_status": "fully_compliant"}, 4),
    (13, {}, 3), (13, {"linked_model_ids": []}, 3), (13, {"linked_model_ids": ["a"]}, 3), (13, {"linked_model_ids": ["a", "b"]}, 4),
    (14, {"file_format": "parquet", "size_bytes": 50000000}, 3), (14, {"size_bytes": 5000000}, 3), (14, {"size_bytes": 50000000}, 2),
    (14, {"sustainability_info_provided": True}, 4),
    (15, {}, 1), (15, {"github_repo_url": "u"}, 2), (15, {"changelog_provided": True}, 3), (15, {"github_repo_url": "u", "changelog_provided": True}, 4),
]
TYPES = {"irr_value": "double", "num_annotators": "int", "num_sites": "int", "k_anonymity_value": "int", "synthetic_data_pct": "double",
         "overall_completeness_pct": "double", "imbalance_ratio": "double", "size_bytes": "bigint", "linked_model_ids": "array<string>"}


def _kind(name, value):
    return TYPES.get(name, "boolean" if isinstance(value, bool) else "string")


@pytest.fixture(scope="module")
def scored(spark):
    kinds = {n: _kind(n, v) for _, fields, _ in CASES for n, v in fields.items()}
    rows = [(i, *[fields.get(n) for n in kinds]) for i, (_, fields, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "dataset_id int, " + ", ".join(f"{n} {t}" for n, t in kinds.items()))
    return {r["dataset_id"]: r for r in dom.with_scores(df).collect()}


def test_every_score_level(scored):
    wrong = [(i, d, f, want, scored[i][dom.score_name(d)]) for i, (d, f, want) in enumerate(CASES) if scored[i][dom.score_name(d)] != want]
    assert not wrong
    values = {r[dom.score_name(n)] for r in scored.values() for n in range(1, 16)}
    assert values <= {1, 2, 3, 4, None}


def test_threshold_override(spark):
    df = spark.createDataFrame([("a", "national", 3, "both")], "dataset_id string, geographic_coverage string, num_sites int, sex_distribution string")
    assert dom.with_scores(df).first()["d04"] == 4
    assert dom.with_scores(df, crit.literals({"multi_site_min": 5})).first()["d04"] == 2
    assert crit.from_document({"domains": {"4": {"thresholds": {"multi_site_min": 5}}}})["multi_site_min"] == 5


def test_unreadable_number_falls_back(spark):
    df = spark.createDataFrame([("a", "national", "many")], "dataset_id string, geographic_coverage string, num_sites string")
    got = dom.one_domain(df, 4).first()
    assert got.score == 1 and got.confidence == "Low"
    assert got.gaps == ["Scoring failed: invalid literal for int() with base 10: 'many'"]


def test_model_links_as_json(spark):
    df = spark.createDataFrame([(1, '["m"]'), (2, '{"a":"b"}'), (3, "[]"), (4, None)], "dataset_id int, linked_model_ids string")
    rows = {r.dataset_id: r for r in dom.one_domain(df, 13).collect()}
    assert [rows[i].score for i in (1, 2, 3, 4)] == [3, 4, 3, 3]
    assert rows[1].evidence_items == ["Linked model IDs: ['m']"]


def test_release_grid(spark):
    rows = [(c, p, b, s, d) for c, (p, b), s, d in itertools.product(
        [10.0, 30.0, 55.0, 75.0, 90.0, 97.0], [(10, "Low"), (30, "Moderate"), (50, "High"), (80, "Very High")],
        ["standard", "high_stigma", "critical"], [True, False])]
    df = spark.createDataFrame(rows, "cqi double, prs int, prs_band string, sensitivity_class string, dp_verified boolean")

    def expected(c, b, s, d):
        guarded, risky = s != "standard", b in ("High", "Very High")
        if guarded and (risky or not d):
            return ("Restricted" if risky else "Controlled", True)
        if risky or (c < 50 and b == "Moderate"):
            return "Restricted", False
        return ("Open" if c >= 70 and b == "Low" else "Controlled", False)

    for r in composite.with_release(df).collect():
        assert (r.release_class, r.policy_override_applied) == expected(r.cqi, r.prs_band, r.sensitivity_class, r.dp_verified), r


def test_risk_cases(spark):
    rows = [(True, False, "state", False, "standard"), (False, True, "village", True, "standard"), (False, False, "village", True, "standard"),
            (False, False, "district", False, "high_stigma"), (False, False, "state", False, "critical"), (False, False, None, False, None)]
    df = spark.createDataFrame(rows, "direct_identifiers_detected boolean, differential_privacy_applied boolean, location_granularity string, "
                               "rare_condition_flag boolean, sensitivity_class string")
    got = [(r.baseline_risk, r.prs, r.prs_band) for r in composite.with_prs(df).collect()]
    assert got == [(50.0, 50, "High"), (20.0, 20, "Moderate"), (30.0, 30, "Moderate"), (15.0, 23, "Moderate"), (5.0, 10, "Low"), (15.0, 15, "Low")]


def test_cqi_extremes(spark):
    names = [dom.score_name(n) for n in range(1, 16)]
    df = spark.createDataFrame([[4] * 15, [1] * 15, [4] * 10 + [None] + [4] * 4, [None] * 15], ", ".join(f"{n} int" for n in names))
    got = [(r.total_score, r.max_possible, r.cqi, r.cqi_band) for r in composite.with_cqi(df).collect()]
    assert got == [(60, 60, 100.0, "Diamond"), (15, 60, 25.0, "Bronze"), (56, 56, 100.0, "Diamond"), (0, 0, 0.0, "Remediation")]


def test_result_filter_stays_above_the_scorers(spark, sf_dir):
    from registered import extras
    plan = extras.QUERIES["band_search"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
