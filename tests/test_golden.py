"""The screening table of eleven rows and its hand-traced results."""

import datetime as dt

import pytest

from assayframe.operators import domains as dom
from assayframe.plans import assess, profile
from assayframe.sources import readers

# --- fixed values: input table and expected results ---
TABLE = """id,age_years,sex,bmi,hiv_status,cough_2weeks,cough_duration_weeks,fever,night_sweats,weight_loss,hemoptysis,chest_pain,fatigue,loss_of_appetite,who_symptom_screen_count,smear_result,xpert_mtb_detected,xpert_rif_resistance,cxr_result,cxr_abnormal,true_tb_status,tb_type,tb_classification,rifampicin_resistant,treatment_outcome
1,34,F,23.4,0,0,0,0,0,1,0,0,0,0,1,0,0,N/A,normal,0,0,none,not_tb,0,not_applicable
2,17,M,19.7,0,1,5,1,1,0,0,0,0,1,3,1,1,not_detected,infiltrate,1,1,pulmonary,smear_positive_ptb,0,cured
3,42,F,17.0,1,1,7,0,1,1,0,1,1,0,3,1,1,not_detected,normal,0,1,extrapulmonary,extrapulmonary_tb,0,cured
4,51,F,19.1,0,1,4,0,0,0,0,0,1,0,1,0,0,N/A,normal,0,0,none,not_tb,0,not_applicable
5,42,M,19.5,0,0,0,0,0,1,0,0,1,0,1,0,0,N/A,normal,0,0,none,not_tb,0,not_applicable
6,16,F,20.8,0,0,0,0,0,0,0,0,1,1,0,0,0,N/A,normal,0,0,none,not_tb,0,not_applicable
7,52,F,20.9,0,1,3,0,0,0,0,0,0,0,1,0,0,N/A,other_pathology,1,0,none,not_tb,0,not_applicable
8,30,F,23.8,0,0,0,0,0,0,0,0,0,0,0,0,0,N/A,normal,0,0,none,not_tb,0,not_applicable
9,53,M,17.2,0,1,4,1,1,1,0,1,0,0,4,1,1,not_detected,infiltrate,1,1,pulmonary,smear_positive_ptb,0,completed
10,16,M,27.6,0,0,0,0,0,1,0,1,0,0,1,0,0,N/A,normal,0,0,none,not_tb,0,not_applicable
11,39,M,27.6,0,1,5,1,0,0,0,0,0,1,2,0,0,N/A,other_pathology,1,0,none,not_tb,0,not_applicable
"""
FORM = {
    "dataset_name": "Synthetic TB Screening Dataset (Golden 11-row)", "dataset_version": "1.0.0", "dataset_type": "tabular",
    "study_type": "observational", "target_population": "Synthetic patients undergoing TB screening at LMIC health facilities",
    "geographic_coverage": "district", "age_range_min": 16, "age_range_max": 65, "sex_distribution": "both", "num_sites": 1,
    "collection_start_date": dt.date(2024, 1, 1), "collection_end_date": dt.date(2024, 12, 31), "standards_used": "ICD-10",
    "ethics_approval_ref": "IEC/2024/TB-001", "consent_type": "individual", "deidentification_method": "HIPAA Safe Harbor",
    "sensitivity_class": "high_stigma", "license_type": "CC BY-NC 4.0", "synthetic_data_pct": 0.0,
    "access_control_method": "Formal access request process", "version_format": "none", "dua_required": True,
    "location_granularity": "district", "temporal_granularity": "month", "dq_checks_applied": [],
}
SCORES = [1, 4, 2, 2, 4, 2, 2, 3, 2, 2, None, 1, 3, 3, 1]


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "table.csv"
    path.write_text(TABLE)
    df = readers.read_dataset(spark, str(path), "csv")
    return df, profile.profile(df, "golden", "csv", path.stat().st_size)


def test_types(golden):
    kinds = dict(golden[0].dtypes)
    assert kinds["age_years"] == "bigint" and kinds["bmi"] == "double" and kinds["sex"] == "string"


def test_profile(golden):
    p = golden[1].dataset.first()
    assert (p.shape.rows, p.shape.columns) == (11, 25)
    assert p.pii_scan.direct_identifiers_detected is False and p.pii_scan.id_columns == ["id"]
    assert p.completeness.overall_pct == 97.09
    assert p.completeness.columns_below_90pct == p.completeness.columns_below_50pct == ["xpert_rif_resistance"]
    assert (p.duplicates.exact_duplicate_rows, p.duplicates.exact_duplicate_pct) == (0, 0.0)
    assert not any([p.standards_detected.icd_codes_present, p.standards_detected.snomed_codes_present, p.standards_detected.loinc_codes_present])
    assert p.label_columns.label_column == "treatment_outcome" and p.label_columns.binary_label_detected is False
    assert p.label_columns.imbalance_ratio == 8.0
    assert p.label_columns.class_distribution == {"not_applicable": 8, "cured": 2, "completed": 1}
    assert tuple(p.age_distribution) == (16.0, 53.0, 27.27, 72.73, 0.0)
    assert (p.schema_consistency.conformant_rows_pct, p.schema_consistency.schema_violations) == (100.0, 0)
    assert (p.split_columns.split_column_detected, p.split_columns.fold_column_detected) == (False, False)


def test_columns(golden):
    rows = {r["name"]: r for r in golden[1].columns.collect()}
    assert len(rows) == 25
    assert rows["tb_type"]["value_counts"] == {"none": 8, "pulmonary": 2, "extrapulmonary": 1}
    assert rows["xpert_rif_resistance"]["missing_count"] == 8
    assert rows["age_years"]["median"] == 39.0 and rows["age_years"]["range_violation"] is False


def test_assessment(spark, golden):
    form = spark.createDataFrame([("golden", *FORM.values())], "dataset_id string, dataset_name string, dataset_version string, dataset_type string, "
        "study_type string, target_population string, geographic_coverage string, age_range_min int, age_range_max int, sex_distribution string, "
        "num_sites int, collection_start_date date, collection_end_date date, standards_used string, ethics_approval_ref string, consent_type string, "
        "deidentification_method string, sensitivity_class string, license_type string, synthetic_data_pct double, access_control_method string, "
        "version_format string, dua_required boolean, location_granularity string, temporal_granularity string, dq_checks_applied array<string>")
    done = assess.assess(assess.combine(form, profile.facts_of(golden[1].dataset))).first()
    assert [done[dom.score_name(n)] for n in range(1, 16)] == SCORES
    assert (done.total_score, done.max_possible, done.cqi, done.cqi_band) == (32, 56, 57.1, "Silver")
    assert done.cqi_trace == "(32 / 56) × 100 = 57.1"
    assert (done.baseline_risk, done.sensitivity_multiplier, done.adjusted_risk, done.prs, done.prs_band) == (15.0, 1.5, 22.5, 23, "Moderate")
    assert (done.release_class, done.policy_override_applied) == ("Controlled", True)
    assert done.prs_trace == "baseline=15.0 (district_or_month) × multiplier=1.5 (high_stigma) = 22.5 → PRS=23"
    by = {s.domain_number: s for s in done.domain_scores}
    assert len(by[2].evidence_items) == 10 and by[5].confidence == "High" and by[11].not_applicable and by[11].confidence is None
    assert by[9].evidence_items[0] == "Temporal data collection span documented (2024-01-01 to 2024-12-31)."
    assert by[6].evidence_items[1] == "Dataset profile dimensions verified (11 rows, 25 cols)."


def test_two_row_table(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("name,age,sex\nAlice,30,F\nBob,40,M")
    p = profile.profile(readers.read_csv(spark, str(path)), "t", "csv", 32)
    form = spark.createDataFrame([("t", "Test pipeline run", "standard", "district", False, False)], "dataset_id string, dataset_name string, "
                                 "sensitivity_class string, location_granularity string, rare_condition_flag boolean, differential_privacy_applied boolean")
    done = assess.assess(assess.combine(form, profile.facts_of(p.dataset)), texts=False).first()
    assert [done[dom.score_name(n)] for n in range(1, 16)] == [1, 1, 1, 1, 3, 2, 1, 1, 1, 1, None, 1, 3, 3, 1]
    assert (done.cqi_band, done.prs_band, done.release_class) == ("Bronze", "High", "Restricted")
