"""Schemas of the questionnaire record and of the stored relations."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: questionnaire fields -------------------------------------------------
# `registry_dataset_id` is the id the dataset carries in an outside registry; pass
# `rename={"<their field>": "registry_dataset_id"}` to the form readers for another field name.
FORM_FIELDS = {
    "dataset_name": "string", "dataset_version": "string", "dataset_type": "string", "study_type": "string",
    "target_population": "string", "geographic_coverage": "string", "age_range_min": "int", "age_range_max": "int",
    "sex_distribution": "string", "num_sites": "int", "collection_start_date": "date", "collection_end_date": "date",
    "annotation_methodology": "string", "num_annotators": "int", "irr_method": "string", "irr_value": "double",
    "annotator_qualifications": "string", "dq_checks_applied": "array<string>", "standards_used": "string",
    "ethics_approval_ref": "string", "consent_type": "string", "deidentification_method": "string",
    "direct_identifiers_present": "array<string>", "k_anonymity_value": "int", "location_granularity": "string",
    "temporal_granularity": "string", "rare_condition_flag": "boolean", "differential_privacy_applied": "boolean",
    "sensitivity_class": "string", "persistent_identifier": "string", "license_type": "string",
    "synthetic_data_pct": "double", "synthetic_utility_evaluated": "boolean", "synthetic_privacy_tested": "boolean",
    "equity_analysis_performed": "boolean", "community_engagement": "boolean", "redressal_mechanism_exists": "boolean",
    "dua_required": "boolean", "named_steward_exists": "boolean", "dpdp_compliance_status": "string",
    "access_control_method": "string", "linked_model_ids": "array<string>", "data_dictionary_uploaded": "boolean",
    "provenance_pipeline_available": "boolean", "github_repo_url": "string", "changelog_provided": "boolean",
    "version_format": "string", "sustainability_info_provided": "boolean", "feedback_mechanism_exists": "boolean",
    "registry_dataset_id": "string", "webhook_url": "string",
}


def form_schema() -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in FORM_FIELDS.items()))


RESULT_SCHEMA = ("assessment_id string, cqi decimal(5,1), cqi_band string, total_domain_score int, max_possible_score int, "
                 "cqi_formula_trace string, prs int, prs_band string, prs_baseline_risk decimal(6,2), "
                 "prs_sensitivity_multiplier decimal(4,2), prs_computation_trace string, release_classification string, "
                 "classification_justification string, policy_override_applied boolean")
AUDIT_SCHEMA = ("log_id string, assessment_id string, event_type string, event_timestamp timestamp, component string, "
                "event_detail string, severity string")
