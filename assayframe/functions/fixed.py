"""Fixed values. They define the expected results, so they are stated as plain text."""

# --- fixed values: missing-value tokens of delimited text -------------------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TOKENS = ["true", "True", "TRUE"]
FALSE_TOKENS = ["false", "False", "FALSE"]

# --- fixed values: personal-data header families, in order of precedence ----------------
HEADER_FAMILIES = {
    "name": "name|patient_name|full_name|fname|lname|first_name|last_name|surname",
    "phone": "phone|mobile|contact|tel|telephone|cell",
    "id": "id|uid|uuid|national_id|aadhaar|ssn|passport|mrn|patient_id|subject_id",
    "gps": "lat|latitude|lon|longitude|gps|coordinates|geo",
    "dob": "dob|date_of_birth|birth_date|birthdate|birth_year",
}
DIRECT_FAMILIES = ["name", "phone", "gps", "dob"]

# --- fixed values: code patterns --------------------------------------------------------
CODE_PATTERNS = {
    "icd": r"^[A-Z]\d{2}(\.\d{1,4})?$",
    "snomed": r"^\d{6,18}$",
    "loinc": r"^\d{1,5}-\d$",
}

# --- fixed values: column-name keywords, in order of precedence -------------------------
SPLIT_NAMES = ["split", "partition", "set", "subset", "train_test", "data_split"]
FOLD_NAMES = ["fold", "cv_fold", "kfold", "cross_val"]
LABEL_NAMES = ["label", "target", "outcome", "diagnosis", "class", "y", "result",
               "treatment_outcome", "prediction"]
AGE_NAMES = ["age", "age_years", "patient_age", "age_at_enrollment"]

# --- fixed values: plausibility limits --------------------------------------------------
AGE_LIMITS = (0, 150)
BMI_LIMITS = (5, 100)
CATEGORY_LIMIT = 50
PROFILER_VERSION = "1.1.0"
SAMPLE_ROWS = 100000
SAMPLE_SEED = 42

# --- fixed values: uploads --------------------------------------------------------------
UPLOAD_EXTENSIONS = ["csv", "xlsx", "parquet", "json", "tsv", "zip", "pdf", "py", "r", "ipynb", "dcm"]

# --- fixed values: domains (number, name, slug) -----------------------------------------
DOMAINS = [
    (1, "Annotation / Labelling Reliability", "1_annotation_labelling_reliability"),
    (2, "Metadata Completeness", "2_metadata_completeness"),
    (3, "Documentation & User Guidance", "3_documentation_user_guidance"),
    (4, "Population Representativeness", "4_population_representativeness"),
    (5, "Data Structure & Interoperability", "5_data_structure_interoperability"),
    (6, "AI / Analytics Readiness", "6_ai_analytics_readiness"),
    (7, "Privacy & Identifiability", "7_privacy_identifiability"),
    (8, "Security & Access Governance", "8_security_access_governance"),
    (9, "Provenance & Workflow Transparency", "9_provenance_workflow_transparency"),
    (10, "Ethical & Social Accountability", "10_ethical_social_accountability"),
    (11, "Synthetic / Simulated Data", "11_synthetic_simulated_data"),
    (12, "Stewardship & Governance", "12_stewardship_governance"),
    (13, "Model Linkage Integrity", "13_model_linkage_integrity"),
    (14, "Environmental Sustainability", "14_environmental_sustainability"),
    (15, "Continuous Curation & Feedback", "15_continuous_curation_feedback"),
]

# --- fixed values: domain vocabulary ----------------------------------------------------
COMPLETENESS_FIELDS = [
    "dataset_name", "dataset_version", "dataset_type", "study_type", "target_population",
    "geographic_coverage", "collection_start_date", "deidentification_method", "standards_used",
    "license_type",
]
NO_STANDARD = ["none", "no standard applied", "custom / internal coding system"]
ANALYTIC_FORMATS = ["csv", "parquet", "json", "xlsx"]
PUBLIC_WORDS = ["public", "open"]
ROLE_WORDS = ["role", "rbac", "vpn", "secure", "identity", "authenticated", "institutional"]
APPROVAL_WORDS = ["request", "approval", "managed", "permission", "application", "committee"]

# --- fixed values: questionnaire enumerations -------------------------------------------
FORM_ENUMS = {
    "dataset_type": ["tabular", "imaging", "text", "multimodal"],
    "study_type": ["RCT", "cohort", "cross_sectional", "registry", "observational", "case_control", "other"],
    "geographic_coverage": ["village", "taluk", "district", "state", "national", "multi_country"],
    "sex_distribution": ["male_only", "female_only", "both", "not_specified"],
    "annotator_qualifications": ["clinician", "student", "crowdsourced", "automated", "mixed", "other"],
    "consent_type": ["individual", "waiver", "community", "not_applicable"],
    "location_granularity": ["village", "taluk", "district", "state", "national", "multi_country", "none"],
    "temporal_granularity": ["day", "month", "year", "not_applicable"],
    "sensitivity_class": ["standard", "high_stigma", "critical"],
    "dpdp_compliance_status": ["fully_compliant", "partially_compliant", "not_compliant", "not_applicable"],
    "version_format": ["semantic", "arbitrary", "none"],
}
FORM_REQUIRED = [
    "dataset_name", "dataset_type", "study_type", "target_population", "geographic_coverage",
    "standards_used", "deidentification_method", "sensitivity_class", "license_type",
    "access_control_method",
]
FORM_LENGTHS = {  # field: (least, most)
    "dataset_name": (5, None),
    "dataset_version": (None, 100),
    "target_population": (20, None),
    "annotation_methodology": (50, None),
}
FORM_RANGES = {  # field: (least, most)
    "age_range_min": (0, 120),
    "age_range_max": (0, 120),
    "num_sites": (1, None),
    "num_annotators": (1, None),
    "irr_value": (0, 1),
    "k_anonymity_value": (1, None),
    "synthetic_data_pct": (0, 100),
}
FORM_DEFAULTS = {
    "sex_distribution": "not_specified",
    "consent_type": "not_applicable",
    "rare_condition_flag": False,
    "differential_privacy_applied": False,
    "equity_analysis_performed": False,
    "community_engagement": False,
    "redressal_mechanism_exists": False,
    "dua_required": False,
    "named_steward_exists": False,
    "data_dictionary_uploaded": False,
    "provenance_pipeline_available": False,
    "changelog_provided": False,
    "version_format": "none",
    "sustainability_info_provided": False,
    "feedback_mechanism_exists": False,
}
FORM_EMPTY_LISTS = ["dq_checks_applied", "direct_identifiers_present", "linked_model_ids"]

# --- fixed values: lifecycle ------------------------------------------------------------
EVENT_STATES = {
    "assessment_submitted": "queued",
    "assessment_started": "processing",
    "assessment_complete": "complete",
    "assessment_failed": "failed",
}
ATTEMPT_LIMIT = 5
ATTEMPT_WINDOW_SECONDS = 60

# --- fixed values: value-level personal-data and format patterns (documented targets) ---
VALUE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?\d{1,3}[ -]?\(?\d{3}\)?[ -]?\d{3}[ -]?\d{4}",
    "national_id": r"\b(\d{4}[ -]\d{4}[ -]\d{4}|\d{3}-\d{2}-\d{4})\b",
}
FULL_DATE_PATTERN = r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})$"
FORMAT_PATTERNS = {
    "persistent_identifier": r"^(https?://(dx\.)?doi\.org/|doi:)?10\.\d{4,9}/\S+$|^[A-Z]{2,6}\d{5,12}$",
    "ethics_approval_ref": r"^[A-Za-z]{2,10}([/-][A-Za-z0-9]+)+$",
    "github_repo_url": r"^https://\S+$",
    "dataset_version": r"^\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$",
}
