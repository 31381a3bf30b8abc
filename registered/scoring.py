"""Domain scores, composite index, privacy risk and release class over the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayframe.functions import fixed
from assayframe.operators import composite
from assayframe.operators import domains as dom
from assayframe.plans import assess as plan
from assayframe.plans import criteria as crit
from registered.fixtures import cte, view

QUERIES = {}
ORACLE = {}

WHAT_IF_SETS = {
    "default": {},
    "strict": {"irr_adequate": 0.7, "irr_exemplary": 0.9, "tier3": 95.0, "multi_site_min": 4, "completeness_pct": 95.0,
               "k_anonymity_min": 10, "gold_min": 80.0, "open_cqi_min": 80.0, "low_max": 10},
    "lenient": {"irr_adequate": 0.4, "tier1": 20.0, "tier2": 40.0, "tier3": 70.0, "completeness_pct": 80.0,
                "k_anonymity_min": 3, "multiplier_critical": 1.5, "moderate_max": 50, "open_cqi_min": 60.0},
}


# ---- SQL text helpers (checking engine) ------------------------------------------------

def _clean(c: str) -> str:
    return rf"nullif(regexp_replace(CAST({c} AS VARCHAR), '^\s+|\s+$', '', 'g'), '')"


def _flag(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'None' WHEN {c} THEN 'True' ELSE 'False' END"


def _has_word(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_ACCESS = f"coalesce(lower({_clean('access_control_method')}), '')"
_PUBLIC = _has_word(_ACCESS, ["public", "open"])
_ROLE = _has_word(_ACCESS, ["role", "rbac", "vpn", "secure", "identity", "authenticated", "institutional"])
_APPROVAL = _has_word(_ACCESS, ["request", "approval", "managed", "permission", "application", "committee"])
_STD = f"coalesce(lower({_clean('standards_used')}) NOT IN ('none', 'no standard applied', 'custom / internal coding system'), false)"
_CODES = "(icd_codes_present OR snomed_codes_present OR loinc_codes_present OR fhir_structure)"
_SITES = "coalesce(nullif(num_sites, 0), 1)"
_KEY_FIELDS = ["dataset_name", "dataset_version", "dataset_type", "study_type", "target_population",
               "geographic_coverage", "collection_start_date", "deidentification_method", "standards_used",
               "license_type"]
_FILLED = "(" + " + ".join(f"({_clean(k)} IS NOT NULL)::INT" for k in _KEY_FIELDS) + ")"
_ANN = "(num_annotators IS NOT NULL AND num_annotators <> 0 AND num_annotators >= {min_annotators})"
_DOCS = (f"(coalesce(data_dictionary_uploaded, false)::INT + ({_clean('ethics_approval_ref')} IS NOT NULL)::INT"
         f" + ({_clean('consent_type')} IS NOT NULL)::INT + ({_clean('github_repo_url')} IS NOT NULL)::INT)")
_BOTH = f"({_clean('ethics_approval_ref')} IS NOT NULL AND {_clean('consent_type')} IS NOT NULL)"
_SOCIAL = "(equity_analysis_performed OR community_engagement)"
_SYN = "(synthetic_data_pct IS NOT NULL AND synthetic_data_pct <> 0)"
_REPO = f"({_clean('github_repo_url')} IS NOT NULL)"
_VER = f"({_clean('version_format')} IS NOT NULL)"

# Score rules; {name} is a threshold.
SCORES = {
    1: f"""CASE WHEN coalesce(annotation_methodology, '') = '' THEN 1 ELSE least(
        CASE WHEN irr_value IS NULL THEN 1 WHEN irr_value < {{irr_adequate}} THEN 2 WHEN irr_value < {{irr_exemplary}} THEN 3 ELSE 4 END,
        CASE WHEN {_ANN} THEN 4 ELSE 2 END, CASE WHEN coalesce(annotator_qualifications, '') <> '' THEN 4 ELSE 3 END) END""",
    2: f"""CASE WHEN {_FILLED} / 10.0 * 100 < {{tier1}} THEN 1 WHEN {_FILLED} / 10.0 * 100 < {{tier2}} THEN 2
        WHEN {_FILLED} / 10.0 * 100 < {{tier3}} THEN 3 ELSE 4 END""",
    3: f"greatest(1, {_DOCS})",
    4: f"""CASE WHEN geographic_coverage IS NULL THEN 1
        WHEN geographic_coverage = 'national' AND {_SITES} >= {{multi_site_min}} AND sex_distribution IS NOT NULL THEN 4
        WHEN geographic_coverage IN ('state', 'region') AND {_SITES} >= {{multi_site_min}} THEN 3
        WHEN geographic_coverage IN ('district', 'taluk', 'village') OR {_SITES} > 1 THEN 2 ELSE 1 END""",
    5: f"""CASE WHEN overall_completeness_pct < {{completeness_floor}} THEN 1
        WHEN overall_completeness_pct < {{completeness_pct}} - 15 THEN 1
        WHEN overall_completeness_pct < {{completeness_pct}} THEN 2 WHEN {_CODES} OR {_STD} THEN 4 ELSE 3 END""",
    6: """CASE WHEN file_format NOT IN ('csv', 'parquet', 'json', 'xlsx') THEN 1 WHEN NOT data_dictionary_uploaded THEN 2
        WHEN NOT provenance_pipeline_available THEN 3 WHEN imbalance_ratio > {imbalance_ratio_ok} THEN 3 ELSE 4 END""",
    7: """CASE WHEN direct_identifiers_detected THEN 1 WHEN deidentification_method IS NULL THEN 1
        WHEN differential_privacy_applied THEN 4 WHEN k_anonymity_value >= {k_anonymity_min} * 2 THEN 4
        WHEN k_anonymity_value >= {k_anonymity_min} THEN 3 ELSE 2 END""",
    8: f"""CASE WHEN {_clean('access_control_method')} IS NULL THEN 1 WHEN {_PUBLIC} THEN 2
        WHEN dua_required AND {_ROLE} THEN 4 WHEN dua_required OR {_APPROVAL} OR {_ROLE} THEN 3 ELSE 2 END""",
    9: f"""CASE WHEN NOT provenance_pipeline_available AND NOT changelog_provided AND NOT {_VER} THEN 1
        WHEN {_VER} AND NOT provenance_pipeline_available THEN 2
        WHEN provenance_pipeline_available AND NOT changelog_provided THEN 3 ELSE 4 END""",
    10: f"""CASE WHEN NOT {_BOTH} THEN 1 WHEN NOT {_SOCIAL} THEN 2 WHEN redressal_mechanism_exists THEN 4 ELSE 3 END""",
    11: f"""CASE WHEN NOT {_SYN} THEN NULL WHEN synthetic_utility_evaluated AND synthetic_privacy_tested
        THEN CASE WHEN synthetic_data_pct >= {{majority_synthetic_pct}} THEN 4 ELSE 3 END
        WHEN synthetic_utility_evaluated THEN 2 ELSE 1 END""",
    12: """CASE WHEN NOT named_steward_exists THEN 1 WHEN dpdp_compliance_status = 'fully_compliant' THEN 4
        WHEN dpdp_compliance_status = 'partially_compliant' THEN 3 ELSE 2 END""",
    13: "CASE WHEN num_linked_models = 0 THEN {neutral_score_when_no_models} WHEN least(num_linked_models, 3) > 1 THEN 4 ELSE 3 END",
    14: """CASE WHEN sustainability_info_provided THEN 4 WHEN file_format = 'parquet' THEN 3
        WHEN size_bytes < {max_file_size_bytes} THEN 3 ELSE 2 END""",
    15: f"""CASE WHEN NOT {_REPO} AND NOT changelog_provided THEN 1 WHEN NOT changelog_provided THEN 2
        WHEN NOT {_REPO} THEN 3 ELSE 4 END""",
}

CONFIDENCE = {5: "'High'", 6: "'Medium'", 14: "'Medium'",
              7: "CASE WHEN direct_identifiers_detected THEN 'High' ELSE 'Medium' END",
              11: f"CASE WHEN {_SYN} THEN 'Low' END"}


def _case(*pairs: tuple[str, str], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {other} END"


_MODELS = "'[''' || array_to_string(list_transform(range(1, num_linked_models + 1), lambda x: 'model-' || x), ''', ''') || ''']'"
_NULLS = "geographic_coverage IS NULL"
_FULL6 = "file_format IN ('csv', 'parquet', 'json', 'xlsx') AND data_dictionary_uploaded AND provenance_pipeline_available"
_MET = "coalesce(annotation_methodology, '') <> ''"
_GOOD5 = "overall_completeness_pct >= 90"
_S = "'Score ' || score || ': "

# (rationale, evidence items, gap items) with default thresholds; `score` is the computed score.
TEXTS = {
    1: (f"CASE WHEN NOT {_MET} THEN 'Annotation methodology not documented.' ELSE {_S}Annotation documented, IRR is ' || CASE WHEN irr_value IS NULL OR irr_value = 0 THEN 'absent' ELSE irr_value::VARCHAR END || '.' END",
        [_case((_MET, "'Annotation methodology documented.'")),
         _case((f"{_MET} AND irr_value IS NOT NULL", "'IRR value reported: ' || irr_value || ' using method ' || coalesce(nullif(irr_method, ''), 'unknown')")),
         _case((f"{_MET} AND irr_value >= 0.6 AND irr_value < 0.8", "'IRR value is adequate (>=0.6).'")),
         _case((f"{_MET} AND irr_value >= 0.8", "'IRR value is exemplary (>=0.8).'")),
         _case((f"{_MET} AND num_annotators >= 2", "'Multi-annotator team: ' || num_annotators || ' annotators.'")),
         _case((f"{_MET} AND annotator_qualifications IS NOT NULL", "'Annotator qualifications documented: ' || annotator_qualifications"))],
        [_case((f"NOT {_MET}", "'No annotation methodology documented.'")),
         _case((f"{_MET} AND irr_value IS NULL", "'No Inter-Rater Reliability (IRR) value reported.'")),
         _case((f"{_MET} AND irr_value < 0.6", "'IRR value below acceptable threshold (<0.6).'")),
         _case((f"{_MET} AND NOT coalesce(num_annotators >= 2, false)", "'Dataset was annotated by a single or unknown number of annotators.'")),
         _case((f"{_MET} AND annotator_qualifications IS NULL", "'Annotator credentials/qualifications not reported.'"))]),
    2: (f"{_S}' || {_FILLED} || ' out of 10 key metadata fields populated (' || round(CAST({_FILLED} * 10 AS DOUBLE), 1) || '%).'",
        [_case((f"{_clean(k)} IS NOT NULL", f"'Metadata field ''{k}'' is populated.'")) for k in _KEY_FIELDS],
        [_case((f"{_clean(k)} IS NULL", f"'Metadata field ''{k}'' is missing.'")) for k in _KEY_FIELDS]),
    3: (f"{_S}Found ' || {_DOCS} || ' of 4 core documentation components.'",
        [_case(("data_dictionary_uploaded", "'Data dictionary uploaded.'")),
         _case(("ethics_approval_ref IS NOT NULL", "'Ethics approval reference provided: ' || ethics_approval_ref")),
         _case(("consent_type IS NOT NULL", "'Consent type documented: ' || consent_type")),
         _case(("github_repo_url IS NOT NULL", "'Public code repository provided: ' || github_repo_url"))],
        [_case(("NOT data_dictionary_uploaded", "'Data dictionary missing.'")),
         _case(("ethics_approval_ref IS NULL", "'Ethics approval reference missing.'")),
         _case(("consent_type IS NULL", "'Consent protocol description missing.'")),
         _case(("github_repo_url IS NULL", "'Code repository URL missing.'"))]),
    4: (f"CASE WHEN {_NULLS} THEN 'Geographic coverage not declared. Minimum representativeness score.' ELSE {_S}Geographic coverage is ' || geographic_coverage || ' with ' || {_SITES} || ' sites.' END",
        [_case((f"NOT {_NULLS}", "'Geographic coverage declared: ' || geographic_coverage")),
         _case((f"NOT {_NULLS} AND {_SITES} > 1", f"'Multi-site study: ' || {_SITES} || ' sites.'")),
         _case((f"NOT {_NULLS} AND sex_distribution IS NOT NULL", "'Sex distribution reported: ' || sex_distribution")),
         _case((f"NOT {_NULLS} AND (age_range_min IS NOT NULL OR age_range_max IS NOT NULL)",
                "'Age demographic boundaries documented: ' || coalesce(age_range_min::VARCHAR, '0') || ' - ' || coalesce(age_range_max::VARCHAR, 'N/A') || ' years.'"))],
        [_case((_NULLS, "'Geographic coverage not declared.'")),
         _case((f"NOT {_NULLS} AND {_SITES} <= 1", "'Single site study or sites count not provided.'")),
         _case((f"NOT {_NULLS} AND sex_distribution IS NULL", "'Sex distribution not reported.'"))]),
    5: (f"{_S}Cell completeness is ' || overall_completeness_pct || '%.'",
        ["'Overall cell completeness: ' || overall_completeness_pct || '%'",
         _case((f"{_GOOD5} AND {_CODES}", "'Ontology standards (ICD/SNOMED/LOINC/FHIR) detected in data columns.'")),
         _case((f"{_GOOD5} AND {_STD}", "'Standard health coding framework declared in metadata: ' || standards_used"))],
        [_case(("overall_completeness_pct < 50", "'Extremely low data completeness (<50.0%).'"),
               ("overall_completeness_pct < 75", "'Low data completeness (<75.0%).'"),
               ("overall_completeness_pct < 90", "'Moderate data completeness (<90.0%).'"),
               (f"NOT ({_CODES} OR {_STD})", "'No medical coding standards detected in data or declared in metadata.'"))]),
    6: (f"{_S}Format is ' || file_format || ' with dictionary=' || {_flag('data_dictionary_uploaded')} || '.'",
        ["'File format is ' || file_format || '.'",
         _case(("len(dq_checks_applied) > 0", "'Automated data quality checks documented: ' || array_to_string(dq_checks_applied, ', ') || '.'")),
         _case((f"{_FULL6} AND NOT coalesce(imbalance_ratio > 3, false)", "'Data dictionary and pipeline script present. Class balance within target (3.0).'"))],
        [_case(("file_format NOT IN ('csv', 'parquet', 'json', 'xlsx')", "'Proprietary or unoptimized file format.'"),
               ("NOT data_dictionary_uploaded", "'Data dictionary not uploaded.'"),
               ("NOT provenance_pipeline_available", "'Data preprocessing pipeline script not linked.'"),
               ("imbalance_ratio > 3", "'Severe class imbalance detected (' || imbalance_ratio || ' > 3.0).'"))]),
    7: (f"CASE WHEN direct_identifiers_detected THEN 'Direct PII identifiers found in dataset.' ELSE {_S}Direct identifiers absent. De-identification is ' || coalesce(deidentification_method, 'absent') || '.' END",
        [_case(("NOT direct_identifiers_detected", "'No direct identifiers found in dataset.'")),
         _case(("NOT direct_identifiers_detected AND len(direct_identifiers_present) > 0",
                "'Declared direct identifiers in metadata: ' || array_to_string(direct_identifiers_present, ', ') || '.'")),
         _case(("direct_identifiers_detected OR deidentification_method IS NULL", "NULL"),
               ("differential_privacy_applied", "'Differential Privacy applied.'"),
               ("k_anonymity_value >= 10", "'k-anonymity verified with k=' || k_anonymity_value || ' (>= 10).'"),
               ("k_anonymity_value >= 5", "'k-anonymity verified with k=' || k_anonymity_value || ' (>= 5).'"),
               other="'De-identification applied: ' || deidentification_method")],
        [_case(("direct_identifiers_detected", "'Direct identifiers (name, phone, GPS or ID) detected in column headers.'"),
               ("deidentification_method IS NULL", "'No de-identification method declared.'"))]),
    8: (f"{_S}Access control is ' || coalesce({_clean('access_control_method')}, 'absent') || '.'",
        [_case((f"{_clean('access_control_method')} IS NULL", "NULL"),
               (_PUBLIC, "'Public / open access control documented.'"),
               (f"dua_required AND {_ROLE}", "'Role-based / authenticated access control with Data Use Agreement (DUA) enforced.'"),
               (f"dua_required AND {_APPROVAL}", "'Approval-based access with Data Use Agreement (DUA) requirement documented.'"),
               (f"dua_required OR {_ROLE} OR {_APPROVAL}", "'Controlled access governance documented: ' || access_control_method"),
               other="'Access control documented: ' || access_control_method")],
        [_case((f"{_clean('access_control_method')} IS NULL", "'No access control method documented.'"))]),
    9: (f"{_S}Pipeline=' || {_flag('provenance_pipeline_available')} || ', Changelog=' || {_flag('changelog_provided')} || '.'",
        [_case(("collection_start_date IS NOT NULL OR collection_end_date IS NOT NULL",
                "'Temporal data collection span documented (' || coalesce(collection_start_date::VARCHAR, 'N/A') || ' to ' || coalesce(collection_end_date::VARCHAR, 'N/A') || ').'")),
         _case((f"{_clean('temporal_granularity')} IS NOT NULL", f"'Temporal resolution documented: ' || {_clean('temporal_granularity')} || '.'")),
         _case(("score = 1", "NULL"), ("score = 2", "'Version format defined: ' || version_format"),
               ("score = 3", "'Preprocessing data lineage pipeline documented.'"),
               other="'Workflow pipeline, version history, and changelog fully available.'")],
        [_case(("score = 1", "'No provenance metadata provided.'"))]),
    10: (f"{_S}Ethics approval=' || CASE WHEN ethics_approval_ref IS NULL THEN 'False' ELSE 'True' END || ', Consent=' || coalesce(consent_type, 'None') || '.'",
         [_case(("ethics_approval_ref IS NOT NULL", "'Ethics approval reference: ' || ethics_approval_ref")),
          _case((_BOTH, "'Consent type: ' || consent_type")),
          _case((f"{_BOTH} AND {_SOCIAL}", f"'Social accountability (equity=' || {_flag('equity_analysis_performed')} || ', community=' || {_flag('community_engagement')} || ') performed.'")),
          _case((f"{_BOTH} AND {_SOCIAL} AND redressal_mechanism_exists", "'Grievance redressal mechanism exists.'"))],
         [_case(("ethics_approval_ref IS NULL AND consent_type IS NULL", "'Ethics approval reference and consent protocol missing.'"),
                ("ethics_approval_ref IS NOT NULL AND consent_type IS NULL", "'Consent protocol not described.'"),
                (f"{_BOTH} AND NOT {_SOCIAL}", "'No equity analysis or community engagement reported.'"))]),
    11: (f"CASE WHEN NOT {_SYN} THEN 'Dataset contains no synthetic or simulated data. Domain excluded from CQI calculation.' ELSE {_S}Synthetic pct=' || synthetic_data_pct || '%, utility=' || {_flag('synthetic_utility_evaluated')} || ', privacy=' || {_flag('synthetic_privacy_tested')} || '.' END",
         [_case((_SYN, "'Synthetic data ratio: ' || synthetic_data_pct || '%'")),
          _case((f"{_SYN} AND synthetic_utility_evaluated AND NOT synthetic_privacy_tested", "'Synthetic utility evaluated.'"),
                (f"{_SYN} AND synthetic_utility_evaluated", "'Synthetic utility and privacy tested.'")),
          _case(("score = 4", "'Majority synthetic dataset (>=50.0%).'"))],
         [_case((f"{_SYN} AND NOT synthetic_utility_evaluated AND NOT synthetic_privacy_tested", "'Synthetic utility and privacy not evaluated.'"),
                ("score = 2", "'Synthetic privacy leakage not tested.'"))]),
    12: (f"{_S}steward=' || {_flag('named_steward_exists')} || ', DPDP=' || coalesce(dpdp_compliance_status, 'None') || '.'",
         [_case(("named_steward_exists", "'Named data steward designated.'")),
          _case(("score = 4", "'DPDP compliant status verified (fully compliant).'"), ("score = 3", "'DPDP compliance in progress (partially compliant).'"))],
         [_case(("score = 1", "'No named data steward or custodian designated.'"), ("score = 2", "'DPDP compliance status not verified or non-compliant.'"))]),
    13: (f"{_S}Model linkage is ' || CASE WHEN num_linked_models = 0 THEN 'absent' ELSE {_MODELS} END || '.'",
         [_case(("num_linked_models = 0", "'No models linked to this dataset (neutral rating applied).'"), other=f"'Linked model IDs: ' || {_MODELS}"),
          _case(("num_linked_models > 1", "'Multiple models/configurations linked.'"))], ["NULL"]),
    14: (f"{_S}Sustainability assessed on size and file format.'",
         [_case(("sustainability_info_provided", "'Environmental sustainability documentation or energy usage information provided.'"),
                ("file_format = 'parquet'", "'Optimized binary column format (Parquet) reduces CPU cycles and storage size.'"),
                ("score = 3", "'Small file footprint (<10000000 bytes) reduces transmission and analysis carbon costs.'"))],
         [_case(("score = 2", "'Large raw text file (CSV/XLSX) increases storage and compute footprint.'"))]),
    15: (f"{_S}Repo=' || CASE WHEN {_REPO} THEN 'True' ELSE 'False' END || ', Changelog=' || {_flag('changelog_provided')} || '.'",
         [_case(("feedback_mechanism_exists", "'User feedback collection & continuous curation mechanism active.'")),
          _case(("score = 1", "NULL"), ("score = 2", "'Active code/data repository: ' || github_repo_url"),
                ("score = 3", "'Changelog/updates documentation provided.'"),
                other="'Active repository and detailed changelog provided.'")],
         [_case(("score = 1", "'No active repository or version changelog provided.'"))]),
}


def score_sql(number: int, over: dict | None = None) -> str:
    return SCORES[number].format(**crit.typed(over))


def _domain_sql(number: int) -> str:
    why, evidence, gaps = TEXTS[number]
    return cte("fx_catalog") + f""", scored AS (SELECT *, CAST({score_sql(number)} AS INT) AS score FROM fx_catalog)
SELECT dataset_id, score, {CONFIDENCE.get(number, "'Low'")} AS confidence, {why} AS rationale,
  concat_ws(' | ', {', '.join(evidence)}) AS evidence, concat_ws(' | ', {', '.join(gaps)}) AS gap_text
FROM scored"""


def _domain_query(number: int):
    def run(spark, sf_dir):
        rows = dom.one_domain(view(spark, sf_dir, "fx_catalog"), number)
        return rows.select("dataset_id", "score", "confidence", "rationale",
                           F.array_join("evidence_items", " | ").alias("evidence"),
                           F.array_join("gaps", " | ").alias("gap_text"))
    return run


for _n in SCORES:
    QUERIES[f"domain_{_n:02d}"] = _domain_query(_n)
    ORACLE[f"domain_{_n:02d}"] = _domain_sql(_n)


def scored_sql(over: dict | None = None, source: str = "fx_catalog") -> str:
    """SELECT adding d01..d15 to the catalog."""
    cols = ", ".join(f"CAST({score_sql(n, over)} AS INT) AS d{n:02d}" for n in SCORES)
    return f"SELECT *, {cols} FROM {source}"


_TOTAL = "CAST(" + " + ".join(f"coalesce(d{n:02d}, 0)" for n in SCORES) + " AS INT)"
_MOST = "CAST((" + " + ".join(f"(d{n:02d} IS NOT NULL)::INT" for n in SCORES) + ") * 4 AS INT)"


def _cqi_sql(source: str, over: dict | None = None) -> str:
    c = crit.typed(over)
    return f"""SELECT *, CASE WHEN cqi >= {c['diamond_min']} THEN 'Diamond' WHEN cqi >= {c['platinum_min']} THEN 'Platinum'
    WHEN cqi >= {c['gold_min']} THEN 'Gold' WHEN cqi >= {c['silver_min']} THEN 'Silver' WHEN cqi >= {c['bronze_min']} THEN 'Bronze' ELSE 'Remediation' END AS cqi_band,
    '(' || total_score || ' / ' || max_possible || ') × 100 = ' || cqi AS cqi_trace
  FROM (SELECT *, round(CAST(total_score AS DOUBLE) / max_possible * 100, 1) AS cqi
        FROM (SELECT *, {_TOTAL} AS total_score, {_MOST} AS max_possible FROM {source}))"""


def _prs_sql(source: str, over: dict | None = None, noised: str = "20.0") -> str:
    c = crit.typed(over)
    return f"""SELECT *, CASE WHEN prs > {c['high_max']} THEN 'Very High' WHEN prs > {c['moderate_max']} THEN 'High' WHEN prs > {c['low_max']} THEN 'Moderate' ELSE 'Low' END AS prs_band,
    'baseline=' || baseline_risk || ' (' || risk_basis || ') × multiplier=' || sensitivity_multiplier || ' (' || sensitivity_class || ') = ' || adjusted_risk || ' → PRS=' || prs AS prs_trace
  FROM (SELECT *, CAST(least(100, floor(adjusted_risk + 0.5)) AS INT) AS prs
    FROM (SELECT *, baseline_risk * sensitivity_multiplier AS adjusted_risk
      FROM (SELECT *, CAST(CASE WHEN direct_identifiers_detected THEN 50 WHEN differential_privacy_applied THEN {noised}
              WHEN location_granularity = 'village' AND rare_condition_flag THEN 30 WHEN location_granularity IN ('district', 'taluk') THEN 15
              WHEN location_granularity IN ('state', 'region', 'national') THEN 5 ELSE 15 END AS DOUBLE) AS baseline_risk,
            CASE WHEN direct_identifiers_detected THEN 'direct_identifiers_present' WHEN differential_privacy_applied THEN 'differential_privacy_applied'
              WHEN location_granularity = 'village' AND rare_condition_flag THEN 'village_rare_condition' WHEN location_granularity IN ('district', 'taluk') THEN 'district_or_month'
              WHEN location_granularity IN ('state', 'region', 'national') THEN 'state_or_region' ELSE 'default_moderate' END AS risk_basis,
            CAST(CASE sensitivity_class WHEN 'standard' THEN {c['multiplier_standard']} WHEN 'high_stigma' THEN {c['multiplier_high_stigma']}
              WHEN 'critical' THEN {c['multiplier_critical']} ELSE 1.0 END AS DOUBLE) AS sensitivity_multiplier FROM {source})))"""


def _release_sql(source: str, over: dict | None = None) -> str:
    c = crit.typed(over)
    guard = "sensitivity_class IN ('high_stigma', 'critical')"
    risky = "prs_band IN ('High', 'Very High')"
    open_ = f"cqi >= {c['open_cqi_min']} AND prs_band = '{c['open_prs_band']}'"
    return f"""SELECT *,
    CASE WHEN {guard} AND {risky} THEN 'Restricted' WHEN {guard} AND NOT dp_verified THEN 'Controlled' WHEN {open_} THEN 'Open'
      WHEN cqi >= 70 AND prs_band = 'Moderate' THEN 'Controlled' WHEN {risky} THEN 'Restricted'
      WHEN cqi < 50 AND prs_band <> 'Low' THEN 'Restricted' ELSE 'Controlled' END AS release_class,
    CASE WHEN {guard} AND {risky} THEN 'High-stigma data with ' || prs_band || ' PRS. Restricted per {c['policy_name']} policy.'
      WHEN {guard} AND NOT dp_verified THEN 'High-stigma data defaults to Controlled unless Differential Privacy is independently verified.'
      WHEN {open_} THEN 'CQI=' || cqi || ' (>={c['open_cqi_min']}) and PRS=' || prs || ' ({c['open_prs_band']}). Open access permitted.'
      WHEN cqi >= 70 AND prs_band = 'Moderate' THEN 'CQI=' || cqi || ' (>=70) but PRS=' || prs || ' (Moderate). Controlled access required.'
      WHEN {risky} THEN 'PRS=' || prs || ' (' || prs_band || '). Restricted regardless of CQI.'
      WHEN cqi < 50 AND prs_band = 'Low' THEN 'CQI=' || cqi || ' (<50). Controlled until quality improved.'
      WHEN cqi < 50 THEN 'CQI=' || cqi || ' (<50) and PRS=' || prs || ' (' || prs_band || '). Restricted.'
      ELSE 'CQI=' || cqi || ' (Silver/Gold band). Controlled access.' END AS release_justification,
    ({guard} AND ({risky} OR NOT dp_verified)) AS policy_override_applied
  FROM (SELECT *, differential_privacy_applied AND d07 = 4 AS dp_verified FROM {source})"""


def assessed_ctes(over: dict | None = None, tag: str = "") -> str:
    """CTE chain ending in `assessed{tag}`; needs fx_catalog."""
    return (f", scored{tag} AS ({scored_sql(over)}), with_cqi{tag} AS ({_cqi_sql('scored' + tag, over)})"
            f", with_prs{tag} AS ({_prs_sql('with_cqi' + tag, over)}), assessed{tag} AS ({_release_sql('with_prs' + tag, over)})")


def catalog(spark, sf_dir):
    return view(spark, sf_dir, "fx_catalog")


def q_domain_scores_long(spark, sf_dir):
    done = plan.assess(catalog(spark, sf_dir))
    return dom.long_scores(done).select("dataset_id", "domain_number", "domain_name", "score", "max_score",
                                        "not_applicable", "confidence", F.size("evidence_items").alias("n_evidence"),
                                        F.size("gaps").alias("n_gaps"))


def _long_sql() -> str:
    parts = []
    for n, (_, evidence, gaps) in TEXTS.items():
        conf = "'Low'" if n == 11 else CONFIDENCE.get(n, "'Low'")
        name = dict((a, b) for a, b, _ in fixed.DOMAINS)[n]
        count = " + ".join(f"(({e}) IS NOT NULL)::INT" for e in evidence)
        lacks = " + ".join(f"(({g}) IS NOT NULL)::INT" for g in gaps)
        na = f"NOT {_SYN}" if n == 11 else "false"
        parts.append(f"SELECT dataset_id, {n} AS domain_number, '{name}' AS domain_name, score, CASE WHEN {na} THEN NULL ELSE 4 END AS max_score, "
                     f"{na} AS not_applicable, {conf} AS confidence, CAST({count} AS INT) AS n_evidence, CAST({lacks} AS INT) AS n_gaps "
                     f"FROM (SELECT *, CAST({score_sql(n)} AS INT) AS score FROM fx_catalog)")
    return cte("fx_catalog") + "\nUNION ALL ".join(parts)


QUERIES["domain_scores_long"] = q_domain_scores_long
ORACLE["domain_scores_long"] = _long_sql()

_CQI_COLS = ["dataset_id", "total_score", "max_possible", "cqi", "cqi_band", "cqi_trace"]
_PRS_COLS = ["dataset_id", "baseline_risk", "risk_basis", "sensitivity_multiplier", "adjusted_risk", "prs", "prs_band", "prs_trace"]
_REL_COLS = ["dataset_id", "cqi", "prs", "prs_band", "dp_verified", "release_class", "release_justification", "policy_override_applied"]

QUERIES["cqi"] = lambda s, d: composite.with_cqi(dom.with_scores(catalog(s, d))).select(*_CQI_COLS)
ORACLE["cqi"] = cte("fx_catalog") + f", scored AS ({scored_sql()}) SELECT {', '.join(_CQI_COLS)} FROM ({_cqi_sql('scored')})"

QUERIES["cqi_from_scores"] = lambda s, d: composite.cqi_from_long(
    dom.score_rows(dom.with_scores(catalog(s, d))))
ORACLE["cqi_from_scores"] = (cte("fx_catalog") + f", scored AS ({scored_sql()}) SELECT dataset_id, total_score, max_possible, cqi, cqi_band "
                             f"FROM ({_cqi_sql('scored')})")

QUERIES["prs"] = lambda s, d: composite.with_prs(catalog(s, d)).select(*_PRS_COLS)
ORACLE["prs"] = cte("fx_catalog") + f"SELECT {', '.join(_PRS_COLS)} FROM ({_prs_sql('fx_catalog')})"

QUERIES["dp_baseline"] = lambda s, d: composite.with_prs(
    catalog(s, d).withColumn("dp_epsilon", F.expr("CAST(dataset_id % 83 AS DOUBLE) / 10")), epsilon="dp_epsilon"
).select(*_PRS_COLS, "dp_epsilon")
ORACLE["dp_baseline"] = (cte("fx_catalog") + ", e AS (SELECT *, CAST(dataset_id % 83 AS DOUBLE) / 10 AS dp_epsilon FROM fx_catalog) "
                         f"SELECT {', '.join(_PRS_COLS)}, dp_epsilon FROM ("
                         + _prs_sql("e", noised="CASE WHEN dp_epsilon > 0 THEN least(100.0, dp_epsilon * 20) ELSE 20.0 END") + ")")

QUERIES["release"] = lambda s, d: plan.assess(catalog(s, d), texts=False).select(*_REL_COLS)
ORACLE["release"] = cte("fx_catalog") + assessed_ctes() + f" SELECT {', '.join(_REL_COLS)} FROM assessed"

_ASSESS_COLS = ["dataset_id"] + [f"d{n:02d}" for n in SCORES] + plan.RESULT_COLUMNS


def q_assess(spark, sf_dir):
    return plan.assess(catalog(spark, sf_dir), texts=False).select(*_ASSESS_COLS)


QUERIES["assess"] = q_assess
ORACLE["assess"] = cte("fx_catalog") + assessed_ctes() + f" SELECT {', '.join(_ASSESS_COLS)} FROM assessed"

_WHAT_COLS = ["criteria_id", "dataset_id", "total_score", "max_possible", "cqi", "cqi_band", "prs", "prs_band", "release_class",
              "policy_override_applied"]
QUERIES["what_if_criteria"] = lambda s, d: plan.what_if(catalog(s, d), WHAT_IF_SETS, texts=False).select(*_WHAT_COLS)
ORACLE["what_if_criteria"] = (
    cte("fx_catalog") + "".join(assessed_ctes(over, f"_{name}") for name, over in WHAT_IF_SETS.items()) + " "
    + " UNION ALL ".join(f"SELECT '{n}' AS criteria_id, {', '.join(_WHAT_COLS[1:])} FROM assessed_{n}" for n in WHAT_IF_SETS))


def _custom_domain() -> dom.Domain:
    """A scorer added by a user: licence openness."""
    def score(f):
        text = F.lower(f.text("license_type"))
        return F.when(text.isNull(), 1).when(text.contains("nc"), 3).otherwise(4)

    def explain(f, s):
        stated = f.text("license_type")
        return dom.Explanation(F.concat(F.lit("Score "), s.cast("string"), F.lit(": licence.")),
                               [F.concat(F.lit("Licence: "), stated)], [F.when(stated.isNull(), "No licence stated.")])

    return dom.Domain(16, "Licence Openness", score, explain, lambda f: F.lit("Low"))


def q_custom_domain(spark, sf_dir):
    domains = dom.register(_custom_domain())
    done = plan.assess(catalog(spark, sf_dir), domains=domains, texts=False)
    return done.select("dataset_id", "d16", "total_score", "max_possible", "cqi")


QUERIES["custom_domain"] = q_custom_domain
ORACLE["custom_domain"] = (cte("fx_catalog") + f", scored AS ({scored_sql()}), sixteen AS (SELECT *, CASE WHEN license_type IS NULL THEN 1 WHEN contains(lower(license_type), 'nc') THEN 3 ELSE 4 END AS d16 FROM scored) "
                           f"SELECT dataset_id, d16, CAST({_TOTAL} + d16 AS INT) AS total_score, CAST({_MOST} + 4 AS INT) AS max_possible, "
                           f"round(CAST({_TOTAL} + d16 AS DOUBLE) / ({_MOST} + 4) * 100, 1) AS cqi FROM sixteen")
