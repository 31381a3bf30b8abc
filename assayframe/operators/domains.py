"""Fifteen ordinal domain scores as column expressions.

A `Domain` has two parts: `score(facts)`, a cheap integer expression, and
`explain(facts, score)`, the rationale, evidence and gap texts. Plans that only need the
numbers never build the texts. Everything is row-local: scoring a catalog is one map stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells, fixed
from assayframe.plans import criteria as crit


CLEAN = "_clean_"
JIT_LIMIT = 8000  # bytes of a method that the JVM still compiles
_CLEANED_FIELDS = [
    "dataset_name", "dataset_version", "dataset_type", "study_type", "target_population", "geographic_coverage",
    "sex_distribution", "deidentification_method", "standards_used", "license_type", "ethics_approval_ref",
    "consent_type", "github_repo_url", "access_control_method", "version_format", "temporal_granularity",
]


def compiled(df: DataFrame) -> DataFrame:
    """`df`, its session planning the scorers as split projections.

    Fused into one method they pass the 8000 bytes up to which the JVM compiles a method, and are interpreted. It is a
    setting of the session that plans the job; a smaller one is kept."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.codegen.hugeMethodLimit")) > JIT_LIMIT:
        conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))
    return df


def with_clean(df: DataFrame) -> DataFrame:
    """Trim each text field once, ahead of the scorers that read it several times."""
    df = compiled(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    todo = [n for n in _CLEANED_FIELDS if cells.is_text(types.get(n, T.NullType())) and CLEAN + n not in types]
    return df.select("*", *[cells.clean(F.col(n)).alias(CLEAN + n) for n in todo]) if todo else df


class Facts:
    """Columns of one row per dataset (metadata plus profile facts), with absent columns defaulted."""

    def __init__(self, df: DataFrame, limit: crit.Limit | None = None):
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.limit = limit or crit.literals()

    def has(self, name: str) -> bool:
        return name in self.types

    def raw(self, name: str, default=None) -> Column:
        return F.col(name) if self.has(name) else F.lit(default)

    def string(self, name: str) -> Column:
        return self.raw(name).cast("string")

    def text(self, name: str) -> Column:
        if self.has(CLEAN + name):
            return F.col(CLEAN + name)
        if cells.is_text(self.types.get(name, T.NullType())):
            return cells.clean(self.raw(name))
        return self.string(name)

    def stated(self, name: str) -> Column:
        """True when the field holds something other than white space."""
        if self.has(CLEAN + name):
            return F.col(CLEAN + name).isNotNull()
        if cells.is_text(self.types.get(name, T.NullType())):
            return cells.clean(self.raw(name)).isNotNull()
        return self.raw(name).isNotNull()

    def flag(self, name: str) -> Column:
        return cells.yes(self.raw(name, False))

    def printed_flag(self, name: str) -> Column:
        return cells.text_of_flag(self.raw(name, False))

    def number(self, name: str, kind: str = "double") -> Column:
        """Numeric value; text that is not a number reads as NULL here and is reported by `unreadable`."""
        if cells.is_text(self.types.get(name, T.NullType())):
            return F.trim(self.raw(name)).try_cast(kind)
        return self.raw(name).cast(kind)

    def unreadable(self, name: str, kind: str) -> Column | None:
        """Failure text for a non-empty string that is no number; None when the column is typed."""
        if not cells.is_text(self.types.get(name, T.NullType())):
            return None
        said = ("could not convert string to float: '" if kind == "double"
                else "invalid literal for int() with base 10: '")
        return F.when(cells.filled(self.raw(name)) & self.number(name, kind).isNull(),
                      F.concat(F.lit(said), self.raw(name), F.lit("'")))


@dataclass(frozen=True)
class Explanation:
    rationale: Column
    evidence: list[Column]
    gaps: list[Column]


@dataclass(frozen=True)
class Domain:
    """One scorer. Register another with `register` to add it to every plan."""

    number: int
    name: str
    score: Callable[[Facts], Column]
    explain: Callable[[Facts, Column], Explanation]
    confidence: Callable[[Facts], Column]
    # (field, kind) pairs whose text must parse; otherwise the domain falls back to 1.
    reads: tuple[tuple[str, str], ...] = ()
    not_applicable: Callable[[Facts], Column] | None = None


def _always(level: str) -> Callable[[Facts], Column]:
    return lambda f: F.lit(level)


def _headline(score: Column, *tail: Column | str) -> Column:
    parts = [F.lit(t) if isinstance(t, str) else t for t in tail]
    return F.concat(F.lit("Score "), score.cast("string"), F.lit(": "), *parts)


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _num(c: Column) -> Column:
    return cells.text_of_float(c)


# ---- 1 annotation ----------------------------------------------------------------------

def _annotated(f: Facts) -> Column:
    return cells.filled(f.string("annotation_methodology"))


def _annotators_ok(f: Facts) -> Column:
    n = f.number("num_annotators", "int")
    return F.coalesce((n != 0) & (n >= f.limit("min_annotators")), F.lit(False))


def _qualified(f: Facts) -> Column:
    return cells.filled(f.string("annotator_qualifications"))


def _annotation_score(f: Facts) -> Column:
    irr = f.number("irr_value")
    by_irr = (F.when(irr.isNull(), 1).when(irr < f.limit("irr_adequate"), 2)
              .when(irr < f.limit("irr_exemplary"), 3).otherwise(4))
    capped = F.when(_annotators_ok(f), by_irr).otherwise(F.least(by_irr, F.lit(2)))
    return (F.when(~_annotated(f), 1)
            .when(_qualified(f), capped).otherwise(F.least(capped, F.lit(3))))


def _annotation_explain(f: Facts, score: Column) -> Explanation:
    irr, on = f.number("irr_value"), _annotated(f)
    low, high = f.limit("irr_adequate"), f.limit("irr_exemplary")
    method = F.coalesce(F.nullif(f.string("irr_method"), F.lit("")), F.lit("unknown"))
    return Explanation(
        F.when(~on, "Annotation methodology not documented.").otherwise(_headline(
            score, "Annotation documented, IRR is ",
            F.when(irr.isNull() | (irr == 0), "absent").otherwise(_num(irr)), ".")),
        [
            F.when(on, "Annotation methodology documented."),
            F.when(on & irr.isNotNull(), _say("IRR value reported: ", _num(irr), " using method ", method)),
            F.when(on & (irr >= low) & (irr < high), _say("IRR value is adequate (>=", _num(low), ").")),
            F.when(on & (irr >= low) & (irr >= high), _say("IRR value is exemplary (>=", _num(high), ").")),
            F.when(on & _annotators_ok(f),
                   _say("Multi-annotator team: ", f.string("num_annotators"), " annotators.")),
            F.when(on & _qualified(f),
                   _say("Annotator qualifications documented: ", f.string("annotator_qualifications"))),
        ],
        [
            F.when(~on, "No annotation methodology documented."),
            F.when(on & irr.isNull(), "No Inter-Rater Reliability (IRR) value reported."),
            F.when(on & (irr < low), _say("IRR value below acceptable threshold (<", _num(low), ").")),
            F.when(on & ~_annotators_ok(f),
                   "Dataset was annotated by a single or unknown number of annotators."),
            F.when(on & ~_qualified(f), "Annotator credentials/qualifications not reported."),
        ],
    )


# ---- 2 metadata ------------------------------------------------------------------------

def _field_count(f: Facts) -> Column:
    total = F.lit(0)
    for name in fixed.COMPLETENESS_FIELDS:
        total = total + f.stated(name).cast("int")
    return total


def _field_pct(f: Facts) -> Column:
    return _field_count(f) / F.lit(len(fixed.COMPLETENESS_FIELDS)) * 100


def _metadata_score(f: Facts) -> Column:
    p = _field_pct(f)
    return (F.when(p < f.limit("tier1"), 1).when(p < f.limit("tier2"), 2)
            .when(p < f.limit("tier3"), 3).otherwise(4))


def _metadata_explain(f: Facts, score: Column) -> Explanation:
    here = {n: f.stated(n) for n in fixed.COMPLETENESS_FIELDS}
    return Explanation(
        _headline(score, _field_count(f).cast("string"), f" out of {len(here)} key metadata fields populated (",
                  _num(F.round(_field_pct(f), 1)), "%)."),
        [F.when(on, f"Metadata field '{n}' is populated.") for n, on in here.items()],
        [F.when(~on, f"Metadata field '{n}' is missing.") for n, on in here.items()],
    )


# ---- 3 documentation -------------------------------------------------------------------

def _documents(f: Facts) -> list[tuple[Column, Column | str, str]]:
    """(present, evidence, gap) for each documentation component."""
    return [
        (f.flag("data_dictionary_uploaded"), "Data dictionary uploaded.", "Data dictionary missing."),
        (f.stated("ethics_approval_ref"),
         _say("Ethics approval reference provided: ", f.string("ethics_approval_ref")),
         "Ethics approval reference missing."),
        (f.stated("consent_type"),
         _say("Consent type documented: ", f.string("consent_type")),
         "Consent protocol description missing."),
        (f.stated("github_repo_url"),
         _say("Public code repository provided: ", f.string("github_repo_url")),
         "Code repository URL missing."),
    ]


def _document_count(f: Facts) -> Column:
    total = F.lit(0)
    for present, _, _ in _documents(f):
        total = total + present.cast("int")
    return total


def _documentation_explain(f: Facts, score: Column) -> Explanation:
    items = _documents(f)
    return Explanation(
        _headline(score, "Found ", _document_count(f).cast("string"), " of 4 core documentation components."),
        [F.when(on, said) for on, said, _ in items],
        [F.when(~on, gap) for on, _, gap in items],
    )


# ---- 4 representativeness --------------------------------------------------------------

def _sites(f: Facts) -> Column:
    return F.coalesce(F.nullif(f.number("num_sites", "int"), F.lit(0)), F.lit(1))


def _representativeness_score(f: Facts) -> Column:
    geo, sites = f.text("geographic_coverage"), _sites(f)
    multi = sites >= f.limit("multi_site_min")
    return (F.when(geo.isNull(), 1)
            .when((geo == "national") & multi & f.stated("sex_distribution"), 4)
            .when(geo.isin("state", "region") & multi, 3)
            .when(geo.isin("district", "taluk", "village") | (sites > 1), 2).otherwise(1))


def _representativeness_explain(f: Facts, score: Column) -> Explanation:
    geo, sites, sex = f.text("geographic_coverage"), _sites(f), f.text("sex_distribution")
    youngest, oldest = f.string("age_range_min"), f.string("age_range_max")
    on = geo.isNotNull()
    return Explanation(
        F.when(~on, "Geographic coverage not declared. Minimum representativeness score.").otherwise(
            _headline(score, "Geographic coverage is ", geo, " with ", sites.cast("string"), " sites.")),
        [
            F.when(on, _say("Geographic coverage declared: ", geo)),
            F.when(on & (sites > 1), _say("Multi-site study: ", sites, " sites.")),
            F.when(on & sex.isNotNull(), _say("Sex distribution reported: ", sex)),
            F.when(on & (youngest.isNotNull() | oldest.isNotNull()),
                   _say("Age demographic boundaries documented: ", cells.text_or(youngest, "0"), " - ",
                        cells.text_or(oldest, "N/A"), " years.")),
        ],
        [
            F.when(~on, "Geographic coverage not declared."),
            F.when(on & ~(sites > 1), "Single site study or sites count not provided."),
            F.when(on & sex.isNull(), "Sex distribution not reported."),
        ],
    )


# ---- 5 interoperability ----------------------------------------------------------------

def _complete(f: Facts) -> Column:
    return F.coalesce(f.number("overall_completeness_pct"), F.lit(100.0))


def _codes_seen(f: Facts) -> Column:
    return (f.flag("icd_codes_present") | f.flag("snomed_codes_present")
            | f.flag("loinc_codes_present") | f.flag("fhir_structure"))


def _standard_declared(f: Facts) -> Column:
    std = f.text("standards_used")
    return F.coalesce(~F.lower(std).isin(fixed.NO_STANDARD), F.lit(False))


def _interoperability_score(f: Facts) -> Column:
    p, target = _complete(f), f.limit("completeness_pct")
    return (F.when(p < f.limit("completeness_floor"), 1).when(p < target - 15.0, 1).when(p < target, 2)
            .when(_codes_seen(f) | _standard_declared(f), 4).otherwise(3))


def _interoperability_explain(f: Facts, score: Column) -> Explanation:
    p, target, floor = _complete(f), f.limit("completeness_pct"), f.limit("completeness_floor")
    good = (p >= floor) & (p >= target - 15.0) & (p >= target)
    return Explanation(
        _headline(score, "Cell completeness is ", _num(p), "%."),
        [
            _say("Overall cell completeness: ", _num(p), "%"),
            F.when(good & _codes_seen(f),
                   "Ontology standards (ICD/SNOMED/LOINC/FHIR) detected in data columns."),
            F.when(good & _standard_declared(f),
                   _say("Standard health coding framework declared in metadata: ", f.text("standards_used"))),
        ],
        [
            F.when(p < floor, _say("Extremely low data completeness (<", _num(floor), "%)."))
            .when(p < target - 15.0, _say("Low data completeness (<", _num(target - 15.0), "%)."))
            .when(p < target, _say("Moderate data completeness (<", _num(target), "%)."))
            .when(~(_codes_seen(f) | _standard_declared(f)),
                  "No medical coding standards detected in data or declared in metadata."),
        ],
    )


# ---- 6 analytics readiness -------------------------------------------------------------

def _format(f: Facts) -> Column:
    return F.lower(F.coalesce(f.string("file_format"), F.lit("csv")))


def _imbalanced(f: Facts) -> Column:
    ratio = f.number("imbalance_ratio")
    return F.coalesce((ratio != 0) & (ratio > f.limit("imbalance_ratio_ok")), F.lit(False))


def _readiness_score(f: Facts) -> Column:
    return (F.when(~_format(f).isin(fixed.ANALYTIC_FORMATS), 1)
            .when(~f.flag("data_dictionary_uploaded"), 2)
            .when(~f.flag("provenance_pipeline_available"), 3)
            .when(_imbalanced(f), 3).otherwise(4))


def _readiness_explain(f: Facts, score: Column) -> Explanation:
    fmt, ok = _format(f), _num(f.limit("imbalance_ratio_ok"))
    usable = fmt.isin(fixed.ANALYTIC_FORMATS)
    documented, linked = f.flag("data_dictionary_uploaded"), f.flag("provenance_pipeline_available")
    full = usable & documented & linked
    evidence = [_say("File format is ", fmt, ".")]
    if isinstance(f.types.get("dq_checks_applied"), T.ArrayType):
        checks = f.raw("dq_checks_applied")
        evidence.append(F.when(F.size(checks) > 0, _say(
            "Automated data quality checks documented: ", F.array_join(checks, ", "), ".")))
    if f.has("rows") and f.has("columns"):
        evidence.append(_say("Dataset profile dimensions verified (", cells.text_or(f.raw("rows"), "0"),
                             " rows, ", cells.text_or(f.raw("columns"), "0"), " cols)."))
    evidence.append(F.when(full & ~_imbalanced(f), _say(
        "Data dictionary and pipeline script present. Class balance within target (", ok, ").")))
    return Explanation(
        _headline(score, "Format is ", fmt, " with dictionary=", f.printed_flag("data_dictionary_uploaded"), "."),
        evidence,
        [
            F.when(~usable, "Proprietary or unoptimized file format.")
            .when(~documented, "Data dictionary not uploaded.")
            .when(~linked, "Data preprocessing pipeline script not linked.")
            .when(_imbalanced(f), _say("Severe class imbalance detected (", _num(f.number("imbalance_ratio")),
                                       " > ", ok, ").")),
        ],
    )


# ---- 7 privacy -------------------------------------------------------------------------

def _deidentified(f: Facts) -> Column:
    return cells.filled(f.string("deidentification_method"))


def _k_at_least(f: Facts, factor: int) -> Column:
    k = f.number("k_anonymity_value", "int")
    return F.coalesce((k != 0) & (k >= f.limit("k_anonymity_min") * factor), F.lit(False))


def _privacy_score(f: Facts) -> Column:
    return (F.when(f.flag("direct_identifiers_detected"), 1).when(~_deidentified(f), 1)
            .when(f.flag("differential_privacy_applied"), 4)
            .when(_k_at_least(f, 2), 4).when(_k_at_least(f, 1), 3).otherwise(2))


def _privacy_explain(f: Facts, score: Column) -> Explanation:
    found = f.flag("direct_identifiers_detected")
    method = F.coalesce(f.text("deidentification_method"), f.string("deidentification_method"))
    k, k_min = f.string("k_anonymity_value"), f.limit("k_anonymity_min")
    evidence = [F.when(~found, "No direct identifiers found in dataset.")]
    if isinstance(f.types.get("direct_identifiers_present"), T.ArrayType):
        declared = f.raw("direct_identifiers_present")
        evidence.append(F.when(~found & (F.size(declared) > 0), _say(
            "Declared direct identifiers in metadata: ", F.array_join(declared, ", "), ".")))
    evidence.append(F.when(~found & _deidentified(f), F.when(
        f.flag("differential_privacy_applied"), F.lit("Differential Privacy applied."))
        .when(_k_at_least(f, 2), _say("k-anonymity verified with k=", k, " (>= ", k_min * 2, ")."))
        .when(_k_at_least(f, 1), _say("k-anonymity verified with k=", k, " (>= ", k_min, ")."))
        .otherwise(_say("De-identification applied: ", method))))
    return Explanation(
        F.when(found, "Direct PII identifiers found in dataset.").otherwise(
            _headline(score, "Direct identifiers absent. De-identification is ",
                      F.coalesce(F.nullif(method, F.lit("")), F.lit("absent")), ".")),
        evidence,
        [
            F.when(found, "Direct identifiers (name, phone, GPS or ID) detected in column headers.")
            .when(~_deidentified(f), "No de-identification method declared."),
        ],
    )


# ---- 8 security ------------------------------------------------------------------------

@dataclass(frozen=True)
class _Access:
    stated: Column
    public: Column
    role: Column
    approval: Column
    agreement: Column


def _access(f: Facts) -> _Access:
    control = f.text("access_control_method")
    words = F.lower(F.coalesce(control, F.lit("")))
    return _Access(control, cells.any_word(words, fixed.PUBLIC_WORDS), cells.any_word(words, fixed.ROLE_WORDS),
                   cells.any_word(words, fixed.APPROVAL_WORDS), f.flag("dua_required"))


def _security_score(f: Facts) -> Column:
    a = _access(f)
    return (F.when(a.stated.isNull(), 1).when(a.public, 2).when(a.agreement & a.role, 4)
            .when(a.agreement | a.approval | a.role, 3).otherwise(2))


def _security_explain(f: Facts, score: Column) -> Explanation:
    a = _access(f)
    return Explanation(
        _headline(score, "Access control is ", cells.text_or(a.stated, "absent"), "."),
        [
            F.when(a.stated.isNull(), F.lit(None).cast("string"))
            .when(a.public, "Public / open access control documented.")
            .when(a.agreement & a.role,
                  "Role-based / authenticated access control with Data Use Agreement (DUA) enforced.")
            .when(a.agreement & a.approval,
                  "Approval-based access with Data Use Agreement (DUA) requirement documented.")
            .when(a.agreement | a.approval | a.role, _say("Controlled access governance documented: ", a.stated))
            .otherwise(_say("Access control documented: ", a.stated)),
        ],
        [F.when(a.stated.isNull(), "No access control method documented.")],
    )


# ---- 9 provenance ----------------------------------------------------------------------

def _provenance_branch(f: Facts, nothing, version_only, lineage_only, rest) -> Column:
    lineage, log = f.flag("provenance_pipeline_available"), f.flag("changelog_provided")
    version = f.stated("version_format")
    return (F.when(~lineage & ~log & ~version, nothing).when(version & ~lineage, version_only)
            .when(lineage & ~log, lineage_only).otherwise(rest))


def _provenance_explain(f: Facts, score: Column) -> Explanation:
    start, end = f.string("collection_start_date"), f.string("collection_end_date")
    grain = f.text("temporal_granularity")
    return Explanation(
        _headline(score, "Pipeline=", f.printed_flag("provenance_pipeline_available"), ", Changelog=",
                  f.printed_flag("changelog_provided"), "."),
        [
            F.when(cells.filled(start) | cells.filled(end),
                   _say("Temporal data collection span documented (", cells.text_or(start, "N/A"), " to ",
                        cells.text_or(end, "N/A"), ").")),
            F.when(grain.isNotNull(), _say("Temporal resolution documented: ", grain, ".")),
            _provenance_branch(
                f, F.lit(None).cast("string"),
                _say("Version format defined: ", f.text("version_format")),
                F.lit("Preprocessing data lineage pipeline documented."),
                F.lit("Workflow pipeline, version history, and changelog fully available.")),
        ],
        [_provenance_branch(f, F.lit("No provenance metadata provided."), *[F.lit(None).cast("string")] * 3)],
    )


# ---- 10 ethics -------------------------------------------------------------------------

def _ethics_score(f: Facts) -> Column:
    both = f.stated("ethics_approval_ref") & f.stated("consent_type")
    social = f.flag("equity_analysis_performed") | f.flag("community_engagement")
    return (F.when(~both, 1).when(~social, 2).when(f.flag("redressal_mechanism_exists"), 4).otherwise(3))


def _ethics_explain(f: Facts, score: Column) -> Explanation:
    ref, consent = f.text("ethics_approval_ref"), f.text("consent_type")
    both = ref.isNotNull() & consent.isNotNull()
    social = f.flag("equity_analysis_performed") | f.flag("community_engagement")
    return Explanation(
        _headline(score, "Ethics approval=", cells.text_of_flag(ref.isNotNull()), ", Consent=",
                  cells.text_or(consent, "None"), "."),
        [
            F.when(ref.isNotNull(), _say("Ethics approval reference: ", ref)),
            F.when(both, _say("Consent type: ", consent)),
            F.when(both & social, _say(
                "Social accountability (equity=", f.printed_flag("equity_analysis_performed"), ", community=",
                f.printed_flag("community_engagement"), ") performed.")),
            F.when(both & social & f.flag("redressal_mechanism_exists"), "Grievance redressal mechanism exists."),
        ],
        [
            F.when(ref.isNull() & consent.isNull(), "Ethics approval reference and consent protocol missing."),
            F.when(ref.isNotNull() & consent.isNull(), "Consent protocol not described."),
            F.when(both & ~social, "No equity analysis or community engagement reported."),
        ],
    )


# ---- 11 synthetic ----------------------------------------------------------------------

def _no_synthetic(f: Facts) -> Column:
    share = f.number("synthetic_data_pct")
    none = share.isNull() | (share == 0)
    if f.has("domain_11_applicable"):
        none = none | ~cells.yes(f.raw("domain_11_applicable"))
    return none


def _synthetic_score(f: Facts) -> Column:
    useful, private = f.flag("synthetic_utility_evaluated"), f.flag("synthetic_privacy_tested")
    return (F.when(_no_synthetic(f), F.lit(None).cast("int"))
            .when(~useful, 1).when(~private, 2)
            .when(f.number("synthetic_data_pct") >= f.limit("majority_synthetic_pct"), 4).otherwise(3))


def _synthetic_explain(f: Facts, score: Column) -> Explanation:
    on, share = ~_no_synthetic(f), _num(f.number("synthetic_data_pct"))
    useful, private = f.flag("synthetic_utility_evaluated"), f.flag("synthetic_privacy_tested")
    most = f.limit("majority_synthetic_pct")
    return Explanation(
        F.when(~on, "Dataset contains no synthetic or simulated data. Domain excluded from CQI calculation.")
        .otherwise(_headline(score, "Synthetic pct=", share, "%, utility=",
                             f.printed_flag("synthetic_utility_evaluated"), ", privacy=",
                             f.printed_flag("synthetic_privacy_tested"), ".")),
        [
            F.when(on, _say("Synthetic data ratio: ", share, "%")),
            F.when(on & useful & ~private, "Synthetic utility evaluated."),
            F.when(on & useful & private, "Synthetic utility and privacy tested."),
            F.when(on & useful & private & (f.number("synthetic_data_pct") >= most),
                   _say("Majority synthetic dataset (>=", _num(most), "%).")),
        ],
        [
            F.when(on & ~useful & ~private, "Synthetic utility and privacy not evaluated."),
            F.when(on & useful & ~private, "Synthetic privacy leakage not tested."),
        ],
    )


# ---- 12 stewardship --------------------------------------------------------------------

def _stewardship_score(f: Facts) -> Column:
    law = f.string("dpdp_compliance_status")
    return (F.when(~f.flag("named_steward_exists"), 1).when(law == "fully_compliant", 4)
            .when(law == "partially_compliant", 3).otherwise(2))


def _stewardship_explain(f: Facts, score: Column) -> Explanation:
    law, held = f.string("dpdp_compliance_status"), f.flag("named_steward_exists")
    known = F.coalesce(law.isin("fully_compliant", "partially_compliant"), F.lit(False))
    return Explanation(
        _headline(score, "steward=", f.printed_flag("named_steward_exists"), ", DPDP=",
                  cells.text_or(law, "None"), "."),
        [
            F.when(held, "Named data steward designated."),
            F.when(held & (law == "fully_compliant"), "DPDP compliant status verified (fully compliant).")
            .when(held & (law == "partially_compliant"), "DPDP compliance in progress (partially compliant)."),
        ],
        [
            F.when(~held, "No named data steward or custodian designated.")
            .when(~known, "DPDP compliance status not verified or non-compliant."),
        ],
    )


# ---- 13 model linkage ------------------------------------------------------------------

@dataclass(frozen=True)
class _Models:
    absent: Column
    several: Column
    printed: Column


def _models(f: Facts) -> _Models:
    """Linked models arrive as an array, a map, or JSON text holding either."""
    kind, c = f.types.get("linked_model_ids", T.NullType()), f.raw("linked_model_ids")

    def of_array(a: Column) -> tuple[Column, Column, Column]:
        shown = F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']"))
        return a.isNull() | (F.size(a) == 0), F.size(a) > 1, shown

    def of_map(m: Column) -> tuple[Column, Column, Column]:
        pairs = F.transform(F.map_entries(m), lambda e: F.concat(
            F.lit("'"), e["key"], F.lit("': '"), e["value"], F.lit("'")))
        return m.isNull(), m.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))

    if isinstance(kind, T.ArrayType):
        return _Models(*of_array(c))
    if isinstance(kind, T.MapType):
        return _Models(*of_map(c))
    if cells.is_text(kind):
        is_map = F.ltrim(c).startswith("{")
        a_gone, a_many, a_text = of_array(F.when(~is_map, F.from_json(c, "array<string>")))
        m_gone, m_many, m_text = of_map(F.when(is_map, F.from_json(c, "map<string,string>")))
        return _Models(c.isNull() | F.when(is_map, m_gone).otherwise(a_gone),
                       F.when(is_map, m_many).otherwise(a_many), F.when(is_map, m_text).otherwise(a_text))
    return _Models(F.lit(True), F.lit(False), F.lit(None).cast("string"))


def _linkage_score(f: Facts) -> Column:
    m = _models(f)
    return (F.when(m.absent, f.limit("neutral_score_when_no_models").cast("int"))
            .when(m.several, 4).otherwise(3))


def _linkage_explain(f: Facts, score: Column) -> Explanation:
    m = _models(f)
    return Explanation(
        _headline(score, "Model linkage is ",
                  F.when(m.absent, "absent").otherwise(F.coalesce(F.nullif(m.printed, F.lit("{}")), F.lit("absent"))),
                  "."),
        [
            F.when(m.absent, "No models linked to this dataset (neutral rating applied).")
            .otherwise(_say("Linked model IDs: ", m.printed)),
            F.when(~m.absent & m.several, "Multiple models/configurations linked."),
        ],
        [],
    )


# ---- 14 sustainability -----------------------------------------------------------------

def _sustainability_branch(f: Facts, stated, columnar, small, large) -> Column:
    size = F.coalesce(f.number("size_bytes", "bigint"), F.lit(0))
    return (F.when(f.flag("sustainability_info_provided"), stated).when(_format(f) == "parquet", columnar)
            .when(size < f.limit("max_file_size_bytes"), small).otherwise(large))


def _sustainability_explain(f: Facts, score: Column) -> Explanation:
    nothing = F.lit(None).cast("string")
    return Explanation(
        _headline(score, "Sustainability assessed on size and file format."),
        [_sustainability_branch(
            f, F.lit("Environmental sustainability documentation or energy usage information provided."),
            F.lit("Optimized binary column format (Parquet) reduces CPU cycles and storage size."),
            _say("Small file footprint (<", f.limit("max_file_size_bytes"),
                 " bytes) reduces transmission and analysis carbon costs."), nothing)],
        [_sustainability_branch(f, nothing, nothing, nothing, F.lit(
            "Large raw text file (CSV/XLSX) increases storage and compute footprint."))],
    )


# ---- 15 curation -----------------------------------------------------------------------

def _curation_branch(f: Facts, none, repo_only, log_only, both) -> Column:
    repo, log = f.stated("github_repo_url"), f.flag("changelog_provided")
    return F.when(~repo & ~log, none).when(~log, repo_only).when(~repo, log_only).otherwise(both)


def _curation_explain(f: Facts, score: Column) -> Explanation:
    nothing = F.lit(None).cast("string")
    return Explanation(
        _headline(score, "Repo=", cells.text_of_flag(f.stated("github_repo_url")), ", Changelog=",
                  f.printed_flag("changelog_provided"), "."),
        [
            F.when(f.flag("feedback_mechanism_exists"),
                   "User feedback collection & continuous curation mechanism active."),
            _curation_branch(f, nothing, _say("Active code/data repository: ", f.text("github_repo_url")),
                             F.lit("Changelog/updates documentation provided."),
                             F.lit("Active repository and detailed changelog provided.")),
        ],
        [_curation_branch(f, F.lit("No active repository or version changelog provided."),
                          nothing, nothing, nothing)],
    )


_NAMES = {number: name for number, name, _ in fixed.DOMAINS}


def _domain(number: int, score, explain, confidence="Low", **more) -> Domain:
    level = _always(confidence) if isinstance(confidence, str) else confidence
    return Domain(number, _NAMES[number], score, explain, level, **more)


BUILT_IN: tuple[Domain, ...] = (
    _domain(1, _annotation_score, _annotation_explain,
            reads=(("irr_value", "double"), ("num_annotators", "int"))),
    _domain(2, _metadata_score, _metadata_explain),
    _domain(3, lambda f: F.greatest(F.lit(1), _document_count(f)), _documentation_explain),
    _domain(4, _representativeness_score, _representativeness_explain, reads=(("num_sites", "int"),)),
    _domain(5, _interoperability_score, _interoperability_explain, "High"),
    _domain(6, _readiness_score, _readiness_explain, "Medium"),
    _domain(7, _privacy_score, _privacy_explain,
            lambda f: F.when(f.flag("direct_identifiers_detected"), "High").otherwise("Medium"),
            reads=(("k_anonymity_value", "int"),)),
    _domain(8, _security_score, _security_explain),
    _domain(9, lambda f: _provenance_branch(f, F.lit(1), F.lit(2), F.lit(3), F.lit(4)), _provenance_explain),
    _domain(10, _ethics_score, _ethics_explain),
    _domain(11, _synthetic_score, _synthetic_explain,
            lambda f: F.when(~_no_synthetic(f), "Low"), reads=(("synthetic_data_pct", "double"),),
            not_applicable=_no_synthetic),
    _domain(12, _stewardship_score, _stewardship_explain),
    _domain(13, _linkage_score, _linkage_explain),
    _domain(14, lambda f: _sustainability_branch(f, F.lit(4), F.lit(3), F.lit(3), F.lit(2)),
            _sustainability_explain, "Medium"),
    _domain(15, lambda f: _curation_branch(f, F.lit(1), F.lit(2), F.lit(3), F.lit(4)), _curation_explain),
)


def register(domain: Domain, domains: tuple[Domain, ...] = BUILT_IN) -> tuple[Domain, ...]:
    """Domains with one added, or replaced when the number is taken."""
    return tuple(sorted([d for d in domains if d.number != domain.number] + [domain], key=lambda d: d.number))


def score_name(number: int) -> str:
    return f"d{number:02d}"


def _failure(d: Domain, f: Facts) -> Column | None:
    said = [u for u in (f.unreadable(name, kind) for name, kind in d.reads) if u is not None]
    return F.coalesce(*said) if said else None


def _guarded_score(d: Domain, f: Facts) -> Column:
    failed, score = _failure(d, f), d.score(f).cast("int")
    return score if failed is None else F.when(failed.isNotNull(), F.lit(1)).otherwise(score)


_BUILT: dict[tuple, list[Column]] = {}


def _reused(what: str, f: Facts, domains: tuple[Domain, ...], build: Callable[[], list[Column]]) -> list[Column]:
    """Expressions of an equal schema, criteria and set of domains are built once per driver: they take
    thousands of calls into the JVM, which is seconds for a plan that may run in one."""
    criteria = getattr(f.limit, "same_as", None)
    if criteria is None:
        return build()
    key = (what, id(SparkContext._gateway), criteria, domains, tuple((n, t.simpleString()) for n, t in f.types.items()))
    if key not in _BUILT:
        if len(_BUILT) >= 32:
            _BUILT.clear()
        _BUILT[key] = build()
    return _BUILT[key]


def with_scores(df: DataFrame, limit: crit.Limit | None = None,
                domains: tuple[Domain, ...] = BUILT_IN) -> DataFrame:
    """Add one integer column per domain (d01, d02, ...); NULL when not applicable."""
    df = with_clean(df)
    f = Facts(df, limit)
    return df.select("*", *_reused("scores", f, domains, lambda: [
        _guarded_score(d, f).alias(score_name(d.number)) for d in domains]))


def verdict(d: Domain, f: Facts, score: Column) -> Column:
    """The full result struct of one domain, given its score column."""
    said = d.explain(f, score)
    skip = d.not_applicable(f) if d.not_applicable else F.lit(False)
    rationale, confidence = said.rationale, d.confidence(f)
    evidence, gaps = cells.lines(said.evidence), cells.lines(said.gaps)
    failed = _failure(d, f)
    if failed is not None:
        broke = failed.isNotNull()
        skip = skip & ~broke
        rationale = F.when(broke, _say("Scoring failed due to error: ", failed, " — defaulted to 1")).otherwise(rationale)
        evidence = F.when(broke, F.array().cast("array<string>")).otherwise(evidence)
        gaps = F.when(broke, F.array(_say("Scoring failed: ", failed))).otherwise(gaps)
        confidence = F.when(broke, "Low").otherwise(confidence)
    return F.struct(
        F.lit(d.number).alias("domain_number"), F.lit(d.name).alias("domain_name"), score.alias("score"),
        F.when(~skip, F.lit(4)).alias("max_score"), skip.alias("not_applicable"),
        confidence.cast("string").alias("confidence"), rationale.alias("rationale"),
        evidence.alias("evidence_items"), gaps.alias("gaps"),
    )


def with_verdicts(df: DataFrame, limit: crit.Limit | None = None,
                  domains: tuple[Domain, ...] = BUILT_IN) -> DataFrame:
    """Add `domain_scores`, the ordered array of result structs. `df` carries the d01.. columns."""
    df = with_clean(df)
    f = Facts(df, limit)
    return df.select("*", *_reused("verdicts", f, domains, lambda: [
        F.array(*[verdict(d, f, F.col(score_name(d.number))) for d in domains]).alias("domain_scores")]))


def one_domain(df: DataFrame, number: int, key: str = "dataset_id", limit: crit.Limit | None = None,
               domains: tuple[Domain, ...] = BUILT_IN) -> DataFrame:
    """(key, score, confidence, rationale, evidence, gaps) of a single domain."""
    d = next(x for x in domains if x.number == number)
    df = with_clean(df)
    f = Facts(df, limit)
    scored = df.select("*", _guarded_score(d, f).alias("_score"))
    return scored.select(key, verdict(d, f, F.col("_score")).alias("v")).select(key, "v.*")


def long_scores(df: DataFrame, key: list[str] | str = "dataset_id") -> DataFrame:
    """One row per dataset and domain, as stored: an inapplicable domain keeps confidence `Low`."""
    keys = [key] if isinstance(key, str) else list(key)
    # The outer form: the plain one makes Spark add a `size > 0` filter that repeats every expression.
    rows = df.select(*keys, F.inline_outer("domain_scores"))
    return rows.withColumn("confidence", F.when(F.col("not_applicable"), "Low").otherwise(F.col("confidence")))


def score_rows(scored: DataFrame, key: str = "dataset_id", domains: tuple[Domain, ...] = BUILT_IN) -> DataFrame:
    """(key, domain_number, domain_name, score, not_applicable) from the d01.. columns, without texts."""
    items = [F.struct(F.lit(d.number).alias("domain_number"), F.lit(d.name).alias("domain_name"),
                      F.col(score_name(d.number)).alias("score"),
                      F.col(score_name(d.number)).isNull().alias("not_applicable")) for d in domains]
    return scored.select(key, F.inline(F.array(*items)))
