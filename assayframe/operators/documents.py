"""Report and payload documents as nested columns, rendered with to_json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import fixed
from assayframe.operators import reads

_JSON = {"ignoreNullFields": "false"}


def _each(count: int) -> list[Column]:
    """The result structs one by one. A lambda over the array would interpret the scorers' expressions."""
    return [F.col("domain_scores")[i] for i in range(count)]


def report(assessed: DataFrame, key: str = "dataset_id", computed_at: Column | None = None,
           toolkit_version: str = "1.1.0", domains: int = 15) -> DataFrame:
    """(key, report_json). Built inside the row from the assessed columns; no grouping."""
    have = assessed.columns
    doc = F.struct(
        F.col(key).cast("string").alias("assessment_id"), F.lit("complete").alias("status"), F.col(key).alias("dataset_id"),
        F.coalesce(F.col("dataset_name"), F.lit("Unknown")).alias("dataset_name") if "dataset_name" in have
        else F.lit("Unknown").alias("dataset_name"),
        F.lit(toolkit_version).alias("toolkit_version"),
        (computed_at if computed_at is not None else F.current_timestamp()).cast("string").alias("computed_at"),
        F.col("d11").isNotNull().alias("domain_11_applicable"),
        F.struct(F.col("cqi").alias("value"), F.col("cqi_band").alias("band"), "total_score", "max_possible",
                 F.col("cqi_trace").alias("formula_trace")).alias("cqi"),
        F.struct(F.col("prs").alias("value"), F.col("prs_band").alias("band"), "baseline_risk", "sensitivity_class",
                 "sensitivity_multiplier", "adjusted_risk", F.col("prs_trace").alias("computation_trace")).alias("prs"),
        F.struct(F.col("release_class").alias("classification"), F.col("release_justification").alias("justification"),
                 "policy_override_applied").alias("release"),
        F.array(*[F.struct(
            *[s[n].alias(n) for n in ("domain_number", "domain_name", "score", "max_score", "not_applicable")],
            F.when(s["not_applicable"], "Low").otherwise(s["confidence"]).alias("confidence"),
            *[s[n].alias(n) for n in ("rationale", "evidence_items", "gaps")]) for s in _each(domains)]).alias("domain_scores"),
        reads.profile_summary(assessed).withField("sampled", F.lit(False)).dropFields("sample_rows").alias("profile_summary"))
    return assessed.select(key, F.to_json(doc, _JSON).alias("report_json"))


def payload(assessed: DataFrame, key: str = "dataset_id", base_url: str = "http://localhost:8000",
            assessed_at: Column | None = None, audit_log_id: Column | None = None, toolkit_version: str = "1.1.0") -> DataFrame:
    """(key, payload_json): headline fields and a map slug -> {score, confidence}."""
    entries = []
    for (_, _, slug), s in zip(fixed.DOMAINS, _each(len(fixed.DOMAINS))):
        entries += [F.lit(slug), F.struct(F.when(~s["not_applicable"], s["score"]).alias("score"),
                                          F.when(~s["not_applicable"], s["confidence"]).alias("confidence"))]
    doc = F.struct(
        F.col(key).cast("string").alias("assessment_id"), F.col(key).alias("dataset_id"),
        (assessed_at if assessed_at is not None else F.current_timestamp()).cast("string").alias("assessed_at"),
        F.lit(toolkit_version).alias("toolkit_version"), "cqi", "cqi_band", "prs", "prs_band",
        F.col("release_class").alias("release_classification"), F.create_map(*entries).alias("domain_scores"),
        F.lit(base_url).alias("api_base_url"),
        F.concat(F.lit(base_url + "/api/v1/assess/"), F.col(key).cast("string"), F.lit("/report?format=html")).alias("report_url"),
        (audit_log_id if audit_log_id is not None else F.lit(None)).cast("string").alias("audit_log_id"))
    return assessed.select(key, F.to_json(doc, _JSON).alias("payload_json"))


def headline(assessed: DataFrame, key: str = "dataset_id") -> DataFrame:
    return assessed.select(key, F.coalesce(F.col("dataset_name"), F.lit("Unknown")).alias("dataset_name"), "cqi", "cqi_band",
                           "prs", "prs_band", "release_class")
