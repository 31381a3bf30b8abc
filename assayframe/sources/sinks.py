"""Append-only stores for profiles, scores, results, reports and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import fixed
from assayframe.operators import domains as dom


def write_profiles(profiles: DataFrame, path: str, as_json: bool = False) -> None:
    """Nested profile rows, with the profiler version. JSON goes to one text line per profile."""
    out = profiles if "profiler_version" in profiles.columns else profiles.withColumn("profiler_version", F.lit(fixed.PROFILER_VERSION))
    if as_json:
        out.write.mode("append").json(path)
    else:
        out.write.mode("append").parquet(path)


def result_rows(assessed: DataFrame, key: str = "assessment_id", *more: Column) -> DataFrame:
    """Stored shape and types of a result, and columns beside it that are not stored."""
    return assessed.select(
        F.col(key).cast("string").alias("assessment_id"), F.col("cqi").cast("decimal(5,1)").alias("cqi"), "cqi_band",
        F.col("total_score").alias("total_domain_score"), F.col("max_possible").alias("max_possible_score"),
        F.col("cqi_trace").alias("cqi_formula_trace"), "prs", "prs_band",
        F.col("baseline_risk").cast("decimal(6,2)").alias("prs_baseline_risk"),
        F.col("sensitivity_multiplier").cast("decimal(4,2)").alias("prs_sensitivity_multiplier"),
        F.col("prs_trace").alias("prs_computation_trace"), F.col("release_class").alias("release_classification"),
        F.col("release_justification").alias("classification_justification"), "policy_override_applied", *more)


def write_results(assessed: DataFrame, path: str, key: str = "assessment_id") -> None:
    """Partitioned by class so that class filters read only their folders."""
    result_rows(assessed, key).write.mode("append").partitionBy("release_classification").parquet(path)


def write_scores(assessed: DataFrame, path: str, key: str = "assessment_id") -> None:
    dom.long_scores(assessed, key).write.mode("append").parquet(path)


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").parquet(path)


def repeated_keys(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Keys stored more than once; empty when the uniqueness rule holds."""
    return stored.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") > 1)


def events(rows: DataFrame, key: str, event_type: Column | str, detail: Column | None = None, component: str = "worker",
           severity: Column | str = "INFO", at: Column | None = None) -> DataFrame:
    """Audit events, one per input row."""
    kind = F.lit(event_type) if isinstance(event_type, str) else event_type
    level = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(
        F.uuid().alias("log_id"), F.col(key).cast("string").alias("assessment_id"), kind.alias("event_type"),
        (at if at is not None else F.current_timestamp()).cast("timestamp").alias("event_timestamp"),
        F.lit(component).alias("component"), (F.to_json(detail) if detail is not None else F.lit("{}")).alias("event_detail"),
        level.alias("severity"))


def append_events(events_df: DataFrame, path: str) -> None:
    (events_df.withColumn("event_date", F.to_date("event_timestamp")).write.mode("append")
     .partitionBy("event_date").parquet(path))
