"""Read paths over stored assessments: detail, history, audit trail, visibility, dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayframe.operators import numbering


def visible_to(assessments: DataFrame, role: str, user_id=None) -> DataFrame:
    """Rows a role may see: admins none, reviewers all, others their own."""
    if role == "admin":
        return assessments.where(F.lit(False))
    if role == "reviewer":
        return assessments
    return assessments.where(F.col("user_id") == F.lit(user_id))


def history_page(assessments: DataFrame, results: DataFrame, dataset_id, status: str | None = None,
                 limit: int = 10, offset: int = 0, id_col: str = "assessment_id") -> DataFrame:
    """One page of a dataset's history, newest first, with the count of all matching rows.

    The count is a scalar subquery; the page is cut before the results are joined."""
    if not 1 <= limit <= 50 or offset < 0:
        raise ValueError("limit must be 1 to 50 and offset not negative")
    mine = assessments.where(F.col("dataset_id") == F.lit(dataset_id))
    if status:
        mine = mine.where(F.col("status") == status)
    total = mine.agg(F.count(F.lit(1))).scalar()
    page = mine.orderBy(F.desc("submission_timestamp"), F.col(id_col)).offset(offset).limit(limit)
    # the page has at most 50 rows: its ids pick their results before anything is joined
    found = results.join(F.broadcast(page.select(id_col)), id_col, "left_semi")
    return page.join(found, id_col, "left").withColumn("total", total)


def user_page(assessments: DataFrame, user_id, skip: int = 0, limit: int = 10, id_col: str = "assessment_id") -> DataFrame:
    if not 1 <= limit <= 100 or skip < 0:
        raise ValueError("limit must be 1 to 100 and skip not negative")
    mine = assessments.where(F.col("user_id") == F.lit(user_id))
    return mine.orderBy(F.desc("submission_timestamp"), F.col(id_col)).offset(skip).limit(limit)


def pages_of(assessments: DataFrame, by: str, limit: int = 10, offset: int = 0, id_col: str = "assessment_id") -> DataFrame:
    """The same page for every owner at once, with `position` and `total`.

    Spark cuts the row number filter before the shuffle (window group limit), so a hot owner sends
    at most offset + limit rows per task; the totals come from a partial aggregation."""
    newest = W.partitionBy(by).orderBy(F.desc("submission_timestamp"), F.col(id_col))
    page = (assessments.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= offset + limit)
            .where(F.col("position") > offset))
    totals = assessments.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    return page.join(totals, by)


def audit_trail(audit: DataFrame, assessment_id=None) -> DataFrame:
    """Events in time order, of one assessment or of all."""
    if assessment_id is not None:
        return audit.where(F.col("assessment_id") == F.lit(assessment_id)).orderBy("event_timestamp", "log_id")
    return audit.orderBy("assessment_id", "event_timestamp", "log_id")


def audit_positions(audit: DataFrame) -> DataFrame:
    """The whole trail with each event's exact position from 1 on, by assessment and time; the log is sorted in ranges."""
    return numbering.with_row_number(audit, [F.col("assessment_id"), F.col("event_timestamp"), F.col("log_id")], "position")


def completion_log(audit: DataFrame, key: str = "assessment_id") -> DataFrame:
    """(key, audit_log_id): first completion event, else first event. One partial aggregation."""
    at = F.struct("event_timestamp", "log_id")
    done = F.col("event_type") == "assessment_complete"
    return audit.groupBy(key).agg(F.coalesce(F.min_by(F.when(done, F.col("log_id")), F.when(done, at)),
                                             F.min_by("log_id", at)).alias("audit_log_id"))


def profile_summary(facts: DataFrame) -> Column:
    """Struct of the summary columns, absent or NULL facts read as their defaults."""
    def f(name: str, default, kind: str) -> Column:
        c = F.col(name) if name in facts.columns else F.lit(None)
        return F.coalesce(c.cast(kind), F.lit(default)).alias(name) if default is not None else c.cast(kind).alias(name)

    return F.struct(
        f("rows", 0, "bigint"), f("columns", 0, "int"), f("file_format", "csv", "string"),
        f("size_bytes", 0, "bigint").alias("file_size_bytes"), f("overall_completeness_pct", 100.0, "double"),
        f("direct_identifiers_detected", False, "boolean"), f("icd_codes_present", False, "boolean").alias("icd_codes_detected"),
        f("sampled", False, "boolean"), f("sample_rows", None, "bigint"))


DETAIL_ROWS = 20_000  # assessments of one part: a task holds the texts of all their scores


def by_key(df: DataFrame, key: str, rows: int = DETAIL_ROWS) -> DataFrame:
    """Rows dealt by their key, about `rows` to a part. Rows that are made wide afterwards then lie by key already: groups and
    joins by it move the narrow rows given here and not the wide ones."""
    conf = df.sparkSession.conf
    least = [conf.get(n, None) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")]
    return df.repartition(max(-(-df.count() // rows), *[int(n) for n in least if n], 1), key)  # fewer parts than a join's would be dealt anew


def detail(assessments: DataFrame, results: DataFrame, scores: DataFrame, metadata: DataFrame, profiles: DataFrame,
           audit: DataFrame, key: str = "assessment_id") -> DataFrame:
    """Detail document columns of every assessment; parts stay NULL unless it is complete with a result.

    Every child is reduced to one row per assessment before the join: at most 15 scores, one log id. Scores made of rows that lie
    `by_key` are grouped and joined where they are, without moving a text; they are never broadcast, as their size is guessed too low."""
    numbers = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "domain_number", "domain_name", "score", F.when(~F.col("not_applicable"), F.lit(4)).alias("max_score"),
        "not_applicable", F.when(~F.col("not_applicable"), F.col("confidence")).alias("confidence"),
        "rationale", "evidence_items", "gaps"))).alias("domain_scores"))
    summary = profiles.select(key, profile_summary(profiles).alias("profile_summary"))
    forms = metadata.select(key, F.col("dataset_name"), F.col("sensitivity_class"))
    joined = (assessments.join(numbers.hint("merge"), key, "left").join(results.withColumn("_has_result", F.lit(True)), key, "left")
              .join(forms.withColumn("_has_form", F.lit(True)), key, "left").join(summary, key, "left")
              .join(completion_log(audit, key), key, "left"))
    ready = (F.col("status") == "complete") & F.col("_has_result").isNotNull()
    base = F.coalesce(F.col("baseline_risk").cast("double"), F.lit(0.0))
    times = F.coalesce(F.nullif(F.col("sensitivity_multiplier").cast("double"), F.lit(0.0)), F.lit(1.0))

    def shown(c: Column) -> Column:
        return F.when(ready, c)

    return joined.select(
        key, "status", "dataset_id", "submission_timestamp",
        shown(F.when(F.col("_has_form").isNotNull(), F.col("dataset_name")).otherwise("Unknown")).alias("dataset_name"),
        shown(F.struct(F.col("cqi").alias("value"), F.col("cqi_band").alias("band"), F.col("total_score"),
                       F.col("max_possible"), F.coalesce("cqi_trace", F.lit("")).alias("formula_trace"))).alias("cqi"),
        shown(F.struct(F.col("prs").alias("value"), F.col("prs_band").alias("band"), base.alias("baseline_risk"),
                       F.when(F.col("_has_form").isNotNull(), F.col("sensitivity_class")).otherwise("standard").alias("sensitivity_class"),
                       times.alias("sensitivity_multiplier"), (base * times).alias("adjusted_risk"),
                       F.coalesce("prs_trace", F.lit("")).alias("computation_trace"))).alias("prs"),
        shown(F.struct(F.col("release_class").alias("classification"),
                       F.coalesce("release_justification", F.lit("")).alias("justification"),
                       F.col("policy_override_applied"))).alias("release"),
        shown(F.col("domain_scores")).alias("domain_scores"), shown(F.col("profile_summary")).alias("profile_summary"),
        shown(F.coalesce(F.col("audit_log_id").cast("string"), F.col(key).cast("string"))).alias("audit_log_id"))


# ---- dashboard -------------------------------------------------------------------------

def run_counters(assessments: DataFrame) -> DataFrame:
    s = F.col("status")
    return assessments.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "complete").alias("completed"),
                           F.count_if(s.isin("processing", "queued")).alias("in_progress"))


NO_GAP_TEXT = "General quality improvement recommended."  # fixed value


def gap_panel(scores: DataFrame, key: str = "dataset_id", most: int = 2, default: str = NO_GAP_TEXT) -> DataFrame:
    """One row per gap text of every applicable domain scoring `most` or less."""
    weak = scores.where(~F.col("not_applicable") & (F.col("score") <= most))
    return weak.select(key, "domain_number", "domain_name", "score", F.posexplode_outer("gaps").alias("gap_index", "gap")).select(
        key, "domain_number", "domain_name", "score", F.coalesce("gap_index", F.lit(0)).alias("gap_index"),
        F.coalesce("gap", F.lit(default)).alias("gap"))


def radar(scores: DataFrame, key: str = "dataset_id") -> DataFrame:
    return scores.select(key, F.concat(F.lit("D"), F.col("domain_number").cast("string")).alias("label"),
                         F.coalesce("score", F.lit(0)).alias("value"), F.lit(4).alias("full_mark"))


def radar_wide(scores: DataFrame, key: str = "dataset_id", numbers: range = range(1, 16)) -> DataFrame:
    """One row per dataset, D1..D15. One group per dataset holds all its numbers; a pivot would first group by dataset and number."""
    return scores.groupBy(key).agg(*[
        F.coalesce(F.max(F.when(F.col("domain_number") == n, F.col("score"))), F.lit(0)).alias(f"D{n}") for n in numbers])


def score_progress(scores: DataFrame, key: str = "dataset_id") -> DataFrame:
    return scores.select(key, "domain_number", "score", (F.col("score") / 4 * 100).alias("progress_pct"))


def gaps_and_strengths(scores: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Per dataset: weak domains by ascending score, strong domains by number (at most 15 each)."""
    on = ~F.col("not_applicable")
    return scores.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.when(on & (F.col("score") <= 2), F.struct("score", "domain_number")))),
                    lambda x: x["domain_number"]).alias("weak_domains"),
        F.array_sort(F.collect_list(F.when(on & (F.col("score") >= 3), F.col("domain_number")))).alias("strong_domains"))
