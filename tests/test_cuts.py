"""Rows and values that earlier versions lost: each must be kept, counted or reported."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assayframe.operators import catalog, composite, quality, validation
from assayframe.plans import assess
from assayframe.plans import criteria as crit
from assayframe.plans import profile
from assayframe.sources import readers


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_ragged_lines_are_counted_and_kept(spark, tmp_path):
    path = _file(tmp_path, "a.csv", "a,b\n1,2\n3,4,5\n6\nN/A,8\n")
    got = readers.ingest(spark, path, "csv")
    assert (got.malformed_rows, got.read_error, got.data.columns, got.data.count()) == (2, None, ["a", "b"], 4)
    raw = readers.read_csv(spark, path, malformed=True)
    assert {r["_malformed"] for r in raw.where("_malformed is not null").select("_malformed", "a").collect()} == {"3,4,5", "6"}
    p = profile.profile(got.data, malformed_rows=got.malformed_rows).dataset.first()
    assert (p.malformed_rows, p.read_error) == (2, None)


def test_quoted_line_break(spark, tmp_path):
    path = _file(tmp_path, "q.csv", 'a,b\n"x\ny",2\n3,4\n')
    assert readers.ingest(spark, path, "csv", multi_line=True).data.count() == 2
    assert readers.ingest(spark, path, "csv").malformed_rows > 0  # told, not silent


def test_only_parse_errors_give_an_empty_table(spark, tmp_path):
    with pytest.raises(PySparkException):
        readers.read_dataset(spark, str(tmp_path / "missing.csv"), "csv")
    with pytest.raises(PySparkException):
        readers.read_dataset(spark, str(tmp_path / "missing.parquet"), "parquet")
    bad = readers.ingest(spark, _file(tmp_path, "b.parquet", "no parquet at all"), "parquet")
    assert bad.data.columns == [] and bad.read_error
    broken = readers.ingest(spark, _file(tmp_path, "c.json", "{no json"), "json")
    assert broken.data.columns == [] and broken.read_error
    partly = readers.ingest(spark, _file(tmp_path, "d.json", '{"a": 1}\n{broken\n{"a": 2}\n'), "json", lines=True)
    assert (partly.data.columns, partly.data.count(), partly.malformed_rows) == (["a"], 2, 1)


def test_many_classes(spark):
    df = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id") % 15_000).alias("label"))
    p = profile.profile(df)
    row = p.dataset.first().label_columns
    assert row.class_distribution_truncated and len(row.class_distribution) == 10_000 and row.imbalance_ratio == 2.0
    assert sum(v == 2 for v in row.class_distribution.values()) == 5000 and p.class_counts.count() == 15_000


def test_sample_is_drawn_once(spark):
    df = spark.range(5000).select(F.col("id").alias("x"), (F.col("id") % 7).cast("string").alias("label"))
    a = profile.profile(df.repartition(3), sample_limit=500, sample_key=["x"])
    b = profile.profile(df.repartition(8), sample_limit=500, sample_key=["x"])
    assert a.dataset.first() == b.dataset.first() and sorted(map(str, a.columns.collect())) == sorted(map(str, b.columns.collect()))


def test_near_copies_of_any_script(spark):
    rows = [(1, "यह एक छोटा वाक्य है"), (2, "यह एक छोटा वाक्य है"), (3, "это короткое предложение для проверки"), (4, "это короткое предложение для проверки"),
            (5, "l'été dernier à la plage"), (6, "l'été dernier à la plage"), (7, "something else entirely here")]
    got = quality.near_copies(spark.createDataFrame(rows, "id long, text string"), "id", "text").collect()
    assert {(r["id"], r["copy_of"]) for r in got} == {(2, 1), (4, 3), (6, 5)}


def test_absent_required_fields(spark):
    from assayframe.functions import fixed

    got = validation.violations(spark.createDataFrame([("d", "name")], "dataset_id string, dataset_name string")).where("rule = 'required'")
    assert {r["field"] for r in got.collect()} == set(fixed.FORM_REQUIRED) - {"dataset_name"}


def test_tampering_within_a_second(spark):
    at = dt.datetime(2024, 1, 1, 12, 0, 0, 100)
    rows = [(i, 1, "started", at + dt.timedelta(seconds=i), "{}") for i in range(5)]
    log = spark.createDataFrame(rows, "log_id long, assessment_id long, event_type string, event_timestamp timestamp, event_detail string")
    moved = log.withColumn("event_timestamp", F.when(F.col("log_id") == 3, F.col("event_timestamp") + F.expr("INTERVAL '0.000007' SECOND")).otherwise(F.col("event_timestamp")))
    stored = catalog.chain_blocks(log)
    assert catalog.verify_chain(log, stored).count() == 0 and catalog.verify_chain(moved, stored).count() == 1


def test_runs_without_submission(spark):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "assessment_submitted", at), (1, "assessment_complete", at + dt.timedelta(seconds=5)), (2, "assessment_failed", at),
            (3, "assessment_submitted", at + dt.timedelta(seconds=9)), (3, "assessment_complete", at)]
    got = {r["hour"]: r for r in catalog.service_levels(spark.createDataFrame(rows, "assessment_id long, event_type string, event_timestamp timestamp")).collect()}
    assert (got[None]["runs"], got[None]["failed"], got[None]["unsubmitted"]) == (1, 1, 1)
    assert (got[at]["runs"], got[at]["reversed"], got[at]["longest_seconds"]) == (2, 1, 5)


def test_rows_without_key_are_no_orphans(spark):
    child = spark.createDataFrame([(1,), (None,), (7,), (7,)], "ref long")
    parent = spark.createDataFrame([(1,), (None,)], "id long")
    assert [r["ref"] for r in quality.orphans(child, "ref", parent, "id").collect()] == [7, 7]
    assert quality.orphan_counts(child, "ref", parent, "id").first()["orphan_rows"] == 2


def test_added_sensitivity_class(spark):
    limits = crit.from_document({"prs": {"sensitivity_multipliers": {"extreme": 3}}})
    df = spark.createDataFrame([("extreme", "district"), ("standard", "district")], "sensitivity_class string, location_granularity string")
    got = {r["sensitivity_class"]: r["sensitivity_multiplier"] for r in composite.with_prs(df, crit.literals(limits)).collect()}
    assert got == {"extreme": 3.0, "standard": 1.0}
    sets = {"plain": {}, "added": {"multiplier_extreme": 3}}
    both = composite.with_prs(crit.attach(df, sets), crit.columns(classes_=crit.classes(*sets.values()))).collect()
    assert {(r["criteria_id"], r["sensitivity_class"], r["sensitivity_multiplier"]) for r in both} == {
        ("plain", "extreme", 1.0), ("plain", "standard", 1.0), ("added", "extreme", 3.0), ("added", "standard", 1.0)}


def test_measured_facts_win(spark):
    forms = spark.createDataFrame([("a", "csv", 1), ("b", "json", 2)], "dataset_id string, file_format string, size_bytes long")
    facts = spark.createDataFrame([("a", "parquet", 9, 5)], "dataset_id string, file_format string, size_bytes long, rows long")
    got = {r["dataset_id"]: (r["file_format"], r["size_bytes"], r["rows"]) for r in assess.combine(forms, facts).collect()}
    assert got == {"a": ("parquet", 9, 5), "b": ("json", 2, None)}
