"""Work of the larger tables: parts, groups and joins that do not grow with them, rows that leave together, nothing run twice."""

import hashlib
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from assayframe.operators import catalog, domains, quality, reads
from assayframe.plans import assess as plan
from assayframe.sources import archives, commits
from registered import fixtures, history


def _archive(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.csv", text)
    return out.getvalue()


def test_members_of_a_batch_leave_together(monkeypatch):
    batch = pd.DataFrame({"path": ["a", "b", "c"], "content": [_archive("x" * 10), b"no archive", _archive("y" * 10)]})
    told = list(archives._members(iter([batch])))
    assert [len(t) for t in told] == [3]
    assert [None if pd.isna(x) else x for x in told[0]["member_ordinal"]] == [0, None, 0]
    monkeypatch.setattr(archives, "MEMBER_CHARS", 10)  # bounded by what is unpacked
    told = list(archives._members(iter([batch])))
    assert [list(t["archive"]) for t in told] == [["a"], ["b", "c"]]


def test_parts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "PART_ROWS", 10)
    df = spark.range(205)
    assert fixtures.spread(df).rdd.getNumPartitions() == 21
    assert fixtures.spread(spark.range(3)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_radar_has_one_group_per_dataset(spark):
    rows = [(1, 1, 3), (1, 1, 4), (1, 2, None), (None, 15, 2), (2, 99, 1)]
    wide = reads.radar_wide(spark.createDataFrame(rows, "dataset_id long, domain_number int, score int"))
    assert "pivotfirst" not in wide._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["dataset_id"]: (r["D1"], r["D2"], r["D15"]) for r in wide.collect()}
    assert got == {1: (4, 0, 0), None: (0, 0, 2), 2: (0, 0, 0)}


def test_forms_that_share_a_profile_are_not_gathered(spark):
    forms = spark.range(100).select((F.col("id") % 2).alias("table_no"), F.col("id").alias("form"), F.lit("csv").alias("file_format"))
    facts = spark.createDataFrame([(0, "json"), (0, "tsv"), (None, "xml")], "table_no long, file_format string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = plan.combine(forms, facts, "table_no")
        assert "BroadcastHashJoin" in both._jdf.queryExecution().executedPlan().toString()
        assert both.groupBy("file_format").count().collect() and {r[0]: r[1] for r in both.groupBy("file_format").count().collect()} == {"json": 50, "tsv": 50, "csv": 50}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_rows_of_a_series_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        made.add(1)
        return float(x)

    df = spark.range(40).select(F.lit("s").alias("dataset_id"), F.col("id").alias("submitted_at"), F.col("id").alias("assessment_id"),
                                score("id").alias("cqi"), F.col("id").cast("int").alias("prs"))
    got = catalog.score_deltas(df).collect()
    assert made.value == 40
    assert sorted((r["assessment_id"], r["cqi_delta"]) for r in got) == [(0, None)] + [(i, 1.0) for i in range(1, 40)]


def test_only_repeated_keys_are_grouped(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d"), (None, "e")], "k long, v string")
    none = commits.read_store(spark, str(tmp_path / "none"), rows.schema)
    held = spark.createDataFrame([(2, "z", 5)], "k long, v string, batch_no long")
    for few in (commits.FEW_KEYS, 0):  # broadcast, and by shuffle
        monkeypatch.setattr(commits, "FEW_KEYS", few)
        order = lambda r: str(tuple(r))
        assert sorted(map(tuple, commits.fresh_rows(rows, none, ["k"]).collect()), key=order) == [(1, "a"), (2, "c"), (None, "d")]
        assert sorted(map(tuple, commits.fresh_rows(rows, held, ["k"]).collect()), key=order) == [(1, "a"), (None, "d")]
        single = commits.fresh_rows(rows.where("v in ('a', 'c')"), held, ["k"])
        assert "to_json" not in single._jdf.queryExecution().optimizedPlan().toString().lower()
        assert [tuple(r) for r in single.collect()] == [(1, "a")]


def test_scorers_stay_within_what_the_jvm_compiles(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(name)
    try:
        for before, after in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(name, before)
            domains.with_scores(spark.createDataFrame([(1,)], "dataset_id long"))
            assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, was)


def test_texts_of_a_detail_are_not_moved(spark, sf_dir):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        doc = history.q_detail(spark, sf_dir)
        steps = doc._jdf.queryExecution().explainString(doc._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    moved = [t for t in steps if re.match(r"\(\d+\) (Exchange|BroadcastExchange)\n", t)]
    assert len(moved) > 4 and any("collect_list" in t for t in steps)
    assert not [t for t in moved if "rationale" in t or "domain_scores" in t or "buf#" in t]  # buf: gathered in part


def test_rows_by_key_make_the_same_details(spark, monkeypatch):
    monkeypatch.setattr(reads.by_key, "__defaults__", (10,))
    rows = spark.range(95).select(F.expr("if(id % 19 = 0, null, id % 40)").alias("dataset_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("dataset_name"))
    dealt = reads.by_key(rows, "dataset_id")
    assert dealt.rdd.getNumPartitions() == max(10, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.collect()))
    found = []
    for given in (rows, dealt):
        done = plan.assess(given).withColumnRenamed("dataset_id", "assessment_id")
        runs = spark.range(45).select(F.col("id").alias("assessment_id"), F.expr("if(id % 3 = 0, 'failed', 'complete')").alias("status"),
                                      F.lit("d").alias("dataset_id"), F.lit("2024-01-01").alias("submission_timestamp"))
        audit = spark.createDataFrame([(1, 2, "2024-01-01", "assessment_complete")], "assessment_id long, log_id long, event_timestamp string, event_type string")
        names = given.select(F.col("dataset_id").alias("assessment_id"), "dataset_name", F.lit("standard").alias("sensitivity_class")).distinct()
        doc = reads.detail(runs, plan.results(done, "assessment_id"), domains.long_scores(done, "assessment_id"), names, names, audit)
        found.append(sorted(map(str, doc.collect())))
    assert found[0] == found[1] and sum("Score" in r for r in found[0]) > 10


def test_shingles_are_hashed_in_batches_after_the_exchange(spark):
    texts = ["One two, three FOUR five", "one  two", "b a b a b a b", "Ünïcode ँ x y", "...", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    bands = quality.shingle_bands(df.repartition(3), "id", "text")
    steps = bands._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in steps and "split(" not in steps[steps.index("Exchange"):]  # neither interpreted, nor in the scan's tasks
    expected = set()
    for i, words in enumerate(["one two three four five", "one two", "b a b a b a b", "ünïcode x y"]):
        w = words.split()
        hashes = [hashlib.sha256(" ".join(w[j:j + 3]).encode()).hexdigest() for j in range(max(len(w) - 2, 1))]
        least = [min(h[8 * k:8 * k + 8] for h in hashes) for k in range(8)]
        expected |= {(i, b, least[2 * b] + least[2 * b + 1]) for b in range(4)}
    assert {tuple(r) for r in bands.collect()} == expected
    long = " ".join(str(i % 700) for i in range(1000)).encode()
    assert quality.least_digits(3, 7)(long) == quality.least_digits(3)(long)
