"""One key with a third of the rows, standing close together in time: the same results, in many tasks."""

import random

import pytest
from pyspark.sql import functions as F

from assayframe.operators import catalog, quality, throttle
from assayframe.sources import files


def _windows(times, span):
    out, opened = {}, None
    for t in sorted(times):
        if opened is None or t >= opened + span:
            opened = t
            out[opened] = 0
        out[opened] += 1
    return out


@pytest.mark.parametrize("fan", [2, 64])
def test_throttle_links_in_a_tree(spark, monkeypatch, fan):
    monkeypatch.setattr(throttle, "FAN", fan)
    rng = random.Random(fan)
    base = 1_700_000_000
    times = {"hot": [rng.randint(0, 3600) for _ in range(1500)], "far": [rng.randint(0, 90_000) for _ in range(1500)],
             "gaps": [d * 86_400 + rng.randint(0, 200) for d in range(20) for _ in range(40)], None: [1, 2, 3, 70, 71], "one": [5]}
    rows = [(k, base + t) for k, ts in times.items() for t in ts]
    df = spark.createDataFrame(rows, "k string, s bigint").select("k", F.timestamp_seconds("s").alias("at"))
    got = throttle.anchored_windows(df, "k", "at", 60, 60).select("k", F.unix_seconds("opened").alias("o"), "attempts").collect()
    for key, ts in times.items():
        assert {r.o: r.attempts for r in got if r.k == key} == {base + o: n for o, n in _windows(ts, 60).items()}


def test_previous_row_of_a_hot_series_within_a_day(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"s{i % 7}", i % 500, i, i * 10) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, tie int, v int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = catalog.with_previous(df, "k", ["t", "tie"], ["v"])
        assert got.columns == ["k", "t", "tie", "v", "prev_v"]
        got = {(r.k, r.t, r.tie): r.prev_v for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, before = {}, {}
    for k, t, tie, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k, t, tie] = before.get(k)
        before[k] = v
    assert got == want


def test_percent_rank_of_bounded_scores(spark):
    df = spark.createDataFrame([(i, None if i == 0 else round(i % 7 / 10, 1)) for i in range(50)], "id int, cqi double")
    got = {r.id: r.percent_rank for r in catalog.with_percent_rank(df).collect()}
    df.createOrReplaceTempView("ranked")
    want = {r.id: r.p for r in spark.sql("SELECT id, round(percent_rank() OVER (ORDER BY cqi), 6) AS p FROM ranked").collect()}
    assert got == want
    assert catalog.with_percent_rank(df.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        catalog.with_percent_rank(spark.range(2000).selectExpr("id", "id * 0.1D AS cqi"))


def test_hot_contents_and_keys(spark):
    rows = [(f"p{i:04}", "same" if i % 3 == 0 else f"text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "path string, text string").select("path", F.col("text").cast("binary").alias("content"))
    copies = files.duplicate_files(files.file_digests(df)).collect()
    assert len(copies) == 299 and {r.first_path for r in copies} == {"p0000"}
    child = spark.createDataFrame([(None if i % 5 == 0 else 7 if i % 3 == 0 else i, i) for i in range(300)], "ref int, id int")
    lost = quality.orphans(child, "ref", spark.range(100).where("id <> 7").selectExpr("int(id) AS key"), "key")
    assert lost.columns == ["ref", "id"]
    assert sorted(r.id for r in lost.collect()) == [i for i in range(300) if i % 5 and (i % 3 == 0 or i > 99 or i == 7)]


def test_hot_bucket_of_near_copies(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text if i % 3 == 0 else " ".join(f"w{i}x{j}" for j in range(30))) for i in range(300)]
    got = quality.near_copies(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    assert {(r.id, r.copy_of) for r in got} == {(i, 0) for i in range(3, 300, 3)}
