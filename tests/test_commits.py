"""Numbered batches: retries, keys across batches, streams that send rows again."""

import json

import pytest
from pyspark.sql import functions as F

from assayframe.session import stored_by
from assayframe.sources import commits
from assayframe.streaming import events as ev
from registered import fixtures

SCHEMA = "id string, k0 string, r int, h0 map<string,int>"


def frame(spark, *rows):
    return spark.createDataFrame([(i, k, r, {"a": r}) for i, k, r in rows], SCHEMA)


def held(spark, path):
    schema = frame(spark).schema
    return sorted(((r["id"], r["k0"], r["r"], r["h0"]["a"], r["batch_no"]) for r in commits.read_store(spark, path, schema).collect()), key=str)


def test_retry_and_repeats(spark, tmp_path):
    path, keys = str(tmp_path / "store"), ["id", "k0"]
    first = frame(spark, ("a", "x", 1), ("a", None, 2), (None, None, 3), ("a", "x", 9), ("a", "x", 1))
    commits.commit_batch(first, path, 0, keys)
    want = [("a", None, 2, 2, 0), ("a", "x", 1, 1, 0), (None, None, 3, 3, 0)]
    assert held(spark, path) == sorted(want, key=str)
    second = frame(spark, ("a", None, 7), (None, None, 7), ("b", "x", 4))
    for number, rows in ((1, second), (1, second), (0, first), (2, frame(spark)), (3, second)):
        commits.commit_batch(rows, path, number, keys)
        assert held(spark, path) == sorted([*want, ("b", "x", 4, 4, 1)], key=str)
    with pytest.raises(commits.RepeatedKeys):
        commits.commit_batch(frame(spark, ("b", "x", 5), ("c", "c", 1)), path, 4, keys, conflicts="raise")
    with pytest.raises(commits.RepeatedKeys):
        commits.commit_batch(frame(spark, ("c", "c", 1), ("c", "c", 2)), path, 4, keys, conflicts="raise")
    assert len(held(spark, path)) == 4
    commits.commit_batch(frame(spark, ("c", "c", 1)), path, 4, keys, conflicts="raise")
    assert len(held(spark, path)) == 5
    with pytest.raises(ValueError, match="batch_no"):
        commits.commit_batch(first.withColumn("batch_no", F.lit(1)), path, 5, keys)


def test_stream_sends_again(spark, tmp_path):
    source, path, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    loads = [[("a", 1), ("b", 2)], [("b", 2), ("c", 3), ("c", 3)], [("a", 1)]]
    for load in loads:
        rows = spark.createDataFrame(load, "log_id string, day int").select("log_id", F.timestamp_seconds(F.col("day") * 86400).alias("event_timestamp"))
        rows.write.mode("append").parquet(source)
        commits.stream_events(ev.read_stream(spark, source, rows.schema), path, mark)
    got = spark.read.parquet(path)
    assert sorted(r["log_id"] for r in got.collect()) == ["a", "b", "c"] and got.select("event_date").distinct().count() == 3


@pytest.mark.parametrize("few", [0, 4, 50_000])
def test_fresh_rows_of_few_and_many_keys(spark, monkeypatch, few):
    """Whatever is broadcast: one row per key that the store lacks, the least JSON of equal keys, NULL and NaN keys like any other."""
    monkeypatch.setattr(commits, "FEW_KEYS", few)
    nan = float("nan")
    ids = [None, nan, 0.0, *range(1, 12)]
    some = [(i, k, f"t{n}") for n, (i, k) in enumerate((i, k) for i in ids for k in (None, "a", "b"))]
    rows = [(None if i is None else float(i), k, t) for i, k, t in some + [(i, k, t + "0") for i, k, t in some[::4]] + [some[3], some[20]]]
    there = [(None, None), (None, "a"), (nan, None), (nan, "b"), (-0.0, "a"), (99.0, "a"), (3.0, None), *[(float(i), "b") for i in range(4, 9)], (5.0, "b")]
    shown = lambda x: "NaN" if x is not None and x != x else x
    gone = {(shown(i), k) for i, k in there}
    want = {}
    for i, k, t in rows:
        key, form = (shown(i), k), json.dumps({"i": shown(i), "k": k, "t": t})
        if key not in gone:
            want[key] = min(want.get(key, (form, t)), (form, t))
    made = spark.createDataFrame(rows, "i double, k string, t string")
    out = commits.fresh_rows(made, spark.createDataFrame(there, "i double, k string"), ["i", "k"])
    got = [((shown(r["i"]), r["k"]), r["t"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((key, t) for key, (_, t) in want.items()), key=str)


@pytest.mark.parametrize("keys", [["id"], ["id", "part"]])
def test_rows_that_lie_by_key_are_not_moved(spark, monkeypatch, keys):
    monkeypatch.setattr(commits, "FEW_KEYS", 3)
    wide = spark.range(200).selectExpr("nullif(id, 7) AS id", "repeat('x', 50) AS text", f"{'array(1, 2, 3)' if len(keys) > 1 else 'array(1)'} AS parts")
    rows = stored_by(wide.repartition(4, "id"), "lying", "id", 4).selectExpr("id", "text", "explode(parts) AS part")
    held = spark.range(0, 200, 2).selectExpr("id", "1 AS part").unionAll(spark.sql("SELECT CAST(NULL AS BIGINT), 1"))
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    with commits.as_they_lie(spark):
        out = commits.fresh_rows(rows, held, keys)
        moved = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in x]
        assert moved and all("hashpartitioning(h0" in x for x in moved)
        left = out.collect()
    spark.conf.set(broadcast, before)
    assert len(left) == len({(r["id"], r["part"]) for r in left}) == (99 if len(keys) == 1 else 499)
    assert not [r for r in left if r["part"] == 1 and (r["id"] is None or r["id"] % 2 == 0)]


def test_stored_by_and_dealt_views_hold_all_rows(spark, sf_dir):
    names = {t.name for t in spark.catalog.listTables()}
    plain, dealt = fixtures.view(spark, sf_dir, "fx_catalog"), fixtures.view(spark, sf_dir, "fx_catalog", by=("o_orderkey", 5))
    kept = stored_by(dealt, "catalog", "dataset_id", 5)
    assert kept.columns == plain.columns and kept.count() == plain.count() > 0
    assert kept.exceptAll(plain).isEmpty() and {t.name for t in spark.catalog.listTables()} == names
    assert "Exchange" not in kept.groupBy("dataset_id").count()._jdf.queryExecution().executedPlan().toString()


def test_text_of_a_number_is_compared_as_the_number(spark, monkeypatch, tmp_path):
    """Result rows lie by a number and are stored by its text: texts that are not how a number is written equal none."""
    made = spark.createDataFrame([(i, None if i is None else str(i), "x") for i in [*range(40), 5, None]], "n bigint, id string, t string")
    rows = stored_by(made.repartition(4, "n"), "typed", "n", 4)
    held = spark.createDataFrame([("1",), ("+2",), (" 3",), ("04",), ("x",), ("6.0",), (None,), *[(str(i),) for i in range(10, 30)]], "id string")
    broadcast = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    for few in (50_000, 3):
        monkeypatch.setattr(commits, "FEW_KEYS", few)
        with commits.as_they_lie(spark):
            out = commits.fresh_rows(rows, held, ["id"], {"id": "n"})
            moved = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hash" in x]
            assert out.columns == ["id", "t"] and all("hashpartitioning(h0" in x for x in moved) and bool(moved) == (few == 3)
            assert sorted(r["id"] for r in out.collect()) == sorted(str(i) for i in range(40) if i != 1 and not 10 <= i < 30)
    spark.conf.set(broadcast, before)
    path = str(tmp_path / "store")
    for number in (0, 1, 1):
        commits.commit_batch(rows, path, number, ["id"], typed={"id": "n"})
        got = spark.read.parquet(path)
        assert got.columns == ["id", "t", "batch_no"] and got.count() == 41 and got.where("batch_no = 1").isEmpty()
