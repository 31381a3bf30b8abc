"""Numbers and ranks cut into ranges against one sorted list."""

import random

from pyspark.sql import functions as F

from assayframe.operators import numbering


def test_numbers_and_ranks(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, 7.0, 7.0, 7.0, r.random()]), "x", r.choice([{"a": 1}, None])) for i in range(3000)] + [(1, 7.0, "x", None)] * 2
    df = spark.createDataFrame(rows, "id int, `_at` double, _v string, `the map` map<string,int>").repartition(5)
    got = numbering.with_row_number(df, [F.col("_at").asc_nulls_last(), F.col("id").desc()]).collect()
    assert sorted(x["row_no"] for x in got) == list(range(1, len(rows) + 1))
    got.sort(key=lambda x: x["row_no"])
    key = lambda x: (x[1] is None, x[1] or 0.0, -x[0])
    assert [key(x) for x in got] == sorted(map(key, rows)) and sorted(map(str, (x[:4] for x in map(tuple, got)))) == sorted(map(str, rows))
    ranked = numbering.with_ranks(df, "_at").collect()
    values = [x[1] if x[1] is not None else -1.0 for x in rows]
    below = {v: sum(w < v for w in values) for v in set(values)}
    assert len(ranked) == len(rows)
    for x in ranked:
        b = below[x["_at"] if x["_at"] is not None else -1.0]
        assert x["rank"] == b + 1 and abs(x["percent_rank"] - b / (len(rows) - 1)) < 1e-6


def test_small(spark):
    none = spark.createDataFrame([], "v int")
    assert numbering.with_row_number(none, [F.col("v")]).count() == 0 and numbering.with_ranks(none, "v").count() == 0
    one = spark.createDataFrame([(None, 5)], "v int, row_no int")
    assert numbering.with_row_number(one, [F.col("v")]).collect() == [(None, 1)]
    assert [tuple(x) for x in numbering.with_ranks(one, "v").collect()] == [(None, 5, 1, 0.0)]


def test_codes_among_first(spark):
    from assayframe.operators import columns

    df = spark.createDataFrame([(i, "A09.9" if i < 500 else "no", None if i % 2 else "123456", None, i) for i in range(2000)], "id int, a string, b string, c string, n int").repartition(7)
    got = {r["column_name"]: r for r in columns.standards_in_order(df, ["id"]).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"]["icd_matches"] == 500 and got["a"]["icd_detected"] and got["b"]["judged"] == 500 and got["b"]["snomed_detected"]
    assert got["c"]["judged"] == 0 and not got["c"]["icd_detected"]
    assert not next(r for r in columns.standards_in_order(df, ["id"], 1500).collect() if r["column_name"] == "a")["icd_detected"]
    assert columns.standards_in_order(df.select("id"), ["id"]).count() == 0
