"""Profile operators against brute force on small tables."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayframe.operators import catalog, columns, grouped, headers, quality, quantiles, throttle
from assayframe.operators import rows as rowops
from assayframe.plans import profile
from assayframe.sources import readers


def test_completeness_and_headers(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, None), (float("nan"), "c"), (4.0, "d"), (5.0, "e")], "col_numeric double, col_string string")
    assert profile.profile(df).dataset.first().completeness.overall_pct == 80.0
    found = headers.table_headers(["patient_name", "normal_column", "dob", "lat", "patient id", "c_name"])
    assert found == {"name": ["patient_name"], "phone": [], "id": ["patient id"], "gps": ["lat"], "dob": ["dob"]}


def test_codes(spark):
    df = spark.createDataFrame([("U07.1", "29463-7", "22298006"), ("A09.9", "883-9", "386661006"), (" B97.29 ", "4544-3", "44054006")],
                               "icd_col string, loinc_col string, snomed_col string")
    s = profile.profile(df).dataset.first().standards_detected
    assert (s.icd_columns, s.loinc_columns, s.snomed_columns) == (["icd_col"], ["loinc_col"], ["snomed_col"])


def test_empty_table(spark):
    p = profile.profile(spark.createDataFrame([], "a string, age double")).dataset.first()
    assert (p.shape.rows, p.shape.columns, p.completeness.overall_pct) == (0, 0, 0.0)
    assert (p.duplicates.exact_duplicate_rows, p.schema_consistency.conformant_rows_pct) == (0, 100.0)


def _numbers():
    rng = random.Random(7)
    # a hot value, a wide range and both signs
    return [5.0] * 400 + [rng.gauss(0, 1) * 10 ** rng.randint(-3, 6) for _ in range(800)] + [0.0] * 20


@pytest.mark.parametrize("limit", [10_000, 60])
def test_quantiles_with_and_without_brackets(spark, limit):
    values = _numbers()
    df = spark.createDataFrame([(v, v * 2) for v in values], "a double, b double").repartition(4)
    got = quantiles.exact_quantiles(df, {"a": len(values), "b": len(values)}, [0.25, 0.5, 0.75], map_limit=limit)
    want = pd.Series(values).quantile([0.25, 0.5, 0.75]).tolist()
    assert all(math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(got["a"], want))
    assert all(math.isclose(x, 2 * y, rel_tol=1e-12, abs_tol=1e-12) for x, y in zip(got["b"], want))


def test_grouped_quantiles(spark):
    values = _numbers()
    rows = [("x", v) for v in values] + [("y", 1e9 + i) for i in range(101)] + [("z", 3.0)]
    counted = spark.createDataFrame(rows, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.g: r for r in quantiles.grouped_quantiles(counted, ["g"], "v", "n", {"q1": 0.25, "m": 0.5, "q9": 0.9}).collect()}
    for g in ("x", "y", "z"):
        s = pd.Series([v for k, v in rows if k == g])
        for name, p in (("q1", 0.25), ("m", 0.5), ("q9", 0.9)):
            assert math.isclose(got[g][name], s.quantile(p), rel_tol=1e-12, abs_tol=1e-12), (g, name)


def test_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (1.0, None), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    for method in ("rows", "fingerprint"):
        r = rowops.duplicate_counts(df, method).first()
        assert (r.rows, r.exact_duplicate_rows, r.exact_duplicate_pct) == (4, 2, 50.0)


def test_sample_is_exact_and_small_tables_stay_whole(spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2).repartition(5)
    a = [r.id for r in rowops.sample_rows(df, 300, key=["id"]).collect()]
    b = [r.id for r in rowops.sample_rows(df.repartition(2), 300, key=["id"]).collect()]
    assert len(a) == len(set(a)) == 300 and sorted(a) == sorted(b)
    assert rowops.sample_rows(df, 9000).count() == 5000
    p = profile.profile(df.withColumnRenamed("v", "age"), sample_limit=300).dataset.first()
    assert p.sampled and p.sample_rows == 300 and p.shape.rows == 5000


def test_profile_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 7, "ab"[i % 2], None if i % 3 else float(i)) for i in range(200)], "a int, label string, age double")
    one, many = profile.profile(df.coalesce(1)), profile.profile(df.repartition(9))
    assert one.dataset.first() == many.dataset.first()
    assert sorted(map(str, one.columns.collect())) == sorted(map(str, many.columns.collect()))


def test_grouped_profile_matches_single(spark):
    rows = [("g1", float(i % 13), "ab"[i % 2]) for i in range(60)] + [("g2", None if i % 4 else i / 7, None) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, age double, sex string")
    got = {(r.g, r.column_name): r for r in grouped.profile_by(df, ["g"]).collect()}
    for g in ("g1", "g2"):
        single = {r["name"]: r for r in profile.profile(df.where(F.col("g") == g).drop("g")).columns.collect()}
        for c in ("age", "sex"):
            for a, b in (("missing_count", "missing_count"), ("median", "median"), ("std", "std"), ("outlier_pct", "outlier_pct"), ("mean", "mean")):
                assert got[(g, c)][a] == single[c][b], (g, c, a)


def test_missing_tokens_and_types(spark):
    df = spark.createDataFrame([("1", "N/A", "true", "none"), ("2", "3.5", "FALSE", "NULL"), ("", "1e3", "True", "x")], "a string, b string, c string, d string")
    kinds = readers.infer_kinds(readers.na_to_null(df))
    assert kinds == {"a": "bigint", "b": "double", "c": "boolean", "d": "string"}
    rows = readers.typed(readers.na_to_null(df), kinds).collect()
    assert [r.d for r in rows] == ["none", None, "x"] and [r.c for r in rows] == [True, False, True]


def test_unknown_and_broken_sources(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("not parquet")
    df = readers.read_dataset(spark, str(tmp_path / "x.parquet"), "parquet")
    assert df.columns == [] and profile.profile(df).dataset.first().completeness.overall_pct == 0.0


def _windows(times, span):
    out, opened = {}, None
    for t in sorted(times):
        if opened is None or t >= opened + span:
            opened = t
            out[opened] = 0
        out[opened] += 1
    return out


@pytest.mark.parametrize("chunk", [120, 61, 3600])
def test_throttle_chain_across_chunks(spark, chunk):
    rng = random.Random(3)
    hot = [rng.randint(0, 4000) for _ in range(900)]
    cold = [rng.randint(0, 40000) for _ in range(60)]
    base = 1_700_000_000
    rows = [("hot", base + t) for t in hot] + [("cold", base + t) for t in cold]
    df = spark.createDataFrame(rows, "k string, s bigint").select("k", F.timestamp_seconds("s").alias("at"))
    got = throttle.anchored_windows(df, "k", "at", 60, chunk).select("k", F.unix_seconds("opened").alias("o"), "attempts").collect()
    for key, times in (("hot", hot), ("cold", cold)):
        want = {base + o: n for o, n in _windows(times, 60).items()}
        assert {r.o: r.attempts for r in got if r.k == key} == want


def test_previous_row_across_chunks(spark):
    rows = [("a", i, i * 10) for i in range(50)] + [("b", 3, 1)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    out = catalog.with_previous(df, "k", ["t"], ["v"], F.floor(F.col("t") / 7)).collect()
    assert {(r.k, r.t): r.prev_v for r in out} == {(k, t): (v - 10 if t and k == "a" else None) for k, t, v in rows}


def test_near_copies(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text), (2, text.replace("word7 ", "other ")), (3, " ".join(f"x{i}" for i in range(50))), (4, text.upper()), (5, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: r.copy_of for r in quality.near_copies(df, "id", "t").collect()}
    assert got.get(4) == 1 and 3 not in got and 5 not in got


def test_value_counts_limit(spark):
    df = spark.createDataFrame([(f"v{i % 51}", f"w{i % 50}") for i in range(600)], "wide string, narrow string")
    got = {r["name"]: (r["dtype"], r["unique_values"]) for r in profile.profile(df).columns.collect()}
    assert got == {"wide": ("string", None), "narrow": ("categorical", 50)}
    assert columns.value_counts(df).select("column_name").distinct().collect()[0][0] == "narrow"
