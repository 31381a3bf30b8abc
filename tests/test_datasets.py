"""Facts of many datasets in one job against the profile of each dataset alone."""

import random

from assayframe.plans import assess, datasets, profile

SCHEMA = ("site string, age double, bmi double, label string, outcome int, patient_name string, lat double, icd string, code string, fold int, "
          "flag boolean, rows int, cnt string, tags array<string>")
NONE = (None,) * 13


def rows():
    r = random.Random(5)
    out = []
    for i in range(600):
        site = r.choice(["a", "a", "a", "b", "c", None])
        out.append((site, r.choice([None, float("nan"), -1.0, 17.0, 18.0, 60.0, 61.0, 200.0]), r.choice([None, 20.0, 4.0]), None if site == "c" else r.choice(["x", "y", "y"]),
                    r.randrange(4), r.choice(["p", None, None]), r.choice([1.0, None]) if site == "b" else None, r.choice(["U07.1", " A00 ", "no"]) if site != "b" else r.choice(["U07.1", "no", "not"]),
                    r.choice(["123456", "29463-7"]), i % 5, r.choice([True, None]), 1, "n", r.choice([["u"], None])))
    out += [out[3]] * 3 + [("alone", *NONE)] * 2 + [("one", 5.0, *NONE[1:])]
    return out


def plain(row):
    d = row.asDict(recursive=True)
    return {k: v for k, v in d.items() if k not in ("dataset_id", "file")}


def test_each_dataset_as_alone(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = {r["dataset_id"]: r for r in datasets.profile_datasets(df, "site").collect()}
    assert set(got) == {"a", "b", "c", None, "alone", "one"}
    for site, found in got.items():
        alone = df.where(df.site.eqNullSafe(site)).drop("site")
        assert plain(found) == plain(profile.profile(alone).dataset.first()), site
    assert got["c"]["label_columns"]["label_column"] == "label" and got["c"]["label_columns"]["class_distribution"] == {}
    assert not got["alone"]["label_columns"]["binary_label_detected"] and got["alone"]["duplicates"]["exact_duplicate_rows"] == 1


def test_own_columns_files_and_limits(spark):
    one = spark.createDataFrame([(1, "x", 30.0), (1, "y", 70.0), (1, "z", 70.0), (1, "z", 70.0)], "ds int, label string, age double")
    two = spark.createDataFrame([(2, "22298006", 1), (2, None, 0), (2, "9", 1)], "ds int, snomed string, outcome int")
    df = one.unionByName(two, allowMissingColumns=True)
    own = spark.createDataFrame([("1", "label", 7), ("1", "age", 3), ("2", "outcome", 1), ("2", "snomed", 2), ("2", "absent", 3), ("1", "age", 3)], "dataset_id string, column_name string, ord int")
    files = spark.createDataFrame([("1", "one.csv", "CSV", 10), ("2", None, "json", 20)], "dataset_id string, filename string, file_format string, size_bytes int")
    a, b = sorted(datasets.profile_datasets(df, "ds", own, files, class_map_limit=1).collect())
    assert plain(b) == plain(profile.profile(two.drop("ds"), class_map_limit=1).dataset.first()) | {"label_columns": b["label_columns"].asDict()}
    assert b["label_columns"]["label_column"] == "outcome" and b["label_columns"]["binary_label_detected"] and b["label_columns"]["class_distribution"] == {"1": 2}
    assert a["file"]["format"] == "csv" and b["file"]["size_bytes"] == 20 and a["shape"]["columns"] == 2
    assert a["label_columns"]["class_distribution"] == {"z": 2} and a["label_columns"]["class_distribution_truncated"] and a["label_columns"]["imbalance_ratio"] == 2.0
    assert a["age_distribution"]["over_60_pct"] == 75.0 and b["age_distribution"] is None and a["duplicates"]["exact_duplicate_rows"] == 1
    facts = profile.facts_of(datasets.profile_datasets(df, "ds", own, files))
    forms = spark.createDataFrame([("1",), ("2",), ("3",)], "dataset_id string")
    assert {r["dataset_id"]: r["imbalance_ratio"] for r in assess.combine(forms, facts).collect()} == {"1": 2.0, "2": 2.0, "3": None}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert datasets.profile_datasets(none, "site").collect() == []
    only = spark.createDataFrame([("a",), ("a",), (None,)], "site string")
    got = {r["dataset_id"]: r for r in datasets.profile_datasets(only, "site").collect()}
    assert got["a"]["shape"].asDict() == {"rows": 2, "columns": 0} and got[None]["duplicates"]["exact_duplicate_rows"] == 0
