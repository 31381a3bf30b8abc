"""The profile put together from partition states against the profile of all rows."""

import random
import statistics

import pytest

from assayframe.plans import incremental as inc

SCHEMA = "day int, v double, w int, name string, kind string, _part string, tags array<string>"


def rows(day, n, seed):
    r = random.Random(seed)
    return [(day, r.choice([None, float("nan"), r.gauss(1e6 + (day or 0), 3)]), r.randrange(50), r.choice(["a", "a", "b", None]), f"k{r.randrange(400)}", None, ["x"]) for _ in range(n)]


def test_parts_equal_whole(spark, tmp_path):
    days = {1: rows(1, 900, 1), 2: rows(2, 40, 2), 3: rows(3, 4000, 3), None: rows(None, 5, 4)}
    path = str(tmp_path / "states")
    frame = lambda *d: spark.createDataFrame([x for k in d for x in days[k]], SCHEMA)
    inc.add_parts(frame(1), "day", path)
    inc.add_parts(spark.createDataFrame(rows(2, 77, 9), SCHEMA), "day", path)
    inc.add_parts(frame(3, None), "day", path)
    inc.add_parts(frame(2), "day", path)  # the second part arrives again with other rows
    found = inc.merged(inc.read_states(spark, path))
    got = {r["column_name"]: r for r in found.collect()}
    every = [x for d in days.values() for x in d]
    assert set(got) == {"v", "w", "name", "kind", "_part"} and all(r["parts"] == 4 and r["rows"] == len(every) for r in got.values())
    v = [x[1] for x in every if x[1] is not None and x[1] == x[1]]
    assert got["v"]["missing_count"] == len(every) - len(v) and (got["v"]["min"], got["v"]["max"]) == (min(v), max(v))
    assert got["v"]["mean"] == pytest.approx(statistics.fmean(v), rel=1e-12) and got["v"]["std"] == pytest.approx(statistics.stdev(v), rel=1e-6)
    assert got["w"]["top_values"] is None and abs(got["w"]["distinct_estimate"] - 50) <= 3
    count = lambda x: sum(r[3] == x for r in every)
    assert [tuple(x) for x in got["name"]["top_values"]] == [("a", count("a")), ("b", count("b"))] and got["name"]["missing_count"] == count(None)
    assert abs(got["kind"]["distinct_estimate"] / 400 - 1) < inc.DISTINCT_ERROR and len(got["kind"]["top_values"]) == 10
    assert got["_part"]["missing_count"] == len(every) and got["_part"]["top_values"] == [] and got["_part"]["distinct_estimate"] == 0
    errors = {r[0]: r[1] for r in inc.rank_errors(frame(*days), found).collect()}
    assert {"v", "w"} <= set(errors) and errors["v"] <= inc.RANK_ERROR and errors["w"] <= inc.RANK_ERROR


def test_empty_and_missing(spark, tmp_path):
    path = str(tmp_path / "states")
    inc.add_parts(spark.createDataFrame([], SCHEMA), "day", path)
    assert inc.merged(inc.read_states(spark, path)).collect() == []
    inc.add_parts(spark.createDataFrame([(1, None, 3, None, "k", None, None)], SCHEMA), "day", path)
    got = {r["column_name"]: r for r in inc.merged(inc.read_states(spark, path)).collect()}
    assert got["v"]["q1"] is None and got["v"]["completeness_pct"] == 0.0 and got["v"]["std"] is None
    assert (got["w"]["median"], got["w"]["std"], got["kind"]["distinct_estimate"]) == (3.0, 0.0, 1)
