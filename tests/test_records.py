"""Records across line breaks and byte ranges, against Spark's and Python's own readers."""

import csv
import io
import json
import random
from collections import Counter

import pytest

from assayframe.sources import readers, records


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2500", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def value(r):
    return "".join(r.choice('ab,"\n {}[]\\:é') for _ in range(r.randint(0, 40))) if r.random() < 0.7 else "x" * r.randint(0, 2500)


def test_delimited_records_equal_a_plain_reader(small_ranges, tmp_path):
    r = random.Random(3)
    files = {}
    for name in ("one", "two"):
        rows = [["id", "a", "b"]] + [[f"{name}{i}", value(r), value(r) + "\r"] for i in range(200)]
        text = io.StringIO()
        csv.writer(text, lineterminator="\r\n" if name == "two" else "\n").writerows(rows)
        (tmp_path / f"{name}.csv").write_text(text.getvalue().rstrip("\n") if name == "one" else text.getvalue(), newline="")
        files[name] = rows
    found = records.delimited_records(small_ranges, str(tmp_path)).orderBy("path", "start", "nth").collect()
    for name, rows in files.items():
        mine = [x["record"] for x in found if name in x["path"]]
        assert [next(csv.reader(io.StringIO(x, newline=""))) for x in mine] == rows
    assert len({(x["path"], x["start"]) for x in found}) > 30  # many tasks a file


def test_read_delimited_equals_one_task_a_file(small_ranges, tmp_path):
    r = random.Random(5)
    text = io.StringIO()
    rows = [["id", "a", "b"]] + [[str(i), value(r).replace("\\", "/"), r.choice(["N/A", "7", "", "line\nbreak"])] for i in range(150)]
    csv.writer(text, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    (tmp_path / "x.csv").write_text(text.getvalue() + "too,many,cells,here\n", newline="")
    for malformed in (False, True):
        apart = readers.read_csv(small_ranges, str(tmp_path), multi_line="records", malformed=malformed)
        whole = readers.read_csv(small_ranges, str(tmp_path), multi_line=True, malformed=malformed)
        assert apart.dtypes == whole.dtypes
        a, b = ([tuple(x)[:3] for x in df.collect()] for df in (apart, whole))
        assert Counter(a) == Counter(b) and len(a) == 151
    assert readers.ingest(small_ranges, str(tmp_path), "csv", multi_line="records").malformed_rows == 1


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays(small_ranges, tmp_path, indent):
    r = random.Random(7)
    data = [{"id": i, "s": value(r), "n": {"k": [{"y": 1}, {"z": value(r)}]}} for i in range(120)]
    (tmp_path / "x.json").write_text(json.dumps(data, indent=indent, ensure_ascii=bool(indent)))
    found = records.json_records(small_ranges, str(tmp_path)).orderBy("start", "nth").collect()
    assert [json.loads(x["record"]) for x in found] == data
    apart, whole = readers.read_json(small_ranges, str(tmp_path), apart=True), readers.read_json(small_ranges, str(tmp_path))
    assert apart.schema == whole.schema and Counter(map(str, apart.collect())) == Counter(map(str, whole.collect()))


def test_odd_files(small_ranges, tmp_path):
    for name, text in (("empty", ""), ("header", "a,b\n"), ("open", 'a,b\n1,"never closed\n2,x\n'), ("blank", "a,b\n\n1,2\n\n")):
        (tmp_path / f"{name}.csv").write_text(text)
        got = [x["record"] for x in records.delimited_records(small_ranges, str(tmp_path / f"{name}.csv")).orderBy("start", "nth").collect()]
        assert got == {"empty": [], "header": ["a,b"], "open": ["a,b", '1,"never closed\n2,x'], "blank": ["a,b", "1,2"]}[name]
    for text, want in (("[]", []), ("", []), (" [ ] ", []), ('[{"a": "}"}]', [{"a": "}"}])):
        (tmp_path / "x.json").write_text(text)
        assert [json.loads(x["record"]) for x in records.json_records(small_ranges, str(tmp_path / "x.json")).collect()] == want
