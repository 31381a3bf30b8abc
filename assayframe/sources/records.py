"""Records of large text files that no line break ends: quoted line breaks in delimited text, objects of a JSON array.

Spark cuts a file into byte ranges, and a range alone cannot tell whether it begins inside quotes. So each range is read once for both
cases: the state in which it ends if it begins outside quotes, and if it begins inside, with the brackets opened on the way. These
summaries, one row a range, are chained by windows over the ranges of a file, which fixes every range's first state. Then the ranges are read again, each
alone: records that begin and end in a range are whole at once, and only the pieces at its two edges are joined with their neighbours. No text
is shuffled but those pieces, so one file is the work of as many tasks as it has ranges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayframe.session import stored

# State after a piece of text: (whether it ends inside quotes, brackets opened less those closed).
Step = Callable[[str, bool], tuple[bool, int]]
_CLOSING = re.compile(r'(?:[^"]|"")*+"')
_STRING_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)
WHOLE, HEAD, REST = 0, 1, 2


def delimited_step(delimiter: str) -> Step:
    """A quote opens a value only where a value begins; two quotes inside are one."""

    def step(line: str, inside: bool) -> tuple[bool, int]:
        if '"' not in line:
            return inside, 0
        at = 0
        while True:
            if inside:
                m = _CLOSING.match(line, at)
                if m is None:
                    return True, 0
                at, inside = m.end(), False
            elif line.startswith('"', at):
                at, inside = at + 1, True
                continue
            at = line.find(delimiter, at)
            if at < 0:
                return False, 0
            at += len(delimiter)

    return step


def json_step(piece: str, inside: bool) -> tuple[bool, int]:
    """Brackets outside strings."""
    if inside:
        m = _STRING_REST.match(piece)
        if m is None:
            return True, 0
        piece = piece[m.end():]
    bare = _STRING.sub("", piece)
    head, opened, _ = bare.partition('"')
    return bool(opened), head.count("{") + head.count("[") - head.count("}") - head.count("]")


def _ranges(batches: Iterator[pa.RecordBatch]):
    """(file, range start, text) of each piece; a task reads a range's pieces one after another."""
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())


def _summaries(step: Step, end: str):
    def run(batches):
        now, out = None, []
        for path, start, text in _ranges(batches):
            if now is None or now[:2] != [path, start]:
                if now:
                    out.append(now)
                now = [path, start, False, 0, True, 0]
            for i in (2, 4):
                now[i], opened = step(text + end, now[i])
                now[i + 1] += opened
        if now:
            out.append(now)
        columns = list(zip(*out)) or [()] * 6
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "start", "out_ends", "out_depth", "in_ends", "in_depth"])

    return run


def _first_states(summaries: DataFrame) -> DataFrame:
    """(path, start, inside, depth) where each range begins: outside quotes and at depth 0 where the file does.

    A range that ends alike in both cases fixes the state; after it only ranges that swap the two cases change it."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("start")
    swaps = F.sum((F.col("out_ends") & ~F.col("in_ends")).cast("long")).over(upto)
    marked = summaries.withColumn("swaps", swaps)
    fixed = F.when(F.col("out_ends") == F.col("in_ends"), F.struct("swaps", F.col("out_ends").cast("long").alias("state")))
    last = F.last(fixed, ignorenulls=True).over(before)
    so_far = F.coalesce(F.max("swaps").over(before), F.lit(0))
    state = F.coalesce(last["state"], F.lit(0)) + so_far - F.coalesce(last["swaps"], F.lit(0))
    known = marked.withColumn("inside", state % 2 == 1)
    depth = F.coalesce(F.sum(F.when(F.col("inside"), F.col("in_depth")).otherwise(F.col("out_depth"))).over(before), F.lit(0))
    return known.select("path", "start", "inside", depth.alias("depth"))


def _pieces(step: Step, end: str, level: int):
    """Records (path, start, nth, kind, record) of ranges whose first state is known; a record ends outside quotes at depth `level`."""
    def run(batches):
        key, nth, inside, depth, held, joins = None, 0, False, 0, [], False
        out: list[tuple] = []

        def say(kind):
            nonlocal nth, held
            out.append((*key, nth, kind, "".join(held)))
            nth, held = nth + 1, []

        def sent():
            columns = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()])],
                                              ["path", "start", "nth", "kind", "record"])

        for batch in batches:
            for path, start, text, first_inside, first_depth in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if key != (path, start):
                    if held:
                        say(REST if joins else HEAD)
                    key, nth, inside, depth = (path, start), 0, first_inside, first_depth
                    joins = inside or depth > level
                held.append(text + end)
                inside, opened = step(held[-1], inside)
                depth += opened
                if not inside and depth == level:
                    say(REST if joins else WHOLE)
                    joins = False
            yield sent()
        if held:
            say(REST if joins else HEAD)
        yield sent()

    return run


def _records(spark: SparkSession, path: str, step: Step, end: str, level: int) -> DataFrame:
    text = spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    summaries = text.mapInArrow(_summaries(step, end), "path string, start long, out_ends boolean, out_depth long, in_ends boolean, in_depth long")
    states = _first_states(stored(summaries, "text-ranges"))
    # one row a range of the input, a hundred-millionth of its bytes
    known = text.join(F.broadcast(states), ["path", "start"]).select("path", "start", "value", "inside", "depth")
    found = stored(known.mapInArrow(_pieces(step, end, level), "path string, start long, nth long, kind int, record string"), "text-records")
    edges = found.where(F.col("kind") != WHOLE)
    line = Window.partitionBy("path").orderBy("start", "nth")
    edges = edges.withColumn("number", F.sum((F.col("kind") == HEAD).cast("int")).over(line))
    parts = F.sort_array(F.collect_list(F.struct("start", "nth", "record")))
    joined = edges.groupBy("path", "number").agg(parts.alias("parts")).select(
        "path", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["nth"].alias("nth"), F.array_join(F.transform("parts", lambda x: x["record"]), "").alias("record"))
    return found.where(F.col("kind") == WHOLE).select("path", "start", "nth", "record").unionByName(joined)


def delimited_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Rows (path, start, nth, record): each record of delimited text, with its line breaks inside quotes and without the one that ends it; the header line of a
    file is its first record. Blank records are left out; an unclosed quote runs to the end of the file. No file gives no rows."""
    found = _records(spark, path, delimited_step(delimiter), "\n", 0)
    return found.withColumn("record", F.regexp_replace("record", r"\r?\n\z", "")).where("record <> ''")


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, start, nth, record): each object of a top-level array of objects, its text as it stands. What stands between the objects is left out; an
    object that the file's end cuts off is a record too."""
    found = _records(spark, path, json_step, "}", 1)
    return found.withColumn("record", F.regexp_replace("record", r"^[\s,\[\]]+", "")).where("record rlike '^[^}]'")
