"""Rewriting shards: every row once, whatever the numbers of shards, nulls, repeats and column names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayframe.llm import shards

SCHEMA = "doc_id long, text string, size string, shard int, slot string, old_shard int, text_crc32 string, source string"


def rows():
    texts = [None, "", "a", "é" * 50, "same", "same", "long " * 3000] + [f"text {i} " * (i % 37) for i in range(150)] + ["hot"] * 120
    out = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "x"), (3, "é" * 50)] + [(999, "copy")] * 60
    return [(i, t, f"s{i}", 7, "slot", 9, "crc", ["hot", "hot", "b", "c", None][(i or 0) % 5]) for i, t in out]


@pytest.mark.parametrize("old,new", [(3, 5), (5, 3), (4, 2), (4, 4), (1, 6), (6, 1)])
def test_every_row_once(spark, tmp_path, old, new):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    layout = shards.old_layout(docs, old)
    path = str(tmp_path / "shards")
    first = docs.withColumn("part", layout)
    for i in range(old):  # the old layout, as a job of another kind left it
        first.where(F.col("part") == i).drop("part").withColumn("slot_", F.lit(0).cast("long")).write.parquet(f"{path}/shard_={i}")
    before = {i: spark.read.parquet(f"{path}/shard_={i}").count() for i in range(old)}
    done = shards.reshard(docs, layout, old, new, path)
    assert (done.shard, done.slot) == ("shard_", "slot_")
    back = spark.read.schema(f"{SCHEMA}, slot_ long, shard_ int").parquet(path)
    got = back.collect()
    assert Counter(tuple(r)[:8] for r in got) == Counter(rows())
    size = Counter()
    for r in got:
        size[r["shard_"]] += len((r["text"] or "").encode()) + 1
    assert set(size) <= set(range(new)) and max(size.values()) - min(size[i] for i in range(new)) <= 2 * 15_001
    for i in done.changed:
        assert sorted(r["slot_"] for r in got if r["shard_"] == i) == list(range(sum(r["shard_"] == i for r in got)))
    for i in set(range(min(old, new))) - set(done.changed):
        assert spark.read.parquet(f"{path}/shard_={i}").count() == before[i]
    moved = sum(n for i, a in enumerate(done.flow) for j, n in enumerate(a) if i != j)
    supply, room = [sum(a) for a in done.flow], shards.capacities(sum(map(sum, done.flow)), new)
    assert moved == sum(supply) - sum(min(a, b) for a, b in zip(supply, room))


def test_digest(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = shards.digest(docs, 4, 3).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in rows())
    for i in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == i) == list(range(sum(r["shard"] == i for r in got)))
    assert shards.digest(docs.limit(0)).count() == 0
