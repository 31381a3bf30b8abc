"""SimHash near copies: 64-bit fingerprints, linked within a bit distance by BK-trees.

Equal fingerprints collapse first. Of five bit blocks a pair within three bits agrees on at least two, so each pair of
blocks (ten of them, about 26 bits) is a bucket in which the pair meets: the work grows with the buckets, not with the
square of the table. A bucket is dealt into shards of bounded size; each shard's BK-tree goes to one task together with
the fingerprints that must be asked of it, and a search follows only the edges whose distance lies within the radius.
Only a spanning forest of the links leaves a task, so a large group costs rows in proportion to its size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import Sets, components, lower_words, packed, small_batches, written

SEED = 42
SHARD = 4096


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Fingerprint of one text: a bit is 1 if set in over half the shingle hashes; zero without words."""
    words = lower_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(text_column, shingle: int = 3):
    """Column of fingerprints as signed longs."""

    @F.pandas_udf("long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([_signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    return run(text_column)


class BKTree:
    """Children keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.top: list | None = None

    def add(self, x: int) -> None:
        if self.top is None:
            self.top = [x, {}]
            return
        node = self.top
        while True:
            d = (node[0] ^ x).bit_count()
            if d == 0:
                return
            below = node[1].get(d)
            if below is None:
                node[1][d] = [x, {}]
                return
            node = below

    def within(self, x: int, radius: int) -> list[int]:
        found, todo = [], [self.top] if self.top else []
        while todo:
            value, below = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            if below:
                todo += [child for e, child in below.items() if d - radius <= e <= d + radius]
        return found


def _blocks(radius: int) -> tuple[list[int], int]:
    """Masks of the blocks, and how many a pair within the radius shares at least."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:])], 2


def links(fps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Spanning links (u, v) between the distinct fingerprints of `fps(fp)` that differ in at most `radius` bits."""
    masks, share = _blocks(radius)
    keys = [_signed(sum(c)) for c in combinations(masks, share)]
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(keys)])).alias("x")).select("fp", "x.b", "x.key")
    sizes = rows.groupBy("b", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (rows.join(sizes, ["b", "key"])
             .withColumn("shards", F.ceil(F.col("n") / shard).cast("int"))
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
             .withColumn("tree", F.explode(F.sequence("own", F.col("shards") - 1)))
             .select("b", "key", "tree", (F.col("tree") != F.col("own")).alias("asks"), "fp"))
    spread = dealt.repartition("b", "key", "tree").sortWithinPartitions("b", "key", "tree", "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, sets, out = None, None, None, ([], [])

        def done():
            for x in list(sets.up) if sets else ():
                if (r := sets.root(x)) != x:
                    out[0].append(_signed(x))
                    out[1].append(_signed(r))

        for batch in batches:
            d = batch.to_pydict()
            for b, key, t, asks, fp in zip(d["b"], d["key"], d["tree"], d["asks"], d["fp"]):
                if at != (b, key, t):
                    done()
                    at, tree, sets = (b, key, t), BKTree(), Sets()
                x = fp & 0xFFFFFFFFFFFFFFFF
                for y in tree.within(x, radius):
                    sets.join(x, y)
                if not asks:
                    tree.add(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["u", "v"])
                out = ([], [])
        done()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["u", "v"])

    return spread.mapInArrow(search, "u long, v long")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Every row of `docs(doc_id, text)` with its fingerprint and group: doc_id, text_hash, fp, component_id, root.

    The group's id is the least doc_id in it (null only if all are null), its root one of its fingerprints: two groups can share an id that
    stands at two texts, but not a root. Null and empty texts have fingerprint zero and
    link like any other; repeated rows stay repeated rows; an empty table gives no rows; further columns are ignored."""
    marked = written(small_batches(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints(F.col("text"), shingle).alias("fp")), "simhash")
    heads = marked.groupBy("fp").agg(F.min("doc_id").alias("head"))
    roots = components(links(heads.select("fp"), radius), "simhash-groups").withColumnRenamed("node", "fp")
    grouped = heads.join(roots, "fp", "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    low = grouped.groupBy("root").agg(F.min("head").alias("component_id"))
    named = written(grouped.join(low, "root").select("fp", "component_id", "root"), "simhash-named")
    return marked.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each near-copy group, with all columns of `docs`, whatever their names: the least doc_id (nulls last), then the least text
    hash; of fully repeated (doc_id, text) rows one stays. Null and empty texts are one group; an empty table gives no rows."""
    groups = written(near_groups(docs, shingle, radius), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    heads = written(groups.groupBy("root").agg(F.min(order).alias("x")).select("x.doc_id", "x.text_hash"), "simhash-heads")
    rows = groups.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    a, b = rows.alias("a"), heads.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash"))
    acts = written(a.join(b, same, "left").select("a.doc_id", "a.text_hash", "n", F.col("b.text_hash").isNull().alias("drop"))
                   .where("drop or n > 1"), "simhash-acts")
    d = packed(docs, id=F.col("doc_id"), hash=F.xxhash64("text")).alias("d")
    c = acts.alias("c")
    hit = F.col("d.id").eqNullSafe(F.col("c.doc_id")) & F.col("d.hash").eqNullSafe(F.col("c.text_hash"))
    all_rows = d.join(c, hit, "left").select("row", "id", "hash", "n", "drop")
    once = all_rows.where("n is null").select("row.*")
    again = (all_rows.where("n > 1 and not drop")
             .withColumn("k", F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash")))
             .where("k = 1").select("row.*"))
    return once.unionAll(again)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of `docs(doc_id, text)`; nulls, empty texts, repeats and empty tables as in
    `near_groups`."""
    g = near_groups(docs)
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
