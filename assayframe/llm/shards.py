"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the transfers that move the fewest bytes.

The rows are staged once in the shared folder, each with its place: the task that wrote it and the bytes and rows of its old shard before it in
that task. So each old shard is a line of bytes, task after task. The flow, solved on the driver over shards alone (a table of old x new
numbers), says how many bytes of each old shard go to which new one; the line is cut there. A row goes where its middle falls, so shard sizes
differ from their capacities by at most half a row per cut. Starts in the lines and places in the new shards are sums over tasks: no text is
shuffled, no row is looked up by its content, and equal rows never meet in one group. Shards that change are then written from the staged rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.llm.common import packed, small_batches, written
from assayframe.session import scratch_path

BROADCAST_ROWS = 1_000_000


def capacities(total: int, shards: int) -> list[int]:
    """Near equal sizes that add up to the total."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def min_cost_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Amounts old -> new that place all supply at least cost (successive shortest paths; sum of room >= sum of supply)."""
    n, m = len(supply), len(room)
    flow = [[0] * m for _ in range(n)]
    left, free = list(supply), list(room)
    while any(left):
        # cheapest path from any old shard with bytes left to any new shard with room, over the residual graph
        far = float("inf")
        dist, back = [0 if left[i] else far for i in range(n)] + [far] * m, [None] * (n + m)
        todo = deque(i for i in range(n) if left[i])
        while todo:
            v = todo.popleft()
            steps = [(n + j, cost[v][j]) for j in range(m)] if v < n else [(i, -cost[i][v - n]) for i in range(n) if flow[i][v - n]]
            for w, c in steps:
                if dist[v] + c < dist[w]:
                    dist[w], back[w] = dist[v] + c, v
                    if w not in todo:
                        todo.append(w)
        end = min((n + j for j in range(m) if free[j]), key=lambda w: dist[w])
        path = [end]
        while back[path[-1]] is not None:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], free[end - n], *[flow[w][v - n] for v, w in zip(path, path[1:]) if v >= n] or [left[path[0]]])
        for v, w in zip(path, path[1:]):
            if v < n:
                flow[v][w - n] += amount
            else:
                flow[w][v - n] -= amount
        left[path[0]] -= amount
        free[end - n] -= amount
    return flow


def old_layout(docs: DataFrame, shards: int, key: str = "source"):
    """The layout a job partitioned by `key` leaves: a hash of it decides (null: like any value)."""
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def text_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the task's number, and the bytes and rows of their old shard before them in the task."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    so_far: dict[int, tuple[int, int]] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        old, size = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("old_shard", "size"))
        before, nth = np.zeros(len(old), np.int64), np.zeros(len(old), np.int64)
        for shard in np.unique(old).tolist():
            here = np.flatnonzero(old == shard)
            bytes_, rows = so_far.get(shard, (0, 0))
            ends = bytes_ + np.cumsum(size[here])
            before[here], nth[here] = ends - size[here], rows + np.arange(len(here))
            so_far[shard] = (int(ends[-1]), rows + len(here))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(old), part, np.int32)), pa.array(before), pa.array(nth)],
                                         [*batch.schema.names, "part", "before", "nth"])


def _small(df: DataFrame) -> DataFrame:
    """A stored table of sums per task, broadcast when its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def placed(docs: DataFrame, old, old_shards: int, new_shards: int) -> tuple[DataFrame, list[list[int]]]:
    """Stored rows (row, size, old_shard, part, shard, slot), each row of `docs` as a struct with its new shard and place, and the transfers (bytes
    old -> new).

    Size is the text's UTF-8 bytes (null: none) plus 1. Repeated rows are rows of their own; nothing else of a row matters, so any columns are
    carried along; an empty table gives no rows and no transfers. The driver holds sizes of shards only."""
    start = packed(small_batches(docs), size=text_bytes(F.col("text")) + 1, old_shard=old.cast("int"))
    full = T.StructType([*start.schema.fields, *T.StructType.fromDDL("part int, before bigint, nth bigint").fields])
    rows = written(start.mapInArrow(_numbered, full), "shard-rows")
    sums = rows.groupBy("old_shard", "part").agg(F.sum("size").alias("bytes"))
    line = Window.partitionBy("old_shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = written(sums.withColumn("start", F.coalesce(F.sum("bytes").over(line), F.lit(0))), "shard-heads")
    have = {r["old_shard"]: r["b"] for r in heads.groupBy("old_shard").agg(F.sum("bytes").alias("b")).collect()}
    supply = [have.get(i, 0) for i in range(old_shards)]
    cost = [[int(i != j) for j in range(new_shards)] for i in range(old_shards)]
    flow = min_cost_flow(supply, capacities(sum(supply), new_shards), cost)
    at = F.col("start") + F.col("before") + F.floor(F.col("size") / 2)
    cut = rows.join(_small(heads.drop("bytes")), ["old_shard", "part"]).withColumn("at", at).withColumn("shard", _cut(flow, new_shards))
    runs = cut.groupBy("shard", "old_shard", "part").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    so_far = Window.partitionBy("shard").orderBy("old_shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    runs = written(runs.withColumn("base", F.coalesce(F.sum("n").over(so_far), F.lit(0))).drop("n"), "shard-runs")
    # rows of one old shard and task that go to one new shard stand side by side in the line
    out = cut.join(_small(runs), ["shard", "old_shard", "part"]).withColumn("slot", F.col("base") + F.col("nth") - F.col("first"))
    return out.select("row", "size", "old_shard", "part", "shard", "slot"), flow


def plan(docs: DataFrame, old, old_shards: int, new_shards: int) -> tuple[DataFrame, list[list[int]]]:
    """New shard and place of every row of `placed`, without the row: doc_id, size, text_crc32, old_shard, block, shard, slot; and the transfers."""
    rows, flow = placed(docs.select("doc_id", "text", old.alias("old")), F.col("old"), old_shards, new_shards)
    crc = F.crc32(F.coalesce("row.text", F.lit("")))
    return rows.select("row.doc_id", "size", crc.alias("text_crc32"), "old_shard", F.col("part").alias("block"), "shard", "slot"), flow


def _cut(flow: list[list[int]], new_shards: int):
    """New shard of a row by its place in its old shard's line of bytes: first what stays, then the transfers."""
    out = None
    for i, amounts in enumerate(flow):
        order = sorted((j for j in range(new_shards) if amounts[j]), key=lambda j: (j != i, j))
        end, pick = 0, None
        for j in order:
            end += amounts[j]
            pick = F.when(F.col("at") < end, j) if pick is None else pick.when(F.col("at") < end, j)
        if pick is not None:
            here = pick.otherwise(order[-1])
            out = F.when(F.col("old_shard") == i, here) if out is None else out.when(F.col("old_shard") == i, here)
    return (out if out is not None else F.lit(None)).cast("int")


def affected(flow: list[list[int]]) -> list[int]:
    """Shards whose files change: those that send or receive bytes."""
    return sorted({k for i, amounts in enumerate(flow) for j, n in enumerate(amounts) if i != j and n for k in (i, j)})


@dataclass
class Resharded:
    """What `reshard` did: all rows with their place, the transfers, the shards it wrote, and the names of the shard and slot columns in the files."""

    rows: DataFrame
    flow: list[list[int]]
    changed: list[int]
    shard: str
    slot: str


def _free(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def reshard(docs: DataFrame, old, old_shards: int, new_shards: int, path: str) -> Resharded:
    """Write the shards that change as `path`/shard=N, the user's columns beside `slot`; files of all others stay as they are.

    A shard that loses all its rows, as those beyond the new number do, is left with a file without rows, so nothing is read twice. The rows
    are read from the staged copy: `docs` may be what stands in `path`. Where a user's column is named shard or slot, an underscore is added to
    the name of the helper's. A null text, an empty one, repeated rows and an empty table are as in `placed`."""
    rows, flow = placed(docs, old, old_shards, new_shards)
    todo = affected(flow)
    shard, slot = _free("shard", docs.columns), _free("slot", docs.columns)
    files = rows.select("row.*", F.col("slot").alias(slot), F.col("shard").alias(shard)).where(F.col(shard).isin(todo))
    if todo:
        files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
    for i in todo:
        if i >= new_shards or not any(amounts[i] for amounts in flow):
            files.limit(0).drop(shard).write.mode("overwrite").parquet(f"{path}/{shard}={i}")
    return Resharded(rows, flow, todo, shard, slot)


def rewrite(docs: DataFrame, old, old_shards: int, new_shards: int, path: str) -> list[int]:
    """`reshard`; the numbers of the shards whose files it wrote."""
    return reshard(docs, old, old_shards, new_shards, path).changed


def digest(docs: DataFrame, old_shards: int = 8, new_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard of every row of `docs(doc_id, text, source)` after the shards that change
    were written to the shared folder: their rows come from the new files, those of the others from the staged old ones."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    old = old_layout(docs, old_shards)
    done = reshard(docs.select("doc_id", "text", old.alias("old_shard")), F.col("old_shard"), old_shards, new_shards, path)
    same = done.rows.where(~F.col("shard").isin(done.changed)).select("row.doc_id", "row.text", "row.old_shard", "slot", "shard")
    if done.changed:
        same = same.unionByName(spark.read.schema(same.schema).parquet(path))
    return same.select("doc_id", (text_bytes(F.col("text")) + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"),
                       "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
