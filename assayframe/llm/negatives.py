"""Hard negatives by shared lists: anchors in clusters, one list of candidates per cluster in the order of an angular bound.

For a cluster with centre c whose members lie within angle b of it, a candidate x at angle t from c has an inner product of at most
|a| |x| cos(max(0, t - b)) with every member a. The candidates are sorted by |x| cos(max(0, t - b)) once per cluster, and every member
walks that list from the top until its answer is certain: its kth best score lies strictly above the bound of all that is left (an equal
one could win by its id), or the bound has fallen below the band it looks in.

Two such walks answer the question: the first finds each anchor's positives, whose scores set the bands; the second finds the negatives in
the bands. Candidates are dealt by hash into shards and anchors into groups, both of bounded size, and a task holds one of each, so copies
of one vector spread like any others. Only the best rows of a shard leave a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import written

POSITIVES, NEGATIVES = 5, 3
EVERY, MOVED, LABELS, SCALE = 50, 7, 10, 256  # anchors' ids, ids whose label moves on by one, labels, integer units of a component
FROM, UPTO = 50, 95  # the band of a negative's score in percent of the positive's
SHARD, GROUP = 16_384, 4096
STEP = 512
ROUNDS = 4


def prepared(rows: DataFrame) -> DataFrame:
    """Rows (rid, vec_id, label, v) that take part: labels moved on where the id says so, components as integers."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    some = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return some.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros, which add nothing to a product."""
    lists = vectors.combine_chunks()
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths.max(initial=0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def clusters(units: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Cluster number of each row: about sqrt(rows / 2) centres, moved to the mean direction of their rows `rounds` times."""
    k = max(1, round((len(units) / 2) ** 0.5))
    centres = units[np.linspace(0, len(units) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, units)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
    return (units @ centres.T).argmax(axis=1)


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.linalg.norm(x, axis=1)
    return x / np.maximum(norm, 1e-300)[:, None], norm


class Shard:
    """Candidates of one shard in the order of their ids (nulls last). A score and a place make one number, so that the greatest numbers
    are the best rows, ties by id."""

    def __init__(self, table: pa.Table):
        ids = table.column("vec_id").to_numpy(zero_copy_only=False).astype(np.float64)
        rid = table.column("rid").to_numpy()
        exact = table.column("vec_id").fill_null(0).to_numpy()
        order = np.lexsort((rid, exact, np.isnan(ids)))
        self.table = table.take(pa.array(order))
        self.rid, self.label = rid[order], table.column("label").to_numpy()[order]
        self.x = matrix(self.table.column("v"))
        self.units, self.norm = _units(self.x.astype(np.float64))
        self.size = len(order)

    def keys(self, scores: np.ndarray, places: np.ndarray) -> np.ndarray:
        return scores * self.size + (self.size - 1 - places)

    def split(self, key):
        return key // self.size, self.size - 1 - key % self.size


def walk(shard: Shard, anchors: np.ndarray, wanted, keep: list[np.ndarray], k: int, low=None) -> int:
    """Fill `keep` (one array (anchor, k) of keys each, lowest first) with the best keys that `wanted(members, places, scores)` marks, and return
    the number of products taken. `low` (anchor, keep) are scores below which a list needs nothing more."""
    width = min(anchors.shape[1], shard.x.shape[1])
    a, x = anchors[:, :width], shard.x[:, :width]
    most = int(np.abs(a).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, width)
    kind = np.float64 if most < 1 << 53 else object
    a, x = a.astype(kind), x.astype(kind)
    units, norm = _units(anchors.astype(np.float64))
    at = clusters(units)
    taken = 0
    for c in range(int(at.max(initial=-1)) + 1):
        active = np.flatnonzero(at == c)
        if not len(active):
            continue
        centre = units[active].sum(axis=0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        spread = np.arccos(np.clip(units[active] @ centre, -1, 1)).max() + 1e-7
        away = np.arccos(np.clip(shard.units[:, :width] @ centre[:width], -1, 1))
        bound = shard.norm * np.cos(np.maximum(0, away - spread))
        line = np.argsort(-bound, kind="stable")
        bound = bound[line]
        start, step = 0, STEP
        while start < shard.size and len(active):
            places = line[start:start + step]
            scores = a[active] @ x[places].T
            scores = scores.astype(np.int64) if kind is np.float64 and most * shard.size < 1 << 61 else np.vectorize(int, otypes=[object])(scores)
            taken += scores.size
            keys = shard.keys(scores, places[None, :])
            for j, mark in enumerate(wanted(active, places, scores)):
                keep[j][active] = np.partition(np.concatenate((keep[j][active], np.where(mark, keys, NONE)), axis=1), -k, axis=1)[:, -k:]
            start += step
            step = min(2 * step, 4096)
            if start < shard.size:
                left = norm[active] * bound[start]
                left = left + np.abs(left) * 1e-9 + 1e-6
                certain = np.ones(len(active), bool)
                for j, best in enumerate(keep):
                    kth = best[active].min(axis=1)
                    sure = (kth != NONE) & (kth // shard.size > left)
                    certain &= sure.astype(bool) if low is None else sure.astype(bool) | (left < low[active, j])
                active = active[~certain]
    return taken


NONE = -(1 << 62)


def _best(size: int, most: int, shard: Shard) -> np.ndarray:
    return np.full((size, most), NONE, object if len(shard.x) and _wide(shard) else np.int64)


def _wide(shard: Shard) -> bool:
    return int(np.abs(shard.x).max(initial=0)) ** 2 * max(1, shard.x.shape[1]) * shard.size >= 1 << 61


def _found(keep: np.ndarray, shard: Shard):
    """(row of keep, place, score) of the keys that were found."""
    row, col = np.nonzero(keep != NONE)
    score, place = shard.split(keep[row, col])
    return row, place.astype(np.int64), score.astype(np.int64)


def _positives(table: pa.Table, k: int) -> pa.Table:
    """The k best candidates of an anchor's own label in this shard, the anchor's own row left out."""
    anchors, shard = _sides(table)
    rid, label = anchors.column("rid").to_numpy(), anchors.column("label").to_numpy()
    keep = [_best(len(rid), k, shard)]

    def wanted(members, places, scores):
        return [(label[members][:, None] == shard.label[places][None, :]) & (rid[members][:, None] != shard.rid[places][None, :])]

    if len(rid) and shard.size:
        walk(shard, matrix(anchors.column("v")), wanted, keep, k)
    row, place, score = _found(keep[0], shard)
    return pa.table({"rid": rid[row], "positive_rid": shard.rid[place], "positive_id": shard.table.column("vec_id").take(pa.array(place)), "positive_score": score})


def _negatives(table: pa.Table, k: int, positives: int, band: tuple[int, int]) -> pa.Table:
    """The k best candidates of other labels in the band of each of an anchor's positives."""
    anchors, shard = _sides(table)
    rid, label = anchors.column("rid").to_numpy(), anchors.column("label").to_numpy()
    low, high = np.full((len(rid), positives), 1, np.int64), np.zeros((len(rid), positives), np.int64)
    for i, scores in enumerate(anchors.column("scores").to_pylist()):
        for j, s in enumerate(scores):
            low[i, j], high[i, j] = -(-band[0] * s // 100), band[1] * s // 100
    low[low > high] = 1 << 61  # nothing can be found
    keep = [_best(len(rid), k, shard) for _ in range(positives)]

    def wanted(members, places, scores):
        other = label[members][:, None] != shard.label[places][None, :]
        for j in range(positives):
            yield other & (scores >= low[members, j][:, None]) & (scores <= high[members, j][:, None])

    if len(rid) and shard.size:
        walk(shard, matrix(anchors.column("v")), wanted, keep, k, low)
    out = []
    for j in range(positives):
        row, place, score = _found(keep[j], shard)
        out.append(pa.table({"rid": rid[row], "nth": np.full(len(row), j, np.int32), "negative_rid": shard.rid[place],
                             "negative_id": shard.table.column("vec_id").take(pa.array(place)), "negative_score": score}))
    return pa.concat_tables(out)


def _sides(table: pa.Table) -> tuple[pa.Table, Shard]:
    asks = table.column("asks").combine_chunks()
    anchors = table.filter(asks)
    return anchors.take(pa.array(np.argsort(anchors.column("rid").to_numpy()))), Shard(table.filter(pc.invert(asks)))


def _met(rows: DataFrame, anchors: DataFrame, shards: int, groups: int) -> DataFrame:
    """Each shard of candidates beside each group of anchors."""
    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n):
        return F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")

    mine = rows.select("rid", "vec_id", "label", "v", F.array().cast("array<long>").alias("scores"), F.lit(False).alias("asks"), dealt(shards).alias("shard"), every(groups).alias("group"))
    asking = anchors.select("rid", "vec_id", "label", "v", "scores", F.lit(True).alias("asks"), every(shards).alias("shard"), dealt(groups).alias("group"))
    return mine.unionAll(asking.select(mine.columns)).groupBy("shard", "group")


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = (FROM, UPTO), shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors among `rows(vec_id, embedding, label)`.

    Rows with a null label or vector, or a null, NaN or infinite component, take no part. Every other row counts for itself, repeated ones too: a copy of
    an anchor's row is another row, and a repeated anchor answers twice. Equal scores go by vec_id, nulls last. Shorter vectors count as filled up with
    zeros. A null vec_id is never an anchor. Further columns are ignored; an empty table gives no rows. Components are held as 64-bit integers."""
    base = written(prepared(rows), "negatives-rows")
    anchors = base.where(F.col("vec_id") % EVERY == 0)
    n, asked = base.agg(F.count("*"), F.count(F.when(F.col("vec_id") % EVERY == 0, 1))).first()
    shards, groups = max(1, -(-n // shard)), max(1, -(-asked // group))
    first = _met(base, anchors.withColumn("scores", F.array().cast("array<long>")), shards, groups).applyInArrow(
        lambda t: _positives(t, positives), "rid long, positive_rid long, positive_id long, positive_score long")
    line = Window.partitionBy("rid").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"), "positive_rid")
    first = first.withColumn("nth", F.row_number().over(line) - 1).where(F.col("nth") < positives)
    first = written(first.select("rid", "nth", "positive_id", "positive_score"), "negatives-positives")
    scores = first.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    second = _met(base, anchors.join(scores, "rid"), shards, groups).applyInArrow(
        lambda t: _negatives(t, negatives, positives, band), "rid long, nth int, negative_rid long, negative_id long, negative_score long")
    line = Window.partitionBy("rid", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"), "negative_rid")
    second = second.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= negatives)
    ids = anchors.select("rid", F.col("vec_id").alias("anchor_id"))
    return (second.join(first, ["rid", "nth"]).join(ids, "rid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
