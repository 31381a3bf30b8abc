"""Exact, linearly interpolated quantiles whose memory does not grow with the table.

Spark's `percentile` keeps every distinct value of a group in one map. Here
* a single table narrows each quantile to a bracket with mergeable sketches first, and counts
  the bracket to prove it holds the wanted ranks; `percentile` then runs on values clamped to
  the bracket, which keeps the order statistics and bounds the map;
* a grouped table counts values per order-preserving bucket and looks inside the few buckets
  that hold a wanted rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAP_LIMIT = 1_000_000  # most values one `percentile` map may have to hold
SKETCH_K = 4000
SKETCH_MARGIN = 0.005  # rank margin around the estimate; several times the sketch error at k=4000
MERGE_WAYS = 256


def exact_quantiles(df: DataFrame, counts: dict[str, int], probs: Sequence[float],
                    map_limit: int = MAP_LIMIT) -> dict[str, list[float | None]]:
    """Quantiles of double columns. `counts` holds the non-NULL count of each column.

    Only (columns x probs) numbers reach the driver."""
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in counts}
    brackets = {}
    for c, n in counts.items():
        for i, p in enumerate(probs):
            if n > map_limit:
                pos = p * (n - 1)
                brackets[(c, i)] = _Bracket(n, math.floor(pos), math.ceil(pos))
    while True:
        wide = {k: b for k, b in brackets.items() if b.inside > map_limit and b.low != b.high}
        before = {k: (b.low, b.high, b.inside) for k, b in wide.items()}
        if wide:
            _narrow(df, wide, probs)
        if all((b.low, b.high, b.inside) == before[k] for k, b in wide.items()):
            break
    small = [c for c, n in counts.items() if 0 < n <= map_limit]
    if small:  # one group per column, so the columns are finished in parallel
        pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(_q(c)).alias("v")) for c in small])
        found = df.select(F.inline(pairs)).groupBy("c").agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
        out.update({r["c"]: list(r["q"]) for r in found.collect()})
    if brackets:  # values clamped to their bracket are counted first, so one (column, probability) is one bounded map
        held = [F.struct(F.lit(c).alias("c"), F.lit(i).alias("i"), F.when(F.col(_q(c)).isNotNull(), F.greatest(F.least(F.col(_q(c)), F.lit(b.high)), F.lit(b.low))).alias("v"))
                for (c, i), b in brackets.items()]
        counted = df.select(F.inline(F.array(*held))).where(F.col("v").isNotNull()).groupBy("c", "i", "v").agg(F.count(F.lit(1)).alias("n"))
        each = F.percentile("v", F.array(*[F.lit(float(p)) for p in probs]), F.col("n"))
        for r in counted.groupBy("c", "i").agg(each.alias("q")).collect():
            out[r["c"]][r["i"]] = r["q"][r["i"]]
    return out


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class _Bracket:
    """Closed value range that provably holds the two order statistics of one quantile."""

    def __init__(self, n: int, first: int, last: int):
        self.first, self.last = first, last
        self.low, self.high = -math.inf, math.inf
        self.below, self.inside = 0, n

    def holds(self, v: Column) -> Column:
        return v.between(F.lit(self.low), F.lit(self.high))


def _narrow(df: DataFrame, todo: dict, probs: Sequence[float]) -> None:
    keys = list(todo)
    # Quantiles of a column that still share a bracket share its sketch.
    held = {(k[0], todo[k].low, todo[k].high): k for k in keys}
    slot = {h: j for j, h in enumerate(held)}
    at_slot = [slot[(k[0], todo[k].low, todo[k].high)] for k in keys]
    # Sketch per slice of the input partitions, then merge the slices: no reducer sees a sketch per task.
    sketches = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_WAYS)).alias("_slice")).agg(*[
        F.kll_sketch_agg_double(F.when(todo[k].holds(F.col(_q(k[0]))), F.col(_q(k[0]))), F.lit(SKETCH_K)).alias(f"s{j}")
        for j, k in enumerate(held.values())])
    merged = sketches.agg(*[F.kll_merge_agg_double(f"s{j}", F.lit(SKETCH_K)).alias(f"s{j}") for j in range(len(held))])
    wanted = []
    for j, k in enumerate(keys):
        b = todo[k]
        for rank, shift, name in ((b.first, -SKETCH_MARGIN, "a"), (b.last, SKETCH_MARGIN, "z")):
            at = min(1.0, max(0.0, (rank - b.below) / max(1, b.inside - 1) + shift))
            wanted.append(F.kll_sketch_get_quantile_double(f"s{at_slot[j]}", F.lit(at)).alias(f"{name}{j}"))
    ends = merged.select(*wanted).first()
    count = []
    for j, k in enumerate(keys):
        v = F.col(_q(k[0]))
        count += [F.count_if(v < ends[f"a{j}"]).alias(f"b{j}"), F.count_if(v <= ends[f"z{j}"]).alias(f"u{j}")]
    seen = df.agg(*count).first()
    for j, k in enumerate(keys):
        b = todo[k]
        below, upto, end = seen[f"b{j}"], seen[f"u{j}"], b.below + b.inside
        low, high = ends[f"a{j}"], ends[f"z{j}"]
        if below > b.first:  # the estimate overshot: keep the proven end
            low, below = b.low, b.below
        if upto <= b.last:
            high, upto = b.high, end
        b.low, b.high, b.below, b.inside = low, high, below, upto - below


# ---- grouped form ------------------------------------------------------------------------

OCTAVE_STEPS = 1024
SLICES = 1024


def order_bucket(v: Column) -> Column:
    """Integer that never decreases with the value: sign, binary exponent and ten bits of fraction."""
    size = F.least(F.greatest(F.abs(v), F.lit(1e-300)), F.lit(1e300))
    step = F.floor(F.log2(size) * OCTAVE_STEPS).cast("bigint") + 1100 * OCTAVE_STEPS
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, step).otherwise(-step)


def grouped_quantiles(counted: DataFrame, keys: list[str], value: str, count: str,
                      probs: dict[str, float]) -> DataFrame:
    """One row per group with a column per named probability.

    `counted` has one row per (group, value) with its count, so a hot value is already collapsed.
    No task sorts a whole group: ordering happens over buckets, then inside one slice of one bucket."""
    v, n = F.col(value), F.col(count)
    points = counted.where(v.isNotNull()).select(*keys, v.alias("_v"), n.alias("_n"), order_bucket(v).alias("_b"))

    by_bucket = points.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    whole = W.partitionBy(*keys)
    run = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    by_bucket = by_bucket.select(*keys, "_b", "_lo", "_hi", (F.sum("_n").over(run) - F.col("_n")).alias("_before"),
                                 F.sum("_n").over(run).alias("_upto"), F.sum("_n").over(whole).alias("_total"))
    spots = F.array(*[x for p in probs.values() for x in (
        F.floor((F.col("_total") - 1) * F.lit(p)), F.ceil((F.col("_total") - 1) * F.lit(p)))])
    spot = by_bucket.select("*", F.explode(F.array_distinct(spots)).alias("_rank")).where(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_upto")))
    buckets = spot.groupBy(*keys, "_b").agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
                                            F.first("_before").alias("_before"), F.first("_total").alias("_total"),
                                            F.collect_set("_rank").alias("_ranks"))
    # Inside the chosen buckets: equal-width slices, again counted before anything is ordered.
    width = F.col("_hi") - F.col("_lo")
    piece = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * SLICES), F.lit(SLICES - 1))).otherwise(F.lit(0))
    inner = points.join(buckets, [*keys, "_b"]).withColumn("_s", piece.cast("int"))
    in_slice = inner.groupBy(*keys, "_b", "_s").agg(F.sum("_n").alias("_c"))
    run2 = W.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow)
    in_slice = in_slice.select(*keys, "_b", "_s", (F.sum("_c").over(run2) - F.col("_c")).alias("_skip"), "_c")
    ranked = inner.join(in_slice, [*keys, "_b", "_s"])
    start = F.col("_before") + F.col("_skip")
    ranked = ranked.where(F.exists("_ranks", lambda r: (r >= start) & (r < start + F.col("_c"))))
    run3 = W.partitionBy(*keys, "_b", "_s").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranked.select(*keys, "_total", "_ranks", "_v", (start + F.sum("_n").over(run3)).alias("_end"), "_n")
    hit = ranked.select(*keys, "_total", "_v", F.explode(F.filter(
        "_ranks", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_n")))).alias("_rank"))
    picks = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(p)
        picks += [F.max(F.when(F.col("_rank") == F.floor(pos), F.col("_v"))).alias(f"_a_{name}"),
                  F.max(F.when(F.col("_rank") == F.ceil(pos), F.col("_v"))).alias(f"_z_{name}")]
    got = hit.groupBy(*keys).agg(F.first("_total").alias("_total"), *picks)
    out = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(p)
        a, z = F.col(f"_a_{name}"), F.col(f"_z_{name}")
        out.append(F.when(a == z, a).otherwise(a + (z - a) * (pos - F.floor(pos))).alias(name))
    return got.select(*keys, *out)
