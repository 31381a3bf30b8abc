"""Attempt throttle: more than five events of a key inside a 60-second window that opens at the
first event and reopens at the first event after it has closed.

The windows of a key form a chain, so a plain grouped function would walk a whole hot key in one
task. Here each (key, hour) is worked on by itself: first it reports where the chain would leave the
hour for every point at which it could enter; these short tables are composed in blocks of `FAN` hours, and the blocks in blocks
again, so that no task holds more than `FAN` of them; the true entries come back down the same tree; then every hour
counts its windows from its true entry. An hour of one key holds one row per distinct time in it; `chunk_seconds` (at least
the window) makes the pieces smaller."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.functions import fixed
from assayframe.session import stored

CHUNK_SECONDS = 3600
MICROS = 1_000_000
FAN, LEVELS = 64, 3  # chunks in a block, and levels of blocks above the chunks
START, PAST = -(2 ** 62), 2 ** 62  # before and after every time


def _exits(window: int, chunk: int):
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["t"].to_numpy())
        start = int(pdf["chunk"].iloc[0]) * chunk
        n = len(t)
        last = np.arange(n)
        follow = np.searchsorted(t, t + window)
        hop = np.append(np.where(follow < n, follow, last), n)
        while True:  # pointer doubling: every entry point jumps to the last anchor of its chain
            nxt = hop[hop]
            if (nxt == hop).all():
                break
            hop = nxt
        entries = max(1, int(np.searchsorted(t, start + window)))
        entries = min(n, entries + 1)
        ends = t[hop[:entries]] + window
        keep = np.append(ends[1:] != ends[:-1], True)  # last entry of each run with the same exit
        return pd.DataFrame({"k": pdf["k"].iloc[0], "chunk": pdf["chunk"].iloc[0], "entry_upto": t[:entries][keep],
                             "exit": ends[keep], "last_t": t[-1]})
    return run


def _walk(parts, at):
    """Follow window ends `at` (START: nothing open) through the tables of consecutive chunks."""
    import numpy as np

    for p in parts:
        upto, ends, last = p["entry_upto"].to_numpy(), p["exit"].to_numpy(), p["last_t"].iloc[0]
        row = np.minimum(np.searchsorted(upto, at), len(upto) - 1)
        at = np.where(at > last, at, ends[row])  # past the last event: the window stays open
    return at


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """The table of a block of chunks: every entry into its first chunk, and past all of that, with the exit of the last."""
    import numpy as np

    parts = [p.sort_values("entry_upto") for _, p in pdf.groupby("chunk", sort=True)]
    first, rest = parts[0], parts[1:]
    upto, ends, last = first["entry_upto"].to_numpy(), first["exit"].to_numpy(), first["last_t"].iloc[0]
    if rest:
        ends = _walk(rest, ends)
        if last < PAST:  # an entry behind the first chunk's events enters the next one afresh
            upto, ends, last = np.append(upto, PAST), np.append(ends, _walk(rest, np.array([START]))), PAST
    keep = np.append(ends[1:] != ends[:-1], True)
    return pd.DataFrame({"k": pdf["k"].iloc[0], "chunk": pdf["block"].iloc[0], "entry_upto": upto[keep], "exit": ends[keep], "last_t": last})


def _enter(pdf: pd.DataFrame) -> pd.DataFrame:
    """The window end with which each chunk of a block is entered, from that of the block."""
    import numpy as np

    at, out = np.array([int(pdf["opens"].iloc[0])]), []
    for chunk, part in pdf.groupby("chunk", sort=True):
        out.append((pdf["k"].iloc[0], chunk, int(at[0])))
        at = _walk([part.sort_values("entry_upto")], at)
    return pd.DataFrame(out, columns=["k", "chunk", "opens"])


def _count(window: int):
    import numpy as np

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t, n = pdf["t"].to_numpy(), pdf["n"].to_numpy()
        opens = int(pdf["opens"].iloc[0])
        i = int(np.searchsorted(t, opens))
        total = np.concatenate([[0], np.cumsum(n)])
        rows = []
        if i > 0:  # events of the window that was opened in an earlier hour
            rows.append((opens - window, int(total[i])))
        while i < len(t):
            j = int(np.searchsorted(t, t[i] + window))
            rows.append((int(t[i]), int(total[j] - total[i])))
            i = j
        return pd.DataFrame({"k": pdf["k"].iloc[0], "opened": [r[0] for r in rows], "attempts": [r[1] for r in rows]})
    return run


def anchored_windows(events: DataFrame, key: str, at: str, seconds: int = fixed.ATTEMPT_WINDOW_SECONDS,
                     chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """(key, opened, attempts): every window of every key. Equal times are counted before the shuffle."""
    window, chunk = seconds * MICROS, chunk_seconds * MICROS
    kind = events.schema[key].dataType.simpleString()
    t = F.unix_micros(F.col(at).cast("timestamp"))
    points = (events.select(F.col(key).alias("k"), t.alias("t")).groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("chunk", F.floor(F.col("t") / chunk).cast("bigint")))
    table = f"k {kind}, chunk bigint, entry_upto bigint, exit bigint, last_t bigint"
    points = stored(points, "attempt-times")
    levels = [stored(points.select("k", "chunk", "t").groupBy("k", "chunk").applyInPandas(_exits(window, chunk), table), "attempt-exits")]
    block = F.floor(F.col("chunk") / FAN).cast("bigint")
    for _ in range(LEVELS):
        levels.append(stored(levels[-1].withColumn("block", block).groupBy("k", "block").applyInPandas(_compose, table), "attempt-exits"))
    # a key has one top block for every FAN ** LEVELS chunks (30 years of hours); these are walked per key
    entries = levels.pop().withColumn("opens", F.lit(START)).groupBy("k").applyInPandas(_enter, f"k {kind}, chunk bigint, opens bigint")
    while levels:
        above = entries.select(F.col("k").alias("_k"), F.col("chunk").alias("_block"), "opens")
        met = levels.pop().join(above, F.col("k").eqNullSafe(F.col("_k")) & (block == F.col("_block")))
        entries = met.groupBy("k", "_block").applyInPandas(_enter, f"k {kind}, chunk bigint, opens bigint")
    entries = entries.select(F.col("k").alias("_k"), F.col("chunk").alias("_chunk"), "opens")
    met = points.join(entries, F.col("k").eqNullSafe(F.col("_k")) & (F.col("chunk") == F.col("_chunk")))
    windows = met.groupBy("k", "chunk").applyInPandas(
        _count(window), f"k {kind}, opened bigint, attempts bigint")
    whole = windows.groupBy("k", "opened").agg(F.sum("attempts").alias("attempts"))
    return whole.select(F.col("k").alias(key), F.timestamp_micros("opened").alias("opened"), "attempts")


def throttled(events: DataFrame, key: str, at: str, limit: int = fixed.ATTEMPT_LIMIT,
              seconds: int = fixed.ATTEMPT_WINDOW_SECONDS) -> DataFrame:
    """Windows with more than `limit` attempts and how many of them were over it."""
    w = anchored_windows(events, key, at, seconds)
    return w.where(F.col("attempts") > limit).withColumn("rejected", F.col("attempts") - limit)


def tumbling_attempts(events: DataFrame, key: str, at: str, limit: int = fixed.ATTEMPT_LIMIT,
                      seconds: int = fixed.ATTEMPT_WINDOW_SECONDS) -> DataFrame:
    """The cheaper form with fixed windows."""
    w = F.window(F.col(at).cast("timestamp"), f"{seconds} seconds")
    counted = events.groupBy(F.col(key), w.alias("w")).agg(F.count(F.lit(1)).alias("attempts"))
    return counted.where(F.col("attempts") > limit).select(key, F.col("w.start").alias("opened"), "attempts")
