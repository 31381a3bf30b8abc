"""Removal of repeated word runs over all documents, found by recompression.

Rounds name what stands next to each other: first each maximal run of one word, then, round after round, pairs of a
left-kind and a right-kind symbol, the kind being a bit of the name. A name is a 64-bit mix of the two parts, so every task gives equal
parts the same name without a shared dictionary. Each symbol also carries the span of words that decided it: a window
that contains that span yields the same symbol wherever the window stands. Every window of `size` words therefore picks
one anchor by its own content alone: among the symbols of the highest round whose spans it contains, the least name
(round 0, the words themselves, always gives one).

Spark then brings equal anchors of the whole corpus together, as packed blocks dealt by the anchor's name. An anchor seen
once clears all its windows. Windows that share an anchor form one context (the words they cover); contexts seen twice
are repeats as a whole, and counted inside each chunk of documents before anything travels. A context seen once whose anchor also stands in another context
can still share a window with it; then both have the same words on at least one side of the anchor for half the rest of
the window. Those that do are settled window by window by 128-bit digests of the exact words. Texts meet their spans in one join on a 128-bit
text key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import packed, plain_words, small_batches, written

WINDOW = 35
ROUNDS = 5
CHUNK = 150_000
SHARD_BYTES = 16 << 20
BROADCAST_ROWS = 1_000_000
U = np.uint64
ODD1, ODD2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95
BASES = (0x8F7011EE9A4C2B6D, 0xA24BAED4963EE407)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def name(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    """Name of a pair (or of a run: symbol and length)."""
    return mix(a * U(ODD1) + mix(b + U(kind)))


class Round:
    """Symbols of one round: names, first word of each (`at`) and the span [lo, hi) of words that decided it."""

    def __init__(self, names, doc, lo, hi):
        self.names, self.doc, self.lo, self.hi = names, doc, lo, hi


def _beside(doc):
    """Whether a symbol and the next stand in one document."""
    return doc[:-1] == doc[1:] if len(doc) else np.zeros(0, bool)


def runs(r: Round, kind: int, end: int) -> Round:
    """Name each maximal run of one symbol. What a symbol becomes depends on both neighbours."""
    n = len(r.names)
    if not n:
        return r
    same = _beside(r.doc)
    first = np.concatenate(([True], ~(same & (r.names[1:] == r.names[:-1]))))
    start = np.flatnonzero(first)
    stop = np.concatenate((start[1:], [n]))
    k = stop - start
    names = np.where(k > 1, name(r.names[start], k.astype(U), kind), r.names[start])
    left = np.maximum(start - 1, 0)
    right = np.minimum(stop, n - 1)
    inside_l = (start > 0) & (r.doc[left] == r.doc[start])
    inside_r = (stop < n) & (r.doc[right] == r.doc[start])
    lo = np.where(inside_l, r.lo[left], -1)
    hi = np.where(inside_r, r.hi[right], end + WINDOW * 4)
    return Round(names, r.doc[start], np.minimum(lo, r.lo[start]), np.maximum(hi, r.hi[stop - 1]))


def pairs(r: Round, kind: int, end: int) -> Round:
    """Join each left-kind symbol with a right-kind one after it. A left-kind symbol's fate depends on its right
    neighbour only, a right-kind one's on its left neighbour; a joined pair on nothing more."""
    n = len(r.names)
    if n < 2:
        return r
    bit = (mix(r.names + U(kind)) >> U(40)) & U(1) == 1
    same = _beside(r.doc)
    meet = same & ~bit[:-1] & bit[1:]
    taken = np.concatenate(([False], meet))
    opens = np.concatenate((meet, [False]))
    nxt_hi = np.where(np.concatenate((same, [False])), np.concatenate((r.hi[1:], [0])), end + WINDOW * 4)
    pre_lo = np.where(np.concatenate(([False], same)), np.concatenate(([0], r.lo[:-1])), -1)
    hi = np.where(bit, r.hi, np.maximum(r.hi, nxt_hi))
    lo = np.where(bit, np.minimum(r.lo, pre_lo), r.lo)
    keep = ~taken
    names = r.names.copy()
    at = np.flatnonzero(opens)
    names[at] = name(r.names[at], r.names[at + 1], kind)
    hi[at] = r.hi[at + 1]
    lo[at] = r.lo[at]
    return Round(names[keep], r.doc[keep], lo[keep], hi[keep])


def anchors(words: np.ndarray, doc: np.ndarray, size: int, rounds: int):
    """Windows' anchors of a chunk of whole documents. Returns arrays (first window, last window, symbol, lo, hi) of runs of
    windows that share one anchor occurrence, decided by the words [lo, hi); a window is named by its first word's index."""
    n = len(words)
    ok = np.zeros(n, bool)
    if n >= size:
        ok[:n - size + 1] = doc[:n - size + 1] == doc[size - 1:]
    todo = np.flatnonzero(ok)
    none = np.zeros(0, np.int64)
    if not len(todo):
        return none, none, np.zeros(0, U), none, none
    place = np.arange(n, dtype=np.int64)
    level = [Round(words, doc, place, place + 1)]
    r = runs(level[0], 1, n)
    level.append(r)
    for k in range(rounds):
        r = pairs(r, 16 + k, n)
        level.append(r)
    starts, stops, symbols, los, his = [], [], [], [], []
    for k in range(len(level) - 1, -1, -1):
        r = level[k]
        if not len(todo):
            break
        useful = np.flatnonzero((r.lo >= 0) & (r.hi <= n) & (r.hi - r.lo <= size))
        if not len(useful):
            continue
        lo, hi, names, d = r.lo[useful], r.hi[useful], r.names[useful], r.doc[useful]
        key = mix(names)
        j0 = np.searchsorted(lo, todo, "left")
        j1 = np.searchsorted(hi, todo + size, "right")  # lo and hi both rise along the symbols
        has = j1 > j0
        t, j0, j1 = todo[has], j0[has], j1[has]
        todo = todo[~has]
        if not len(t):
            continue
        best = j0.copy()
        low = key[j0]
        for step in range(1, int((j1 - j0).max())):
            j = np.minimum(j0 + step, j1 - 1)
            v = key[j]
            less = v < low
            best = np.where(less, j, best)
            low = np.where(less, v, low)
        cut = np.concatenate(([True], (best[1:] != best[:-1]) | (t[1:] != t[:-1] + 1)))
        a = np.flatnonzero(cut)
        b = np.concatenate((a[1:], [len(t)])) - 1
        starts.append(t[a])
        stops.append(t[b])
        symbols.append(mix(names[best[a]] + U(k)))
        los.append(lo[best[a]])
        his.append(hi[best[a]])
    return tuple(map(np.concatenate, (starts, stops, symbols, los, his)))


class Spans:
    """Digests of any span of words: sum of hash x base^index, taken relative to the span's start."""

    def __init__(self, words: np.ndarray, base: int):
        n = len(words)
        inverse = pow(base, -1, 1 << 64)
        power = np.concatenate((np.ones(1, U), np.cumprod(np.full(n, base, U))))
        self.back = np.concatenate((np.ones(1, U), np.cumprod(np.full(n, inverse, U))))
        self.sums = np.concatenate((np.zeros(1, U), np.cumsum(words * power[:n], dtype=U)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.back[a])


class Words:
    """Hashes of words; remembers recent ones, within a bound."""

    def __init__(self):
        self.kept: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.kept) > CHUNK:
            self.kept.clear()
        kept, digest = self.kept, xxhash.xxh3_64_intdigest
        for w in set(words).difference(kept):
            kept[w] = digest(w)
        return np.fromiter(map(kept.__getitem__, words), U, len(words))


def _chunks(batches: Iterator[pa.RecordBatch], size: int, extra: int):
    """Chunks of whole documents: (rows of the other columns, words' hashes, document of each word, its first word).
    Texts with fewer words than a window have no window and are left out."""
    seen = Words()
    rows, hashes, total = [], [], 0
    for batch in batches:
        for at in range(batch.num_rows):
            row = tuple(batch.column(i)[at].as_py() for i in range(1 + extra))
            words = plain_words(row[0])
            if len(words) < size:
                continue
            rows.append(row[1:])
            hashes.append(seen.of(words))
            total += len(words)
            if total >= CHUNK:
                yield rows, hashes
                rows, hashes, total = [], [], 0
    if rows:
        yield rows, hashes


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.xxhash64("text").alias("t1")).withColumn("t2", F.xxhash64(F.lit("second"), F.col("text"), F.length("text")))


ENTRY = np.dtype([("s", "<u8"), ("c", "<u8"), ("l", "<u4"), ("r", "<u4"), ("a", "<u4"), ("d", "<u4"), ("n", "<u2"), ("m", "u1")])
NAMES = ["kind", "shard", "rid", "t1", "t2", "a", "n", "m"]
KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
FOUND = "kind int, shard int, rid long, t1 long, t2 long, a int, n int, m int"
TEXT, REPEAT, OPEN, BLOCK = 0, 2, 3, 1


def _table(**columns) -> pa.Table:
    n = max(len(v) for v in columns.values())
    return pa.table({c: pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(NAMES, KINDS)})


def _entries(rows, hashes, size: int, rounds: int) -> np.ndarray:
    """Anchors of one chunk, one entry per context (m: how often, 2 at most), and those that repeat within the chunk."""
    words = np.concatenate(hashes)
    lengths = np.fromiter(map(len, hashes), np.int64, len(hashes))
    doc = np.repeat(np.arange(len(hashes)), lengths)
    first = np.cumsum(lengths) - lengths
    a, b, symbol, lo, hi = anchors(words, doc, size, rounds)
    spans = Spans(words, BASES[0])
    d = doc[a]
    side = (size - (hi - lo) + 1) // 2
    own = mix(np.arange(len(a), dtype=U) + symbol)  # no such words on this side: a value of its own
    left = np.where(lo - side >= first[d], spans.of(np.maximum(lo - side, 0), lo), own)
    right = np.where(hi + side <= first[d] + lengths[d], spans.of(hi, np.minimum(hi + side, len(words))), ~own)
    e = np.empty(len(a), ENTRY)
    e["s"], e["c"], e["l"], e["r"] = symbol, spans.of(a, b + size), (left >> U(32)).astype("u4"), (right >> U(32)).astype("u4")
    e["a"], e["d"], e["n"], e["m"] = a - first[d], d, b - a, 1
    e = e[np.lexsort((e["n"], e["c"], e["s"]))]
    head, at = _classes(e)
    times = np.bincount(at)
    again = e[times[at] > 1]
    one = e[head]
    one["m"] = np.minimum(times, 2)
    return one, again


def _classes(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries the first of each context, and the context's number of every entry."""
    new = np.ones(len(e), bool)
    new[1:] = (e["s"][1:] != e["s"][:-1]) | (e["c"][1:] != e["c"][:-1]) | (e["n"][1:] != e["n"][:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _judge(blobs: list[bytes], rids: list[int]) -> pa.Table:
    """All entries of one shard: contexts that repeat, and contexts that may share windows with another of their anchor."""
    parts = [np.frombuffer(b, ENTRY) for b in blobs]
    e = np.concatenate(parts)
    rid = np.repeat(np.array(rids, np.int64), list(map(len, parts))) + e["d"]
    order = np.lexsort((e["n"], e["c"], e["s"]))
    e, rid = e[order], rid[order]
    head, at = _classes(e)
    times = np.bincount(at, e["m"]).astype(np.int64)
    whole = (times[at] > 1) & (e["m"] == 1)  # those above one were told by their chunk
    top = e[head]
    new = np.ones(len(top), bool)
    new[1:] = top["s"][1:] != top["s"][:-1]
    group = (np.cumsum(new) - 1).astype(np.int64)
    several = np.bincount(group, minlength=1)[group] > 1 if len(top) else np.zeros(0, bool)
    shared = np.zeros(len(top), bool)
    for side in ("l", "r"):
        _, which, count = np.unique((group.astype(U) << U(32)) | top[side], return_inverse=True, return_counts=True)
        shared |= count[which] > 1
    open_ = several & shared
    return pa.concat_tables([
        _table(kind=np.full(whole.sum(), REPEAT, np.int32), rid=rid[whole], a=e["a"][whole].astype(np.int32), n=e["n"][whole].astype(np.int32), m=np.full(whole.sum(), 2, np.int32)),
        _table(kind=np.full(open_.sum(), OPEN, np.int32), rid=rid[head][open_], a=top["a"][open_].astype(np.int32), n=top["n"][open_].astype(np.int32),
               m=np.minimum(times[open_], 2).astype(np.int32))])


def repeated_spans(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Windows that also stand elsewhere, as rows (t1, t2, a, b): in the text with that key the windows starting at
    words a to b. Equal texts share their rows."""
    keyed = _with_key(small_batches(docs))
    shards = max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))

    def find(batches):
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        for rows, hashes in _chunks(batches, size, 2):
            one, again = _entries(rows, hashes, size, rounds)
            n = len(rows)
            numbers = np.arange(rid, rid + n)
            named = _table(kind=np.full(n, TEXT, np.int32), shard=(numbers % shards).astype(np.int32), rid=numbers, t1=[r[0] for r in rows], t2=[r[1] for r in rows])
            told = _table(kind=np.full(len(again), REPEAT, np.int32), shard=((rid + again["d"].astype(np.int64)) % shards).astype(np.int32), rid=rid + again["d"].astype(np.int64),
                          a=again["a"].astype(np.int32), n=again["n"].astype(np.int32), m=np.full(len(again), 2, np.int32))
            for t in (named, told):
                yield from t.append_column("blob", pa.nulls(t.num_rows, pa.binary())).combine_chunks().to_batches()
            place = (one["s"] >> U(11)) % U(shards)
            order = np.argsort(place, kind="stable")
            one, place = one[order], place[order]
            cut = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(one) else np.zeros(0, np.int64)
            blobs = [one[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(one)])]
            t = _table(kind=np.full(len(cut), BLOCK, np.int32), shard=place[cut].astype(np.int32), rid=np.full(len(cut), rid))
            yield from t.append_column("blob", pa.array(blobs, pa.binary())).combine_chunks().to_batches()
            rid += n

    def judge(key, table):
        if key[0].as_py() != BLOCK:
            return table.select(NAMES)
        return _judge(table["blob"].to_pylist(), table["rid"].to_pylist())

    blocks = keyed.select("text", "t1", "t2").mapInArrow(find, FOUND + ", blob binary").repartition(2 * shards, "kind", "shard")
    found = written(blocks.groupBy("kind", "shard").applyInArrow(judge, FOUND), "recompressed")
    texts = found.where(f"kind = {TEXT}").select("rid", "t1", "t2")
    whole = (found.where(f"kind = {REPEAT}").select("rid", "a", "n").join(texts, "rid")
             .select("t1", "t2", "a", (F.col("a") + F.col("n")).alias("b")).distinct())
    open_ = written(found.where(f"kind = {OPEN}").select("rid", F.struct("a", "n", "m").alias("x")).join(texts, "rid")
                    .groupBy("t1", "t2").agg(F.collect_list("x").alias("xs")), "open-contexts")
    ids = open_.select("t1", "t2")
    ids = F.broadcast(ids) if open_.count() <= BROADCAST_ROWS else ids
    one = keyed.select("t1", "t2", "text").join(ids, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))

    def settle(batches):
        seen = Words()
        for batch in batches:
            out = [[] for _ in range(6)]
            for at in range(batch.num_rows):
                text, t1, t2, xs = (batch.column(i)[at].as_py() for i in range(4))
                words = seen.of(plain_words(text))
                at = np.concatenate([np.arange(x["a"], x["a"] + x["n"] + 1) for x in xs])
                m = np.concatenate([np.full(x["n"] + 1, x["m"], np.int64) for x in xs])
                for i, v in enumerate((np.full(len(at), t1), np.full(len(at), t2), Spans(words, BASES[0]).of(at, at + size).view(np.int64),
                                       Spans(words, BASES[1]).of(at, at + size).view(np.int64), at.astype(np.int32), m)):
                    out[i].append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], ["t1", "t2", "k1", "k2", "a", "m"])

    windows = written(one.join(open_, ["t1", "t2"]).select("text", "t1", "t2", "xs")
                      .mapInArrow(settle, "t1 long, t2 long, k1 long, k2 long, a int, m long"), "open-windows")
    twice = windows.groupBy("k1", "k2").agg(F.sum("m").alias("m")).where("m > 1").select("k1", "k2")
    single = windows.join(twice, ["k1", "k2"]).select("t1", "t2", "a", F.col("a").alias("b"))
    return whole.unionAll(single)


def _covered(n: int, spans, size: int) -> np.ndarray:
    """Which of n words stand in a window that starts within one of the spans."""
    edge = np.zeros(n + 1, np.int64)
    if len(spans):
        ab = np.array([(x["a"], x["b"]) for x in spans], np.int64)
        np.add.at(edge, ab[:, 0], 1)
        np.add.at(edge, ab[:, 1] + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _marked(docs: DataFrame, size: int, rounds: int) -> DataFrame:
    """Rows (row, text, spans): the repeated windows of each text, none as null."""
    spans = repeated_spans(docs, size, rounds).groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    keyed = packed(docs, text=F.col("text"), t1=F.xxhash64("text"), t2=F.xxhash64(F.lit("second"), F.col("text"), F.length("text")))
    return keyed.join(spans, ["t1", "t2"], "left").select("row", "text", "spans")


def _each(texts, spans, size):
    for text, found in zip(texts, spans):
        words = plain_words(text)
        drop = _covered(len(words), found if found is not None else [], size)
        yield len(words), int(drop.sum()), b" ".join([w for w, x in zip(words, drop.tolist()) if not x])


def digest(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of `docs(doc_id, text)`.

    Null and empty texts have no words; of two equal long texts both lose every word, as each window stands in the other;
    repeated rows count as different places; further columns are ignored; an empty table gives no rows."""

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spans in parts:
            yield pd.DataFrame([(n, m, hashlib.sha256(kept).hexdigest()) for n, m, kept in _each(texts, spans, size)],
                               columns=["n_words", "n_removed", "kept_sha256"]).astype({"n_words": "int64", "n_removed": "int64"})

    marked = _marked(docs.select("doc_id", "text"), size, rounds)
    return marked.select("row.doc_id", run(F.col("text"), F.col("spans")).alias("x")).select("doc_id", "x.*")


def without_repeats(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """`docs` with the repeated words taken out of the text; texts that lose none stay as they are, null and empty ones too. Other columns stay, whatever
    their names, n_chars (if there) follows a text that loses words; repeated rows lose all words of texts of a window's length or more; an empty table gives no rows."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, spans in parts:
            yield pd.Series([kept.decode("utf-8", "surrogatepass") if m else t for t, (_, m, kept) in zip(texts, _each(texts, spans, size))], dtype=object)

    marked = _marked(docs, size, rounds)
    cut = marked.select("row", F.col("spans").isNotNull().alias("loses"), F.when(F.col("spans").isNull(), F.col("text")).otherwise(run(F.col("text"), F.col("spans"))).alias("left"))

    def column(c):
        if c == "text":
            return F.col("left").alias(c)
        if c == "n_chars":
            return F.when(F.col("loses"), F.length("left").cast(docs.schema[c].dataType)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`")

    return cut.select([column(c) for c in docs.columns])
