"""Byte-level BPE over whole texts, by the ranks of a public vocabulary file.

Two tiers. A minimal perfect hash over the vocabulary (hash and displace, built once, broadcast: its size is the
vocabulary's, a bound known before) answers every pre-token that is a token itself; the hit is proved by comparing bytes.
Misses run the merges: bytes in a linked list, candidate pairs in a heap by (rank, place)."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import small_batches

DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _spot(a: int, b: int, s: int, n: int) -> int:
    return (((a + s * 0x9E3779B97F4A7C15) * b & 0xFFFFFFFFFFFFFFFF) >> 16) % n


class PerfectHash:
    """Minimal perfect hash of byte strings: n slots for n keys."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.m = m = max(1, n // 4)
        buckets: dict[int, list[tuple[int, int, int]]] = {}
        for i, k in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(k)
            a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64
            buckets.setdefault(a % m, []).append((a, b | 1, i))
        self.shift = [0] * m
        self.slot = [-1] * n
        for at, rows in sorted(buckets.items(), key=lambda x: -len(x[1])):
            s = 0
            while True:
                spots = {_spot(a, b, s, n) for a, b, _ in rows}
                if len(spots) == len(rows) and all(self.slot[p] < 0 for p in spots):
                    break
                s += 1
            self.shift[at] = s
            for a, b, i in rows:
                self.slot[_spot(a, b, s, n)] = i

    def find(self, key: bytes) -> int:
        """Index the key would have; the caller compares the key itself."""
        h = xxhash.xxh3_128_intdigest(key)
        a = h & 0xFFFFFFFFFFFFFFFF
        return self.slot[_spot(a, h >> 64 | 1, self.shift[a % self.m], self.n)]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one pre-token: always the pair of least rank, the leftmost among equals."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into its left neighbour
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(word[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or end[b] != c:
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            r = ranks.get(word[a:end[c]])
            if r is not None:
                heapq.heappush(heap, (r, a, c, end[c]))
        p = before[a]
        if p >= 0:
            r = ranks.get(word[p:c])
            if r is not None:
                heapq.heappush(heap, (r, p, a, c))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one worker; `kept` remembers ids of recent pre-tokens and is bounded."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, pattern: str):
        self.ranks, self.table = ranks, table
        self.keys = list(ranks)
        self.split = regex.compile(pattern).findall
        self.token = dict((i, b) for b, i in ranks.items())
        self.kept: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        kept = self.kept
        if len(kept) > CACHE:
            kept.clear()
        parts = []
        for piece in self.split(text):
            got = kept.get(piece)
            if got is None:
                raw = piece.encode("utf-8")
                i = self.table.find(raw)
                got = [self.ranks[raw]] if self.keys[i] == raw else merge(raw, self.ranks)
                got = kept[piece] = np.array(got, "<u4").tobytes()
            parts.append(got)
        return np.frombuffer(b"".join(parts), "<u4")

    def decode(self, ids) -> bytes:
        token = self.token
        return b"".join([token[i] for i in ids.tolist()])


def codec(spark, path: str, pattern: str):
    """Function that gives a task its codec, from broadcast tables of the vocabulary's size."""
    ranks = load_ranks(path)
    shared = spark.sparkContext.broadcast((ranks, PerfectHash(list(ranks))))
    return lambda: Codec(*shared.value, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "tokens") -> DataFrame:
    """`df` with the token ids of its text as array<int> (null and empty texts: no ids); other columns stay."""
    make = codec(df.sparkSession, path, pattern)

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = make()
        for texts in parts:
            yield pd.Series([c.ids(t or "").astype("int32") for t in texts], dtype=object)

    return small_batches(df).withColumn(into, run(F.col(text)))


def decode(df: DataFrame, path: str, pattern: str, tokens: str = "tokens", into: str = "text") -> DataFrame:
    """`df` with the bytes of its token ids (null ids: empty); the inverse of `encode`."""
    make = codec(df.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = make()
        for rows in parts:
            yield pd.Series([c.decode(np.asarray(r if r is not None else [], "int64")) for r in rows], dtype=object)

    return small_batches(df).withColumn(into, run(F.col(tokens)))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids.

    Null texts are empty ones; repeated rows give repeated results; other columns are ignored."""
    make = codec(docs.sparkSession, path, pattern)

    @F.pandas_udf(DIGEST)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = make()
        for texts in parts:
            rows = []
            for t in texts:
                ids = c.ids(t or "")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": "int64"})

    return small_batches(docs).select("doc_id", run(F.col("text")).alias("x")).select("doc_id", "x.*")
