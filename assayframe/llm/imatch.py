"""I-Match fingerprints: hashes of the distinct terms that lie in a band of inverse document frequency, under randomised lexicons.

The lexicon holds the terms that stand in at least `low` and at most `high` of all texts, that is ln(1/high) <= idf <= ln(1/low). A
text's band terms are sorted, and each of `subsets` randomised lexicons gives one hash of those that it holds. A randomised lexicon
is a nest: its level j holds a term with probability 2^-j, decided by a hash of the term and the lexicon's number, and a text
is hashed under the deepest level that still holds one of its terms. So a hash covers one or two terms however long the text is, an edit
breaks only the hashes whose terms it touches, and the likeness of two fingerprints is the share of equal hashes.

Document counts come from a shuffle of all (term, count) pairs. The lexicon goes to every task: each of its terms stands in
`low` of the texts, so it has at most (mean number of distinct terms of a text) / `low` entries, whatever the size of the corpus.
The text that follows comes from one range shuffle by id; where two partitions meet, a second small job joins the last text of
one to the first of the next."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import small_batches, terms, written

LOW, HIGH = 1 / 1000, 1 / 50
SUBSETS = 16
HELD = 600_000  # entries a task sums up before it sends them, and terms it remembers
PART_BYTES = 32 << 20
ONE, EDGE_HEAD, EDGE_TAIL = 0, 1, 2


def code(term: bytes) -> int:
    """64-bit code of a term, signed."""
    x = xxhash.xxh3_64_intdigest(term)
    return x - (1 << 64) if x >> 63 else x


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def sent():
        return pa.RecordBatch.from_arrays([pa.array([code(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(set(terms(text)))
            if len(seen) > HELD:
                yield sent()
                seen.clear()
    yield sent()


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Codes and document counts (code, n) of the terms that stand in at least `low` and at most `high` of the rows, and in two at least.

    Every row counts, null and empty texts too; an empty table gives none."""
    rows = docs.count()
    counts = small_batches(docs).select("text").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= max(2.0, low * rows)) & (F.col("n") <= high * rows))


class Fingerprints:
    """Fingerprints under one lexicon; remembers the place of recent terms, within a bound."""

    def __init__(self, codes: list[int], subsets: int):
        self.codes = np.array(sorted(codes), np.int64)
        self.subsets = subsets
        self.levels = levels(self.codes, subsets)
        self.place = {c: i for i, c in enumerate(self.codes.tolist())}
        self.kept: dict[bytes, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """One 32-bit hash for each lexicon. A text without band terms is hashed over all its terms, one without terms as it stands."""
        kept, found = self.kept, set(terms(text))
        if len(kept) > HELD:
            kept.clear()
        for w in found.difference(kept):
            kept[w] = self.place.get(code(w), -1)
        at = np.array(sorted(i for i in map(kept.__getitem__, found) if i >= 0), np.int64)
        if len(at):
            codes, level = self.codes[at], self.levels[at]
        elif found:
            codes = np.array(sorted(map(code, found)), np.int64)
            level = levels(codes, self.subsets)
        else:
            raw = (text or "").encode("utf-8", "surrogatepass")
            return np.array([xxhash.xxh32_intdigest(raw, r) for r in range(self.subsets)], np.uint32)
        held = (level == level.max(axis=0)).T
        return np.array([xxhash.xxh32_intdigest(codes[here].tobytes(), r) for r, here in enumerate(held)], np.uint32)


def levels(codes: np.ndarray, subsets: int) -> np.ndarray:
    """Deepest level of each randomised lexicon (columns) that holds a term (rows)."""
    with np.errstate(over="ignore"):
        x = codes.astype(np.uint64)[:, None] ^ (np.arange(1, subsets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        low_bit = x & (~x + np.uint64(1))
    return np.where(x == 0, 64, np.log2(np.maximum(low_bit, np.uint64(1)).astype(np.float64))).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes."""
    return float((a == b).mean())


def edited(text: str, after: str) -> str:
    """`text` with its last quarter replaced by as much of the beginning of `after`."""
    cut = len(text) // 4
    return text[:len(text) - cut] + after[:cut]


def _row(prints: Fingerprints, doc_id, text: str, own: np.ndarray, after: str, next_own: np.ndarray) -> tuple:
    other = edited(text, after)
    changed = prints.of(other)
    return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).digest(), own.tobytes(), changed.tobytes(),
            likeness(own, changed), likeness(own, next_own))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH, subsets: int = SUBSETS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of `docs(doc_id, text)`.

    The next document is the next row by doc_id (nulls first), then by a hash of the text; the last row's is the first, and a
    single row follows itself. Null texts are empty texts; equal texts have equal fingerprints, empty ones too; repeated rows
    follow each other and give a row each; further columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    base = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    codes = [r["code"] for r in lexicon(base, low, high).select("code").collect()]
    shared = spark.sparkContext.broadcast(codes)
    kind = dict(base.dtypes)["doc_id"]
    found_kind = f"doc_id {kind}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    # the row's number parts equal rows, so that no key is larger than a partition
    keyed = base.select("doc_id", F.xxhash64("text").alias("t"), F.monotonically_increasing_id().alias("i"), "text")
    line = keyed.repartitionByRange(parts, "doc_id", "t", "i").sortWithinPartitions("doc_id", "t", "i").select("doc_id", "text")
    id_type = line.limit(0).toArrow().schema.field("doc_id").type
    types = [pa.int32(), pa.int64(), id_type, pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
    names = ["kind", "part", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, prints, last = TaskContext.get().partitionId(), Fingerprints(shared.value, subsets), None

        def edge(which, doc_id, text, own):
            return (which, part, doc_id, len(text), None, own.tobytes(), None, None, None, text)

        def sent(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = prints.of(text)
                if last is None:
                    rows.append(edge(EDGE_HEAD, doc_id, text, own))
                else:
                    rows.append((ONE, part, *_row(prints, *last, text, own), None))
                last = (doc_id, text, own)
            if rows:
                yield sent(rows)
        if last is not None:
            yield sent([edge(EDGE_TAIL, *last)])

    done = written(line.mapInArrow(follow, f"kind int, part long, {found_kind}, text string"), "imatch")
    inner = done.where(f"kind = {ONE}").select(*names[2:9])
    heads = done.where(f"kind = {EDGE_HEAD}").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("next_print"))
    tails = done.where(f"kind = {EDGE_TAIL}").select(F.col("part").alias("mine"), "doc_id", "text", "fingerprint")
    # one number per partition that has rows
    order = heads.select("part")
    ring = order.select(F.col("part").alias("mine"), F.lead("part").over(Window.orderBy("part")).alias("next"))
    ring = ring.crossJoin(F.broadcast(order.agg(F.min("part").alias("first")))).select("mine", F.coalesce("next", "first").alias("part"))

    @F.pandas_udf("n_chars long, edited_sha256 binary, edited_fingerprint binary, near_edited double, near_next double")
    def close(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        prints = Fingerprints(shared.value, subsets)
        for texts, own, after, next_own in columns:
            got = [_row(prints, None, t, np.frombuffer(o, np.uint32), a, np.frombuffer(n, np.uint32)) for t, o, a, n in zip(texts, own, after, next_own)]
            yield pd.DataFrame([(r[1], r[2], r[4], r[5], r[6]) for r in got], columns=["n_chars", "edited_sha256", "edited_fingerprint", "near_edited", "near_next"])

    outer = tails.join(ring, "mine").join(heads, "part").select("doc_id", "fingerprint", close("text", "fingerprint", "after", "next_print").alias("x"))
    outer = outer.select("doc_id", "x.n_chars", "x.edited_sha256", "fingerprint", "x.edited_fingerprint", "x.near_edited", "x.near_next")
    both = inner.unionByName(outer)
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
