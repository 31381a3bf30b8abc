"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are dealt into blocks of bounded size. A block holds, for each query term, its impact list: the documents with the
term, highest impact first, and the place of each document in the list for direct access. Reading goes down all lists of an
item side by side. A document met for the first time is looked up in every list; the places found that way count as seen too.
The best position of a list is the end of its unbroken run of seen places, so it is never above the last place read; no
unseen document can score more than the sum of the impacts at the best positions. A block is done with an item when its kth score lies
strictly above that sum (an equal one could still win by its id), or all lists are read.

Impacts need counts of the whole corpus, so the job runs twice over bounded blocks: postings and counts first, stored, then the search. Only
the k best rows per block and item leave a task."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import small_batches, terms, written

K = 10
BLOCK_DOCS, BLOCK_WORDS = 16_384, 4_000_000
ITEMS = 2000  # items that are searched in one pass
STEP = 32
NAMES = ["n_docs", "n_words", "ids", "lengths", "term", "doc", "tf"]


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def _postings(batches: Iterator[pa.RecordBatch], place: dict[bytes, int], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids in ascending order (nulls last), lengths, and the postings of the query terms."""
    def block(rows):
        rows.sort(key=lambda r: (False, r[0]) if r[0] is not None else (True,))
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[2]) for r in rows])
        term = np.fromiter((t for r in rows for t, _ in r[2]), np.int32, len(doc))
        tf = np.fromiter((c for r in rows for _, c in r[2]), np.int32, len(doc))
        order = np.argsort(term, kind="stable")
        cells = [pa.array([len(rows)], pa.int64()), pa.array([sum(r[1] for r in rows)], pa.int64()), pa.array([[r[0] for r in rows]], pa.list_(id_type)),
                 pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), *(pa.array([a[order]], pa.list_(pa.int32())) for a in (term, doc, tf))]
        return pa.RecordBatch.from_arrays(cells, NAMES)

    rows, words = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = terms(text)
            if not found:
                continue
            count = Counter(found)
            rows.append((doc_id, len(found), [(place[t], count[t]) for t in place.keys() & count.keys()]))
            words += len(found)
            if len(rows) >= BLOCK_DOCS or words >= BLOCK_WORDS:
                yield block(rows)
                rows, words = [], 0
    if rows:
        yield block(rows)


class Block:
    """Impact lists of one block of documents."""

    def __init__(self, ids, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_words: int):
        self.ids, self.size = ids, len(lengths)
        wide = 90 * int(lengths.max(initial=0)) * n_docs >= 1 << 63
        scaled = (90 * lengths.astype(object) * n_docs // n_words).astype(np.int64) if wide else 90 * lengths * n_docs // n_words
        m = 100 - 90 + scaled
        t = tf.astype(np.int64)
        impact = weights[term] * ((1_000_000_000 * t) // (1000 * t + 8 * m[doc]))
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def lists(self, item: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        spans = ((self.start[t], self.start[t + 1]) for t in item)
        return [(self.doc[a:b], self.impact[a:b]) for a, b in spans if b > a]


def best_positions(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int = K, step: int = STEP) -> tuple[list[tuple[int, int]], int]:
    """The k best documents of the lists as (document, score), best first and least document first among equals, and how many
    documents were looked up. `lists` hold documents 0 to size - 1 and their impacts, highest first."""
    total, met = np.zeros(size, np.int64), np.zeros(size, bool)
    seen = [np.zeros(len(docs), bool) for docs, _ in lists]
    place = []
    for docs, _ in lists:
        at = np.full(size, -1, np.int32)
        at[docs] = np.arange(len(docs), dtype=np.int32)
        place.append(at)
    best = [0] * len(lists)
    top = np.zeros(0, np.int64)
    read = 0
    while lists:
        new = np.concatenate([docs[read:read + step] for docs, _ in lists])
        new = np.unique(new[~met[new]])
        met[new] = True
        bound, left = 0, False
        for i, (docs, impact) in enumerate(lists):
            at = place[i][new]
            here = at >= 0
            at = at[here]
            seen[i][at] = True
            total[new[here]] += impact[at]
            rest = seen[i][best[i]:]
            best[i] = len(docs) if rest.all() else best[i] + int(rest.argmin())
            if best[i] < len(docs):
                bound += int(impact[best[i] - 1])
                left = True
        fresh = total[new] * size + (size - 1 - new)
        top = np.concatenate((top, fresh[total[new] > 0]))
        if len(top) > k:
            top = np.partition(top, len(top) - k)[-k:]
        if not left or (len(top) == k and int(top.min()) // size > bound):
            break
        read += step
        step *= 2
    ranked = np.sort(top)[::-1].tolist()
    return [(size - 1 - x % size, x // size) for x in ranked], int(met.sum())


def search(docs: DataFrame, items: DataFrame, k: int = K, items_a_pass: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best rows of `docs(doc_id, text)` for each row of `items(item_id, text)`.

    Null, empty and termless texts match nothing and are not counted; items that match nothing give no rows. Equal scores go by
    ascending doc_id, nulls last; repeated documents are ranked each. Items of equal id and text count once; of one id and different texts each
    is ranked alone. Further columns are ignored; empty tables give no rows. Items are searched `items_a_pass` at a time (as a
    hash deals them); a pass holds their terms in each task."""
    spark = docs.sparkSession
    kinds = {"doc": dict(docs.dtypes)["doc_id"], "item": dict(items.dtypes)["item_id"]}
    id_type = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    item_type = items.select("item_id").limit(0).toArrow().schema.field(0).type
    asked = written(items.select("item_id", "text").where("text is not null").distinct(), "lexical-items")
    passes = max(1, -(-asked.count() // items_a_pass))
    asked = asked.withColumn("pass", F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)))
    base = small_batches(docs).select("doc_id", "text").where("text is not null")
    schema = f"item long, item_id {kinds['item']}, doc_id {kinds['doc']}, score long"
    found = spark.createDataFrame([], schema)
    for number in range(passes):
        rows = [(r["item_id"], sorted(set(terms(r["text"])))) for r in asked.where(F.col("pass") == number).collect()]
        rows.sort(key=lambda r: (r[0] is None, str(r[0]), r[1]))
        place = {t: i for i, t in enumerate(sorted({t for _, ts in rows for t in ts}))}
        wanted = [(x, [place[t] for t in ts]) for x, ts in rows]
        if not place:
            continue
        index = base.mapInArrow(lambda b, place=place: _postings(b, place, id_type),
                                f"n_docs long, n_words long, ids array<{kinds['doc']}>, lengths array<long>, term array<int>, doc array<int>, tf array<int>")
        index = written(index, "lexical-index")
        n_docs, n_words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
        if not n_docs:
            continue
        weights = np.full(len(place), weight(n_docs, 0), np.int64)
        for r in index.select(F.explode("term").alias("t")).groupBy("t").count().collect():
            weights[r["t"]] = weight(n_docs, r["count"])

        def run(batches, weights=weights, wanted=wanted, n_docs=n_docs, n_words=n_words, first=number << 32):
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, lengths, term, doc, tf = (batch.column(c)[i].values for c in range(5))
                    block = Block(ids, *(a.to_numpy().astype(np.int64) for a in (lengths, term, doc, tf)), weights, n_docs, n_words)
                    out = [(j, x, d, s) for j, (x, ts) in enumerate(wanted, first) for d, s in best_positions(block.lists(ts), block.size, k)[0]]
                    item, item_id, at, score = zip(*out) if out else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(item_id, item_type), ids.take(pa.array(at, pa.int64())), pa.array(score, pa.int64())],
                                                     ["item", "item_id", "doc_id", "score"])

        found = found.unionAll(index.select(*NAMES[2:]).mapInArrow(run, schema))
    found = written(found, "lexical-found")
    line = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
