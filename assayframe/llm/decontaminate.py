"""Benchmark decontamination: which documents contain a test item, by exact containment of its word shingles.

Containment is |item's shingles in the document| / |item's shingles|, shingles being five lower-case words. Items are
parted by size. An item of n distinct shingles keeps as its sketch the n - ceil(share x n) + 1 least 64-bit hashes
(bottom-k MinHash, k by size): a document that holds the share of its shingles must hold one of the sketch, so no match
is lost, however long the document. Each size class also has a greatest sketch hash; the document's shingles above the greatest
of all classes are dropped in the scan before any join. Candidates are then verified by counting distinct shingles that
agree word by word. Built-in functions only: no Python runs on the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import packed, written

SHINGLE, SHARE = 5, 0.8
BROADCAST_ROWS = 500_000
WORD_EDGE = r"[^\p{L}\p{N}]+"


def words(text):
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD_EDGE), lambda w: w != "")


def shingles(df: DataFrame, keys: list[str], text: str = "text", size: int = SHINGLE) -> DataFrame:
    """Rows (keys..., h, and the shingle's words w0...) of every place; fewer words than `size` make one shingle of the whole
    sequence, no words none."""
    cut = df.select(*keys, words(F.col(text)).alias("_w"))
    rows = cut.select(*keys, "_w", F.posexplode("_w").alias("_i", "_x"))
    rows = rows.where((F.col("_i") <= F.size("_w") - size) | ((F.col("_i") == 0) & (F.size("_w") < size)))
    parts = [F.col("_x").alias("w0")] + [F.get("_w", F.col("_i") + j).alias(f"w{j}") for j in range(1, size)]
    return rows.select(*keys, *parts).withColumn("h", F.xxhash64(*[f"w{j}" for j in range(size)]))


def item_sketches(items: DataFrame, share: float = SHARE, size: int = SHINGLE) -> DataFrame:
    """Distinct shingles of each item: item_id, text key, h, words, n (distinct shingles) and `sketch` (among the least)."""
    keyed = items.select("item_id", F.xxhash64("text").alias("item_key"), "text")
    names = [f"w{j}" for j in range(size)]
    each = shingles(keyed, ["item_id", "item_key"], size=size).distinct()
    grouped = each.groupBy("item_id", "item_key").agg(F.sort_array(F.collect_list(F.struct("h", *names))).alias("xs"))
    n = F.size("xs")
    k = n - F.ceil(n * share) + 1
    return (grouped.select("item_id", "item_key", n.alias("n"), k.alias("k"), F.posexplode("xs").alias("r", "x"))
            .select("item_id", "item_key", "n", F.floor(F.log2("n")).cast("int").alias("size_class"), (F.col("r") < F.col("k")).alias("sketch"), "x.*"))


def contained(docs: DataFrame, items: DataFrame, share: float = SHARE, size: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Pairs (doc_id, text_hash, item_id, n_shingles, n_found, containment) with containment >= share.

    Null or wordless texts and items match nothing; an item of fewer than five words matches a text that is the same
    short sequence; repeated documents (same id and text) give one pair, repeated items likewise; empty tables give no rows;
    other columns are ignored. The items' shingles are broadcast only below `broadcast_rows` counted rows, else joined by shuffle."""
    names = [f"w{j}" for j in range(size)]
    known = written(item_sketches(items, share, size), "benchmark-shingles")
    classes = known.where("sketch").groupBy("size_class").agg(F.max("h").alias("top"), F.count("*").alias("rows"))
    bound = classes.agg(F.max("top"), F.sum("rows")).first()
    top, rows = bound[0], bound[1] or 0
    all_rows = known.count()

    def sized(df, n):
        return F.broadcast(df) if n <= broadcast_rows else df

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    sketch = known.where("sketch").select("h", "item_id", "item_key")
    probe = shingles(keyed, ["doc_id", "text_hash"], size=size).where(F.col("h") <= F.lit(top)).select("doc_id", "text_hash", "h")
    hits = written(probe.join(sized(sketch, rows), "h").select("doc_id", "text_hash", "item_id", "item_key").distinct(), "benchmark-candidates")
    cand = hits.select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).distinct()
    chosen = keyed.join(cand, F.col("doc_id").eqNullSafe(F.col("c_id")) & F.col("text_hash").eqNullSafe(F.col("c_hash")), "left_semi")
    exact = [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in names]
    cond = F.col("d.h") == F.col("k.h")
    for e in exact:
        cond = cond & e
    places = shingles(chosen, ["doc_id", "text_hash"], size=size).alias("d")
    found = places.join(sized(known, all_rows).alias("k"), cond).select("d.doc_id", "d.text_hash", "k.item_id", "k.item_key", "k.n", *[F.col(f"d.{c}") for c in ["h", *names]])
    counted = (found.distinct().groupBy("doc_id", "text_hash", "item_id", "item_key", "n").agg(F.count("*").alias("n_found"))
               .where(F.col("n_found") >= F.ceil(F.col("n") * share)))
    h, c = hits.alias("h"), counted.alias("c")
    both = F.lit(True)
    for x in ("doc_id", "text_hash", "item_id", "item_key"):
        both = both & F.col(f"h.{x}").eqNullSafe(F.col(f"c.{x}"))
    return (c.join(h, both, "left_semi")
            .select("doc_id", "text_hash", "item_id", F.col("n").cast("long").alias("n_shingles"), "n_found", (F.col("n_found") / F.col("n")).alias("containment")).distinct())


def keep_clean(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of `docs` that contain no test item, all columns as they were, whatever their names.

    Null and wordless texts stay; repeated rows stay or go together; without items all rows stay; an empty table gives no rows."""
    bad = contained(docs, items, share).select("doc_id", "text_hash").distinct().alias("b")
    marked = packed(docs, id=F.col("doc_id"), hash=F.xxhash64("text")).alias("d")
    same = F.col("d.id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.hash") == F.col("b.text_hash"))
    return marked.join(bad, same, "left_anti").select("row.*")
