"""Further data checks: integrity, coverage, correlation, parity, near copies, text quality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells
from assayframe.session import stored

PAIRS_AT_ONCE = 500
SALTS = 16  # parts of one key in joins with a table of one row a key


def orphan_counts(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(child_rows, orphan_rows, orphan_keys): child values with no parent. Child keys are pre-counted, so a
    hot key is one row in the join."""
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_known", F.lit(True))
    return keys.join(known, "_k", "left").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(F.col("_known").isNull()).alias("orphan_keys"))


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent; rows without a key are not orphans. Only distinct keys are compared, so a hot key
    is one row in that step; the missing keys then pick their rows, each key in `SALTS` parts."""
    keys = child.where(F.col(child_key).isNotNull()).select(child_key).distinct()
    missing = keys.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")
    missing = missing.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = child.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))  # any stable part will do
    return dealt.join(missing, [child_key, "_salt"], "left_semi").select(child.columns)


def dictionary_coverage(columns: DataFrame, dictionary: DataFrame, key: str = "dataset_id", name: str = "column_name") -> DataFrame:
    """(key, columns, described, described_pct): columns that the data dictionary of the dataset lists, case ignored."""
    listed = dictionary.select(key, F.lower(name).alias("_n")).distinct().withColumn("_on", F.lit(True))
    have = columns.select(key, F.lower(name).alias("_n"))
    agg = have.join(listed, [key, "_n"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("columns"), F.count("_on").alias("described"))
    return agg.withColumn("described_pct", cells.pct(F.col("described"), F.col("columns")))


def undescribed(columns: DataFrame, dictionary: DataFrame, key: str = "dataset_id", name: str = "column_name") -> DataFrame:
    listed = dictionary.select(key, F.lower(name).alias("_n"))
    return columns.withColumn("_n", F.lower(name)).join(listed, [key, "_n"], "left_anti").drop("_n")


def correlations(df: DataFrame, names: list[str], label: Column | str | None = None, leak: float = 0.95) -> DataFrame:
    """(left, right, r, leak): Pearson correlation of every pair of named columns, or of each with the label.

    `PAIRS_AT_ONCE` pairs share one pass; only one set of running sums per pair is aggregated."""
    cols = {n: cells.quoted(n).cast("double") for n in names}
    if label is not None:
        target = F.col(label) if isinstance(label, str) else label
        pairs = [(n, "label", cols[n], target.cast("double")) for n in names]
    else:
        pairs = [(a, b, cols[a], cols[b]) for i, a in enumerate(names) for b in names[i + 1:]]
    out = None
    for start in range(0, len(pairs), PAIRS_AT_ONCE):
        part = pairs[start:start + PAIRS_AT_ONCE]
        agg = df.agg(*[F.corr(x, y).alias(f"r{i}") for i, (_, _, x, y) in enumerate(part)])
        items = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.round(F.col(f"r{i}"), 6).alias("r")) for i, (a, b, _, _) in enumerate(part)]
        rows = agg.select(F.inline(F.array(*items)))
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        out = df.sparkSession.createDataFrame([], "left string, right string, r double")
    return out.withColumn("leak", F.coalesce(F.abs("r") >= leak, F.lit(False)))


def parity(df: DataFrame, column: str, reference: dict[str, float] | None = None, tolerance: float = 0.1) -> DataFrame:
    """(group_value, cnt, share, expected, gap, flagged): shares against given shares, or against equal ones."""
    counts = df.where(cells.quoted(column).isNotNull()).groupBy(cells.quoted(column).cast("string").alias("group_value")).agg(
        F.count(F.lit(1)).alias("cnt"))
    sums = counts.agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("groups"))
    wide = counts.select("group_value", "cnt", sums.select("total").scalar().alias("total"), sums.select("groups").scalar().alias("groups"))
    expected = F.lit(1.0) / F.col("groups")
    if reference:
        expected = F.coalesce(F.create_map(*[F.lit(x) for kv in reference.items() for x in kv])[F.col("group_value")], F.lit(0.0))
    wide = wide.withColumn("share", F.round(F.col("cnt") / F.col("total"), 6)).withColumn("expected", F.round(expected, 6))
    wide = wide.withColumn("gap", F.round(F.col("share") - F.col("expected"), 6))
    return wide.select("group_value", "cnt", "share", "expected", "gap", (F.abs("gap") > tolerance).alias("flagged"))


def date_ranges(df: DataFrame) -> DataFrame:
    """(column_name, earliest, latest) of every date or timestamp column."""
    names = [f.name for f in df.schema.fields if cells.is_temporal(f.dataType)]
    aggs = [a for i, n in enumerate(names) for a in (F.min(cells.quoted(n)).alias(f"a{i}"), F.max(cells.quoted(n)).alias(f"z{i}"))]
    items = [F.struct(F.lit(n).alias("column_name"), F.col(f"a{i}").cast("timestamp_ntz").alias("earliest"),
                      F.col(f"z{i}").cast("timestamp_ntz").alias("latest")) for i, n in enumerate(names)]
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def text_quality(df: DataFrame, names: list[str]) -> DataFrame:
    """(column_name, values, invalid, control_chars, replacement_chars, affected): character anomalies of whole texts."""
    aggs, items = [], []
    for i, n in enumerate(names):
        c = cells.quoted(n)
        control, lost = F.regexp_count(c, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")), F.regexp_count(c, F.lit("�"))
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(~F.is_valid_utf8(c)).alias(f"v{i}"),
                 F.coalesce(F.sum(control.cast("bigint")), F.lit(0)).alias(f"c{i}"),
                 F.coalesce(F.sum(lost.cast("bigint")), F.lit(0)).alias(f"r{i}"), F.count_if((control > 0) | (lost > 0)).alias(f"a{i}")]
        items.append(F.struct(F.lit(n).alias("column_name"), F.col(f"n{i}").alias("values"), F.col(f"v{i}").alias("invalid"),
                              F.col(f"c{i}").alias("control_chars"), F.col(f"r{i}").alias("replacement_chars"), F.col(f"a{i}").alias("affected")))
    return df.agg(*aggs).select(F.inline(F.array(*items)))


def text_types(df: DataFrame, free_text_length: float = 50.0) -> DataFrame:
    """(column_name, present, mean_length, two_valued, extended_type) for text columns.

    Two-valued means every value equals the least or the greatest, which needs no distinct count."""
    names = [f.name for f in df.schema.fields if cells.is_text(f.dataType)]
    first = df.agg(*[a for i, n in enumerate(names) for a in (
        F.count(cells.quoted(n)).alias(f"n{i}"), F.avg(F.length(cells.quoted(n))).alias(f"l{i}"),
        F.min(cells.quoted(n)).alias(f"a{i}"), F.max(cells.quoted(n)).alias(f"z{i}"))]).first()
    rest = df.agg(*[F.count_if((cells.quoted(n) != F.lit(first[f"a{i}"])) & (cells.quoted(n) != F.lit(first[f"z{i}"]))).alias(f"o{i}")
                    for i, n in enumerate(names)])
    items = []
    for i, n in enumerate(names):
        mean, differ = first[f"l{i}"], first[f"a{i}"] != first[f"z{i}"]
        two = (F.col(f"o{i}") == 0) & F.lit(bool(differ) and first[f"n{i}"] > 0)
        kind = F.when(F.lit(first[f"n{i}"] == 0), "empty").when(two, "binary").when(F.lit((mean or 0) > free_text_length), "free_text").otherwise("text")
        items.append(F.struct(F.lit(n).alias("column_name"), F.lit(first[f"n{i}"]).cast("bigint").alias("present"),
                              F.round(F.lit(mean).cast("double"), 4).alias("mean_length"), two.alias("two_valued"), kind.alias("extended_type")))
    return rest.select(F.inline(F.array(*items)))


def word_threshold(df: DataFrame, key: str, column: str, least: int = 50) -> DataFrame:
    """(key, words, enough): word count of a description; blank text has none."""
    t = cells.clean(F.col(column))
    words = F.when(t.isNull(), F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))
    return df.select(key, words.alias("words"), (words >= least).alias("enough"))


def declared_vs_detected(facts: DataFrame, key: str = "dataset_id") -> DataFrame:
    """(key, check, declared, detected, mismatch): what the form says against what the profile found."""
    said = F.upper(F.coalesce(F.col("standards_used"), F.lit("")))
    items = []
    for code in ("icd", "snomed", "loinc"):
        flag = f"{code}_codes_present"
        if flag in facts.columns:
            items.append((code, said.contains(code.upper()), cells.yes(F.col(flag))))
    if isinstance(facts.schema["direct_identifiers_present"].dataType, T.ArrayType) if "direct_identifiers_present" in facts.columns else False:
        items.append(("direct_identifiers", F.coalesce(F.size("direct_identifiers_present") > 0, F.lit(False)),
                      cells.yes(F.col("direct_identifiers_detected"))))
    rows = F.array(*[F.struct(F.lit(n).alias("check"), a.alias("declared"), b.alias("detected"), (a != b).alias("mismatch")) for n, a, b in items])
    return facts.select(key, F.inline(rows))


# ---- near copies -----------------------------------------------------------------------

HASHES = 8  # 8 hex digits each out of one SHA-256
BANDS = 4  # two hashes per band


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


BLOCK = 50_000  # shingles of a long text hashed at a time


def least_digits(size: int, block: int = BLOCK):
    """Of a text's words joined by one space each (UTF-8): per hash the least 8 hex digits over the SHA-256 of all shingles.

    Fewer than `size` words are one shingle. Shingles are slices of the joined words, and digests are compared as numbers."""
    import hashlib

    import numpy as np

    def run(words: bytes) -> list[str]:
        gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(words))
        count = max(len(starts) - size + 1, 1)
        ends = ends[min(size, len(ends)) - 1:]
        least = None
        for i in range(0, count, block):
            j = min(i + block, count)
            grams = {words[a:b] for a, b in zip(starts[i:j].tolist(), ends[i:j].tolist())}
            got = np.frombuffer(b"".join([hashlib.sha256(g).digest() for g in grams]), ">u4").reshape(-1, HASHES).min(axis=0)
            least = got if least is None else np.minimum(least, got)
        return [f"{n:08x}" for n in least.tolist()]

    return run


def shingle_bands(df: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(key, band, value): min-hash bands of the word shingles of each whole text.

    A text shorter than one shingle is its own single shingle. Work is row-local until here: words are found by Spark, their
    shingles hashed in batches, since a lambda over them is interpreted shingle by shingle."""
    digits = least_digits(size)

    @F.pandas_udf("array<string>")
    def mins(words: pd.Series) -> pd.Series:
        return words.map(lambda w: digits(w) if w else None)

    hashed = df.select(key, mins(F.array_join(_words(F.col(text)), " ").cast("binary")).alias("_m"))
    per = HASHES // BANDS
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.concat(*[F.col("_m")[i] for i in range(b * per, (b + 1) * per)]).alias("value"))
                      for b in range(BANDS)])
    # rows without words leave last: an earlier filter is pushed to the scan, whose few tasks would then do all the work as well
    return hashed.select(key, F.inline(bands)).where(F.col("value").isNotNull())


def near_copies(df: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(key, copy_of): rows that share a band with a row of smaller key, with the smallest such key.

    Each bucket only learns its least key (a partial aggregation), and every row is compared with that one,
    and no pairs are formed. Heads of shared buckets go to every one of `SALTS` parts, so the rows of a bucket that holds
    a third of the table meet theirs in as many tasks. The bands are computed once and stored."""
    bands = stored(shingle_bands(df, key, text, size), "bands")
    heads = bands.groupBy("band", "value").agg(F.min(key).alias("_head"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    heads = heads.select("band", "value", "_head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = bands.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    hits = dealt.join(heads, ["band", "value", "_salt"]).where(F.col("_head") != F.col(key))
    return hits.groupBy(key).agg(F.min("_head").alias("copy_of"))


def near_copy_share(df: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    copies = near_copies(df, key, text, size).agg(F.count(F.lit(1)).alias("near_copy_rows"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return copies.select(total.alias("rows"), "near_copy_rows").withColumn("near_copy_pct", cells.pct(F.col("near_copy_rows"), F.col("rows")))
