"""Stores that take numbered batches: a batch that comes again replaces itself, a key that is stored is not stored twice."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells
from assayframe.operators import domains as dom
from assayframe.session import stored
from assayframe.sources import sinks

BATCH = "batch_no"
FEW_KEYS = 50_000  # keys that are broadcast; more are joined by shuffle


class RepeatedKeys(ValueError):
    """Rows of a batch whose keys are stored already or stand in it twice."""


def read_store(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every stored row with its batch number; no rows while the store does not exist."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


@contextmanager
def as_they_lie(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside take rows that lie by some of the join's keys as they are; Spark would deal them anew by all of them.
    Shuffle files of a query that ran inside leave the disk with it, and do not wait for the driver's memory to be cleaned."""
    inside = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name) for name in inside}
    for name, value in inside.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _few(keys: DataFrame) -> int:
    return min(keys.limit(FEW_KEYS + 1).count(), FEW_KEYS + 1)


def _not_held(one: DataFrame, there: DataFrame, count: int) -> DataFrame:
    """Rows (k0.., r) whose keys are not in `there` (h0..).

    Only keys are moved: those that both hold are found first and then taken out of the rows. Few are broadcast; the joins of many are
    plain equalities, so that rows which lie by key stay where they are, and only keys with a NULL are compared apart."""
    ks, hs = [f"k{i}" for i in range(count)], [f"h{i}" for i in range(count)]

    def all_of(pairs: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, pairs)

    same = all_of([F.col(k).eqNullSafe(F.col(h)) for k, h in zip(ks, hs)])
    equal = all_of([F.col(k) == F.col(h) for k, h in zip(ks, hs)])

    def lacking(names: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])

    known = _few(there)
    if known <= FEW_KEYS:
        return one.join(F.broadcast(there), same, "left_anti") if known else one
    mine = one.select(*ks)
    both = mine.join(there.hint("merge"), equal, "left_semi").unionAll(
        mine.where(lacking(ks)).join(there.where(lacking(hs)).hint("merge"), same, "left_semi"))
    lost = stored(both.toDF(*hs), "held")
    found = _few(lost)
    if found <= FEW_KEYS:
        return one.join(F.broadcast(lost), same, "left_anti") if found else one
    # files of keys are small, so that Spark would guess them fit to be broadcast
    one = one.join(lost.hint("merge"), equal, "left_anti")
    nulls = lost.where(lacking(hs))
    odd = _few(nulls)
    return one.join(F.broadcast(nulls) if odd <= FEW_KEYS else nulls.hint("merge"), same, "left_anti") if odd else one


def fresh_rows(rows: DataFrame, held: DataFrame, keys: list[str], typed: Mapping[str, str] | None = None) -> DataFrame:
    """One row per key that `held` lacks. Of rows with one key the least in their JSON form stays, so a retry keeps the same
    one; the choice is made map-side, so a hot key does not gather. NULL is a key like any other. `rows` are read several times, for
    their keys and whole.

    `typed`: for a key that is the text of an integer, the column of `rows` that holds the integer. It is compared in its place, so
    that rows may lie by it, and is not returned."""
    typed = typed or {}
    # helper names cannot meet a user's column: rows travel inside one struct
    by = [f"k{i}" for i in range(len(keys))]
    row = rows.select(*[cells.quoted(typed.get(k, k)).alias(b) for k, b in zip(keys, by)],
                      F.struct(*[cells.quoted(c) for c in rows.columns if c not in typed.values()]).alias("r"))
    there = held.select(*[cells.quoted(k).alias(f"h{i}") for i, k in enumerate(keys)])
    for i, k in enumerate(keys):
        if k in typed:  # a stored text that is not how its number is written equals no key
            text, number = F.col(f"h{i}"), F.col(f"h{i}").try_cast(rows.schema[typed[k]].dataType)
            there = there.where(text.isNull() | (number.cast("string") == text)).withColumn(f"h{i}", number)
    # only keys are moved to find those that come twice; rows of other keys are neither grouped nor written as JSON
    found = row.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    twice = stored(found.select(*[F.col(b).alias(f"t{i}") for i, b in enumerate(by)]), "repeated")
    few = _few(twice)
    one = _not_held(row, there, len(keys))
    if few > FEW_KEYS:
        one = one.groupBy(*by).agg(F.min_by("r", F.to_json("r")).alias("r"))
    elif few:
        same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"t{i}")) for i, b in enumerate(by)])
        again = one.join(F.broadcast(twice), same, "left_semi").groupBy(*by).agg(F.min_by("r", F.to_json("r")).alias("r"))
        one = one.join(F.broadcast(twice), same, "left_anti").unionByName(again)
    return one.select("r.*")


def commit_batch(rows: DataFrame, path: str, number: int, keys: list[str], partition_by: tuple[str, ...] = (), conflicts: str = "skip",
                 typed: Mapping[str, str] | None = None) -> None:
    """Store batch `number`. Its folder is replaced, so a retry after a lost driver or executor adds nothing; rows whose keys other batches
    hold are left out (`conflicts="skip"`) or stop the commit before anything is written (`"raise"`). Only key columns of the store are read.

    Batches are committed one at a time, as a stream does. An empty batch leaves an empty folder. `rows` must not have a column `batch_no`. `typed`: see `fresh_rows`."""
    if BATCH in rows.columns or conflicts not in ("skip", "raise"):
        raise ValueError(f"no column may be named {BATCH}" if BATCH in rows.columns else f"conflicts={conflicts!r}")
    kept = rows.drop(*(typed or {}).values())
    held = read_store(rows.sparkSession, path, kept.schema).where(F.col(BATCH) != number)
    with as_they_lie(rows.sparkSession):
        if conflicts == "raise":
            rows = stored(rows, "batch")
            out = stored(fresh_rows(rows, held, keys, typed), "fresh")
            if out.count() < rows.count():
                raise RepeatedKeys(f"batch {number}: keys {keys} are stored already or repeated")
        else:
            out = fresh_rows(rows, held, keys, typed)
        # texts of a store repeat much; zstd halves what Spark's default leaves of them
        out.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(f"{path}/{BATCH}={number}")


def stream_into(stream: DataFrame, path: str, keys: list[str], checkpoint: str, partition_by: tuple[str, ...] = ()) -> None:
    """Drain everything available into a store; the stream's batch numbers make a repeated batch replace itself."""
    def commit(batch: DataFrame, number: int) -> None:
        commit_batch(batch, path, number, keys, partition_by)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(commit).start().awaitTermination()


# ---- the stores of the assessment ------------------------------------------------------

def commit_profiles(profiles: DataFrame, path: str, number: int, conflicts: str = "skip") -> None:
    commit_batch(profiles, path, number, ["dataset_id"], conflicts=conflicts)


def commit_scores(assessed: DataFrame, path: str, number: int, key: str = "assessment_id", conflicts: str = "skip") -> None:
    """One row per assessment and domain."""
    commit_batch(dom.long_scores(assessed, key), path, number, [key, "domain_number"], conflicts=conflicts)


def commit_results(assessed: DataFrame, path: str, number: int, key: str = "assessment_id", conflicts: str = "skip") -> None:
    """One row per assessment, in a folder per release class."""
    whole = isinstance(assessed.schema[key].dataType, T.IntegralType)
    rows = sinks.result_rows(assessed, key, *[F.col(key).alias("_key")] * whole)
    commit_batch(rows, path, number, ["assessment_id"], ("release_classification",), conflicts, {"assessment_id": "_key"} if whole else None)


def commit_reports(reports: DataFrame, path: str, number: int, key: str = "assessment_id", conflicts: str = "skip") -> None:
    commit_batch(reports, path, number, [key], conflicts=conflicts)


def stream_events(events: DataFrame, path: str, checkpoint: str) -> None:
    """Audit events of a stream, one per `log_id`, in a folder per day."""
    stream_into(events.withColumn("event_date", F.to_date("event_timestamp")), path, ["log_id"], checkpoint, ("event_date",))
