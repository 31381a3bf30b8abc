"""Session for tests and benchmarks, and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str, cores: str | None = None, **conf: str) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.master(f"local[{cores}]").appName(name)
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         # Fifteen scorers in one stage make a method too long for the JIT; past this limit Spark
         # evaluates split projections, which do compile.
         .config("spark.sql.codegen.hugeMethodLimit", "8000")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
         .config("spark.sql.warehouse.dir", os.path.join(os.environ.get("TMPDIR", "/tmp"), "assayframe-warehouse")))
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting falls back to a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(os.environ.get("TMPDIR", "/tmp"), "assayframe-shared")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path of its own for one run, inside the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table, written to the shared folder and read again: what follows starts from files, and nothing runs twice."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, key: str, parts: int) -> DataFrame:
    """`stored` in buckets of a key, read again as lying by it: groups and joins by that key move none of its rows.

    Rows that are dealt by the key into as many parts leave one file a bucket. The table's name is dropped at once; its files stay."""
    spark, path, name = df.sparkSession, scratch_path(df.sparkSession, label), f"assayframe_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(parts, key).option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
