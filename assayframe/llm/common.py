"""Helpers shared by the operators: words, row keys, written tables, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.session import scratch_path

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8, unchanged; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


# Bytes of a term: ASCII letters and digits (A-Z in lower case) and everything beyond ASCII; all others part terms.
TERM_BYTES = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` as UTF-8, A-Z in lower case; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def small_batches(df: DataFrame, rows: int = 1000, size: int = 16 << 20) -> DataFrame:
    """`df`, its session sending at most `rows` rows and about `size` bytes (one row at least) to a Python worker at once: texts can be long and memory is not.

    Both are settings of the session that plans the job, so they hold for it from here on; smaller ones are kept."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = _bytes(conf.get(name))
        if not 0 < now <= most:
            conf.set(name, str(most))
    return df


def _bytes(setting: str) -> int:
    """Value of a setting such as 10000, 64m or 16777216b."""
    number = setting.lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30, "t": 40}.get(number[-1:], 0)
    return int(number.rstrip("kmgt")) << scale


def packed(df: DataFrame, **also) -> DataFrame:
    """Each row as one struct `row` beside the columns `also`, so that no column of a user can clash with a helper's; `row.*` gives it back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in also.items()])


def crc_mod(col, m: int):
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % m


def written(df: DataFrame, label: str) -> DataFrame:
    """Store a table in the folder all executors share and read it again: later steps start from files that outlive
    a lost executor, and nothing before is computed twice."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of an edge table (u, v): rows (node, root) with root the least node reachable.

    Alternates large-star and small-star steps on written tables until nothing changes. A hub's edges are split by
    Spark's skew join and its minimum is taken map-side, so no task holds a whole component. Isolated nodes, having
    no edges, are not in the result."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .where("u is not null and v is not null and u <> v").distinct(), label)
    seen = None
    while True:
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct()).distinct()
        seen = sign
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", "m")).distinct())
        now = written(small, label)


class Sets:
    """Disjoint sets of numbers, for the links found inside one task."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
