"""File-level facts, the upload allow-list and the manifest derived from object keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayframe.functions import fixed

SALTS = 16  # parts of one content when files meet their first copy


def uuid_text(part: Column) -> Column:
    """Canonical form of a UUID written with or without hyphens, braces or prefix; else NULL."""
    digits = F.lower(F.regexp_replace(part, "urn:|uuid:|[{}-]", ""))
    shown = F.concat_ws("-", *[F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(digits.rlike("^[0-9a-f]{32}$"), shown)


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; NULL without a dot."""
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1)))


def file_facts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(filename, format, size_bytes, encoding) of every file; contents are not read."""
    return facts_of_files(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path))


def facts_of_files(files: DataFrame) -> DataFrame:
    """The same from rows (path, length)."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), F.coalesce(extension(name), F.lit("csv")).alias("format"),
                        F.col("length").alias("size_bytes"), F.lit("UTF-8").alias("encoding"))


def file_digests(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, size_bytes, sha256, valid_utf8): digest of whole file contents, and whether they are UTF-8."""
    return files.select(path, F.length(content).cast("bigint").alias("size_bytes"), F.sha2(content, 256).alias("sha256"),
                        F.is_valid_utf8(F.col(content).cast("string")).alias("valid_utf8"))


def duplicate_files(digests: DataFrame, path: str = "path") -> DataFrame:
    """Every file whose content repeats that of a file earlier by path.

    The first paths of repeated contents are one row each and go to every one of `SALTS` parts, so the files of one
    content meet theirs in as many tasks."""
    firsts = digests.groupBy("sha256").agg(F.min(path).alias("first_path"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    firsts = firsts.select("sha256", "first_path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    dealt = digests.withColumn("_salt", F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("int"))
    return dealt.join(firsts, ["sha256", "_salt"]).where(F.col(path) != F.col("first_path")).select(path, "first_path", "sha256")


def compression_ratio(sizes: DataFrame, stored: str = "compressed_size_bytes", plain: str = "size_bytes") -> DataFrame:
    return sizes.withColumn("compression_ratio", F.when(F.col(stored) > 0, F.round(F.col(plain) / F.col(stored), 4)))


def allowed_uploads(requests: DataFrame, filename: str = "filename", declared: str = "file_format") -> DataFrame:
    """Add ext and accepted: both the extension and the declared format must be on the list."""
    said = F.lower(F.col(declared))
    out = requests.withColumn("ext", F.coalesce(extension(F.col(filename)), said))
    return out.withColumn("accepted", F.col("ext").isin(fixed.UPLOAD_EXTENSIONS) & said.isin(fixed.UPLOAD_EXTENSIONS))


def manifest(keys: DataFrame, key: str = "file_key", registry_id: str | None = None, synthetic: str | None = None,
             fresh_id: Column | None = None, fresh_dataset: Column | None = None) -> DataFrame:
    """Add assessment_id, dataset_id, file_format and domain_11_applicable derived from an object key.

    The second path part is the assessment id when it is a UUID; otherwise a fresh id is made."""
    part = F.try_element_at(F.split(F.col(key), "/"), F.lit(2))
    fresh_id = fresh_id if fresh_id is not None else F.uuid()
    fresh_dataset = fresh_dataset if fresh_dataset is not None else F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
    told = F.nullif(F.col(registry_id), F.lit("")) if registry_id else F.lit(None).cast("string")
    share = F.col(synthetic) if synthetic else F.lit(None).cast("double")
    return keys.select(
        "*", F.coalesce(uuid_text(part), fresh_id).alias("assessment_id"),
        F.coalesce(told, F.concat(F.lit("dataset_"), fresh_dataset)).alias("dataset_id"),
        F.when(F.col(key).contains("."), F.element_at(F.split(F.col(key), r"\."), -1)).otherwise("csv").alias("file_format"),
        F.coalesce(share > 0, F.lit(False)).alias("domain_11_applicable"))
