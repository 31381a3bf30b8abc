"""First readable text member of ZIP archives, over many archives at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_SCHEMA = "archive string, member_ordinal int, member string, ext string, content string"
MEMBER_CHARS = 16 << 20  # unpacked characters after which a task hands its rows on
TEXT_MEMBERS = ("csv", "json")  # fixed values: member extensions, case-sensitive


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import io
    import zipfile

    def told(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["archive", "member_ordinal", "member", "ext", "content"]).astype({"member_ordinal": "Int32"})

    for batch in batches:
        rows, held = [], 0
        for archive, content in zip(batch["path"], batch["content"]):
            found = (archive, None, None, None, None)
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i, name in enumerate(z.namelist()):
                        base = name.rsplit("/", 1)[-1]
                        hidden = name.startswith(("__MACOSX", ".")) or base.startswith(".")
                        ext = name.rsplit(".", 1)[-1] if "." in name else ""
                        if not hidden and ext in TEXT_MEMBERS:
                            found = (archive, i, name, ext, z.read(name).decode("utf-8", "replace"))
                            break
            except zipfile.BadZipFile:
                pass
            rows.append(found)
            held += len(found[4] or "")
            if held >= MEMBER_CHARS:
                yield told(rows)
                rows, held = [], 0
        if rows:
            yield told(rows)


def first_members(archives: DataFrame) -> DataFrame:
    """(archive, member_ordinal, member, ext, content); NULL parts when nothing in the archive is readable.

    `archives` has `path` and `content`, as the binaryFile source gives. Archives are handled one at a
    time inside a task and only the first qualifying member is unpacked; their rows leave together, `MEMBER_CHARS` at a time."""
    return archives.select("path", "content").mapInPandas(_members, MEMBER_SCHEMA)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    return first_members(files)


def member_lines(members: DataFrame) -> DataFrame:
    """(archive, line_no, fields): the data lines of delimited members, split, with the header as line 0."""
    lines = members.where(F.col("ext") == "csv").select("archive", F.posexplode(F.split("content", "\r?\n")).alias("line_no", "line"))
    return lines.where(F.length("line") > 0).select("archive", "line_no", F.split("line", ",").alias("fields"))
