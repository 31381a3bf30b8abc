"""Bundles of clinical resources: detection and flattening of JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BUNDLE = "resourceType string, entry array<struct<resource:string>>"


def detect(docs: DataFrame, key: str, doc: str) -> DataFrame:
    kind = F.get_json_object(F.col(doc), "$.resourceType")
    return docs.select(key, kind.alias("resource_type"), F.coalesce(kind == "Bundle", F.lit(False)).alias("is_bundle"))


def bundle_entries(docs: DataFrame, key: str, doc: str, fields: dict[str, str] | None = None) -> DataFrame:
    """(key, entry_no, resource_type, resource_id, ...): one row per bundle entry; other documents give none.

    `fields` adds columns by JSON path inside the resource."""
    parsed = docs.select(key, F.from_json(doc, _BUNDLE).alias("b")).where(F.col("b.resourceType") == "Bundle")
    rows = parsed.select(key, F.posexplode("b.entry").alias("entry_no", "e"))
    res = F.col("e.resource")
    more = [F.get_json_object(res, path).alias(name) for name, path in (fields or {}).items()]
    return rows.select(key, "entry_no", F.get_json_object(res, "$.resourceType").alias("resource_type"),
                       F.get_json_object(res, "$.id").alias("resource_id"), *more)
