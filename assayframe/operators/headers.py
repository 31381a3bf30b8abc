"""Checks that read column names only, for one table or for a catalog of (dataset, position, name) rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import fixed


def family_pattern(family: str) -> str:
    return rf"(?i)\b({fixed.HEADER_FAMILIES[family]})\b"


def in_family(name: Column, family: str) -> Column:
    return name.rlike(family_pattern(family))


def pii_flag(name: Column) -> Column:
    """First matching family as `<family>_pattern`; NULL when none matches."""
    out = F
    for family in fixed.HEADER_FAMILIES:
        out = out.when(in_family(name, family), f"{family}_pattern")
    return out


def flag_columns(columns: DataFrame, name: str = "column_name") -> DataFrame:
    """Add pii_flag and pii_confidence to column rows."""
    flagged = columns.withColumn("pii_flag", pii_flag(F.col(name)))
    return flagged.withColumn("pii_confidence", F.when(F.col("pii_flag").isNotNull(), "High"))


def _ranked(name: Column, words: list[str]) -> Column:
    """Position of the lower-cased name in `words`; NULL when absent."""
    out = F
    for i, word in enumerate(words):
        out = out.when(F.lower(name) == word, i)
    return out


def scan_headers(columns: DataFrame, key: str = "dataset_id", name: str = "column_name", order: str = "ord") -> DataFrame:
    """Personal-data columns of every dataset: one array per family, and the direct-identifier verdict.

    Names that match no family are dropped before the grouping, so only hits are shuffled."""
    n = F.col(name)
    marked = columns.select(key, order, name, *[in_family(n, f).alias(f"_{f}") for f in fixed.HEADER_FAMILIES])
    lists = [
        F.transform(F.array_sort(F.collect_list(F.when(F.col(f"_{f}"), F.struct(order, name)))), lambda x: x[name])
        .alias(f"{f}_columns") for f in fixed.HEADER_FAMILIES
    ]
    out = marked.groupBy(key).agg(*lists)
    direct = F.lit(False)
    for f in fixed.DIRECT_FAMILIES:
        direct = direct | (F.size(f"{f}_columns") > 0)
    return out.select(key, direct.alias("direct_identifiers_detected"), *[f"{f}_columns" for f in fixed.HEADER_FAMILIES])


def detect_roles(columns: DataFrame, key: str = "dataset_id", name: str = "column_name", order: str = "ord") -> DataFrame:
    """Split / fold presence and the label and age columns of every dataset.

    Of several label (age) names the one written first in the fixed list wins; of equal names the last column."""
    n = F.col(name)
    ranked = columns.select(key, name, order, _ranked(n, fixed.LABEL_NAMES).alias("_label"),
                            _ranked(n, fixed.AGE_NAMES).alias("_age"),
                            F.lower(n).isin(fixed.SPLIT_NAMES).alias("_split"),
                            F.lower(n).isin(fixed.FOLD_NAMES).alias("_fold"))

    def pick(rank: str) -> Column:
        at = F.when(F.col(rank).isNotNull(), F.struct(F.col(rank), (-F.col(order)).alias("o")))
        return F.min_by(F.when(F.col(rank).isNotNull(), n), at)

    return ranked.groupBy(key).agg(
        F.max("_split").alias("split_column_detected"), F.max("_fold").alias("fold_column_detected"),
        pick("_label").alias("label_column"), pick("_age").alias("age_column"))


# ---- one table: names are on the driver, no job is needed -------------------------------

def table_headers(names: list[str]) -> dict[str, list[str]]:
    return {f: [n for n in names if re.search(family_pattern(f), n)] for f in fixed.HEADER_FAMILIES}


def table_roles(names: list[str]) -> dict:
    lowered = {n.lower(): n for n in names}

    def first(words):
        return next((lowered[w] for w in words if w in lowered), None)

    return {
        "split_column_detected": any(w in lowered for w in fixed.SPLIT_NAMES),
        "fold_column_detected": any(w in lowered for w in fixed.FOLD_NAMES),
        "label_column": first(fixed.LABEL_NAMES),
        "age_column": first(fixed.AGE_NAMES),
    }


def range_rule(name: str) -> tuple[int, int] | None:
    """Plausibility limits by substring of the name (column profile)."""
    low = name.lower()
    if "age" in low:
        return fixed.AGE_LIMITS
    if "bmi" in low:
        return fixed.BMI_LIMITS
    return None


def word_rules(name: str) -> list[tuple[int, int]]:
    """Plausibility limits by whole word of the name (schema conformance)."""
    rules = []
    if re.search(r"\bage\b", name, re.IGNORECASE):
        rules.append(fixed.AGE_LIMITS)
    if re.search(r"\bbmi\b", name, re.IGNORECASE):
        rules.append(fixed.BMI_LIMITS)
    return rules
