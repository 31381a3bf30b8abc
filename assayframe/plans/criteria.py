"""Thresholds that drive scoring: defaults, overrides, and several sets side by side."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: default thresholds ---------------------------------------------------
DEFAULTS: dict[str, Any] = {
    "irr_adequate": 0.6,
    "irr_exemplary": 0.8,
    "min_annotators": 2,
    "tier1": 30.0,
    "tier2": 60.0,
    "tier3": 85.0,
    "multi_site_min": 2,
    "completeness_pct": 90.0,
    "completeness_floor": 50.0,
    "imbalance_ratio_ok": 3.0,
    "k_anonymity_min": 5,
    "majority_synthetic_pct": 50.0,
    "neutral_score_when_no_models": 3,
    "max_file_size_bytes": 10000000,
    "multiplier_standard": 1.0,
    "multiplier_high_stigma": 1.5,
    "multiplier_critical": 2.0,
    "low_max": 15,
    "moderate_max": 40,
    "high_max": 70,
    "diamond_min": 95.0,
    "platinum_min": 85.0,
    "gold_min": 70.0,
    "silver_min": 50.0,
    "bronze_min": 25.0,
    "open_cqi_min": 70.0,
    "open_prs_band": "Low",
    # Name printed in the justification of a policy override.
    "policy_name": "release",
}

# Where each key sits in a nested criteria document: domain number or section.
_DOMAIN_KEYS = {
    1: ["irr_adequate", "irr_exemplary", "min_annotators"],
    2: ["tier1", "tier2", "tier3"],
    4: ["multi_site_min"],
    5: ["completeness_pct", "completeness_floor"],
    6: ["imbalance_ratio_ok"],
    7: ["k_anonymity_min"],
    11: ["majority_synthetic_pct"],
    14: ["max_file_size_bytes"],
}

Limit = Callable[[str], Column]
# Every threshold whose name starts like this is the multiplier of a sensitivity class; a document may add classes.
MULTIPLIER = "multiplier_"


def from_document(doc: Mapping[str, Any]) -> dict[str, Any]:
    """Flatten a nested criteria document (domains / prs / cqi_bands / release).

    Domain keys may be integers or strings; missing entries keep their default."""
    out = dict(DEFAULTS)
    domains = doc.get("domains") or {}

    def section(number: int) -> Mapping[str, Any]:
        return domains.get(number) or domains.get(str(number)) or {}

    for number, keys in _DOMAIN_KEYS.items():
        thresholds = section(number).get("thresholds") or {}
        out.update({k: thresholds[k] for k in keys if k in thresholds})
    neutral = section(13).get("neutral_score_when_no_models")
    if neutral is not None:
        out["neutral_score_when_no_models"] = neutral
    prs = doc.get("prs") or {}
    for cls, value in (prs.get("sensitivity_multipliers") or {}).items():
        out[f"multiplier_{cls}"] = value
    for group in (prs.get("bands") or {}, doc.get("cqi_bands") or {}, doc.get("release") or {}):
        out.update({k: v for k, v in group.items() if k in out})
    return typed(out)


def load(path: str) -> dict[str, Any]:
    """Read a criteria document from a YAML or JSON file on the driver (a few kilobytes)."""
    import json

    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith(".json"):
        return from_document(json.loads(text))
    import yaml

    return from_document(yaml.safe_load(text) or {})


def typed(overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with overrides, every value cast to the type of its default."""
    out = dict(DEFAULTS)
    for key, value in (overrides or {}).items():
        if key not in DEFAULTS and not key.startswith(MULTIPLIER):
            raise KeyError(f"unknown threshold: {key}")
        out[key] = type(DEFAULTS.get(key, 1.0))(value)
    return out


def classes(*sets: Mapping[str, Any]) -> list[str]:
    """Sensitivity classes that the sets give a multiplier, the default ones first."""
    named = dict.fromkeys(k for over in ({}, *sets) for k in typed(over) if k.startswith(MULTIPLIER))
    return [k.removeprefix(MULTIPLIER) for k in named]


def literals(overrides: Mapping[str, Any] | None = None) -> Limit:
    values = typed(overrides)

    def limit(key: str) -> Column:
        return F.lit(values[key])

    limit.same_as = ("literals", tuple(sorted(values.items())))
    limit.classes = classes(values)
    return limit


def attach(df: DataFrame, sets: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One copy of each row per criteria set, as `criteria_id` and a `criteria` struct.

    The sets are literals in an array that is exploded, so no join and no shuffle is planned."""
    keys = dict.fromkeys(k for over in ({}, *sets.values()) for k in typed(over))
    options = [
        F.struct(
            F.lit(name).alias("criteria_id"),
            F.struct(*[F.lit(typed(over).get(k, 1.0)).alias(k) for k in keys]).alias("criteria"),
        )
        for name, over in sets.items()
    ]
    return df.select("*", F.explode(F.array(*options)).alias("_set")).select(
        *[F.col(c) for c in df.columns], "_set.criteria_id", "_set.criteria"
    )


def columns(struct_name: str = "criteria", classes_: list[str] | None = None) -> Limit:
    def limit(key: str) -> Column:
        return F.col(struct_name)[key]

    limit.classes = classes_ or classes()
    limit.same_as = ("columns", struct_name, tuple(limit.classes))
    return limit
