"""Full assessment of a catalog: scores, index, risk and release class in one map stage."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.operators import composite
from assayframe.operators import domains as dom
from assayframe.plans import criteria as crit
from assayframe.session import stored

FEW_FACTS = 20_000  # rows of profile facts that are broadcast

RESULT_COLUMNS = [
    "total_score", "max_possible", "cqi", "cqi_band", "cqi_trace", "baseline_risk", "risk_basis",
    "sensitivity_multiplier", "adjusted_risk", "prs", "prs_band", "prs_trace", "release_class",
    "release_justification", "policy_override_applied",
]


def _settled(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows, with `names` produced by a generator.

    A filter on a result column would otherwise be pushed to the scan with every score expression
    written out many times over; filters stop at a generator."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*names))))


def assess(facts: DataFrame, overrides: Mapping[str, Any] | None = None, *, limit: crit.Limit | None = None,
           domains: tuple[dom.Domain, ...] = dom.BUILT_IN, texts: bool = True,
           epsilon: str | None = None) -> DataFrame:
    """Add every score and result column to a frame with one row per dataset.

    No join, grouping or sort is planned; the texts (`domain_scores`) are optional because
    headline queries do not need them."""
    limit = limit or crit.literals(overrides)
    out = dom.with_scores(facts, limit, domains)
    out = composite.with_cqi(out, limit, [dom.score_name(d.number) for d in domains])
    out = composite.with_prs(out, limit, epsilon)
    out = composite.with_dp_verified(out)
    out = composite.with_release(out, limit)
    out = _settled(out, [dom.score_name(d.number) for d in domains] + RESULT_COLUMNS)
    out = dom.with_verdicts(out, limit, domains) if texts else out
    return out.drop(*[c for c in out.columns if c.startswith(dom.CLEAN)])


def what_if(facts: DataFrame, sets: Mapping[str, Mapping[str, Any]], **options) -> DataFrame:
    """Assess every dataset under each named criteria set (`criteria_id`)."""
    return assess(crit.attach(facts, sets), limit=crit.columns(classes_=crit.classes(*sets.values())), **options)


def combine(metadata: DataFrame, profile: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Metadata with the profile facts of the same dataset. A measured fact wins over the form's value; a dataset without
    profile keeps what the form says.

    The facts are stored and counted: up to `FEW_FACTS` rows are broadcast, so that forms that share few profiles are not
    gathered by them; more are joined by shuffle."""
    profile = stored(profile, "facts")
    m, p = metadata.alias("m"), (F.broadcast(profile) if profile.count() <= FEW_FACTS else profile).alias("p")
    facts = [c for c in profile.columns if c != key]
    both = m.join(p, F.col(f"m.{key}") == F.col(f"p.{key}"), "left")
    return both.select(*[F.coalesce(F.col(f"p.{c}"), F.col(f"m.{c}")).alias(c) if c in facts else F.col(f"m.{c}") for c in metadata.columns],
                       *[F.col(f"p.{c}") for c in facts if c not in metadata.columns])


def results(assessed: DataFrame, key: str = "dataset_id") -> DataFrame:
    return assessed.select(key, *[F.col(c) for c in RESULT_COLUMNS])
