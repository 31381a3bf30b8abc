"""Composite quality index, privacy-risk score and release class. Row-local expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayframe.functions import cells
from assayframe.operators import domains as dom
from assayframe.plans import criteria as crit


def band_of_cqi(cqi: Column, limit: crit.Limit) -> Column:
    return (F.when(cqi >= limit("diamond_min"), "Diamond").when(cqi >= limit("platinum_min"), "Platinum")
            .when(cqi >= limit("gold_min"), "Gold").when(cqi >= limit("silver_min"), "Silver")
            .when(cqi >= limit("bronze_min"), "Bronze").otherwise("Remediation"))


def with_cqi(df: DataFrame, limit: crit.Limit | None = None, scores: list[str] | None = None) -> DataFrame:
    """Add total_score, max_possible, cqi, cqi_band, cqi_trace from the score columns of each row.

    The sum runs inside the row, so a catalog of any size needs no grouping shuffle."""
    limit = limit or crit.literals()
    scores = scores or [dom.score_name(d.number) for d in dom.BUILT_IN]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(s), F.lit(0)) for s in scores])
    counted = reduce(lambda a, b: a + b, [F.col(s).isNotNull().cast("int") for s in scores])
    df = df.select("*", total.cast("int").alias("total_score"), (counted * 4).cast("int").alias("max_possible"))
    t, m = F.col("total_score"), F.col("max_possible")
    df = df.select("*", F.when(m > 0, F.round(t / m * 100, 1)).otherwise(F.lit(0.0)).alias("cqi"))
    return df.select("*", band_of_cqi(F.col("cqi"), limit).alias("cqi_band"), F.concat(
        F.lit("("), t.cast("string"), F.lit(" / "), m.cast("string"), F.lit(") × 100 = "),
        cells.text_of_float(F.col("cqi"))).alias("cqi_trace"))


def cqi_from_long(scores: DataFrame, key: str = "dataset_id", limit: crit.Limit | None = None) -> DataFrame:
    """The same index from stored (dataset, domain) rows: one partial aggregation per dataset."""
    agg = scores.groupBy(key).agg(F.coalesce(F.sum("score"), F.lit(0)).cast("int").alias("_t"),
                                  F.count("score").cast("int").alias("_n"))
    one = agg.select(key, F.col("_t").alias("total_score"), (F.col("_n") * 4).alias("max_possible"))
    t, m = F.col("total_score"), F.col("max_possible")
    one = one.select("*", F.when(m > 0, F.round(t / m * 100, 1)).otherwise(F.lit(0.0)).alias("cqi"))
    return one.select("*", band_of_cqi(F.col("cqi"), limit or crit.literals()).alias("cqi_band"))


def with_prs(df: DataFrame, limit: crit.Limit | None = None, epsilon: str | None = None) -> DataFrame:
    """Add baseline_risk, risk_basis, sensitivity_multiplier, adjusted_risk, prs, prs_band, prs_trace.

    With `epsilon` (a column name) a differentially private row starts from min(100, 20 * epsilon)
    instead of the constant 20."""
    limit = limit or crit.literals()
    f = dom.Facts(df, limit)
    place = f.raw("location_granularity", "district")
    noised = F.lit(20.0)
    if epsilon is not None:
        eps = f.number(epsilon)
        noised = F.when(eps > 0, F.least(F.lit(100.0), eps * 20)).otherwise(noised)
    rules = [
        (f.flag("direct_identifiers_detected"), F.lit(50.0), "direct_identifiers_present"),
        (f.flag("differential_privacy_applied"), noised, "differential_privacy_applied"),
        ((place == "village") & f.flag("rare_condition_flag"), F.lit(30.0), "village_rare_condition"),
        (place.isin("district", "taluk"), F.lit(15.0), "district_or_month"),
        (place.isin("state", "region", "national"), F.lit(5.0), "state_or_region"),
    ]
    base, basis = F, F
    for test, value, name in rules:
        base, basis = base.when(test, value), basis.when(test, F.lit(name))
    base, basis = base.otherwise(F.lit(15.0)), basis.otherwise(F.lit("default_moderate"))

    sens = f.raw("sensitivity_class", "standard")
    times = F
    for cls in limit.classes:
        times = times.when(sens == cls, limit(f"{crit.MULTIPLIER}{cls}"))
    times = times.otherwise(F.lit(1.0))
    df = df.select("*", base.cast("double").alias("baseline_risk"), basis.alias("risk_basis"),
                   times.cast("double").alias("sensitivity_multiplier"))
    df = df.select("*", (F.col("baseline_risk") * F.col("sensitivity_multiplier")).alias("adjusted_risk"))
    df = df.select("*", F.least(F.lit(100), F.floor(F.col("adjusted_risk") + 0.5).cast("int")).alias("prs"))
    prs = F.col("prs")
    band = (F.when(prs > limit("high_max"), "Very High").when(prs > limit("moderate_max"), "High")
            .when(prs > limit("low_max"), "Moderate").otherwise("Low"))
    trace = F.concat(
        F.lit("baseline="), cells.text_of_float(F.col("baseline_risk")), F.lit(" ("), F.col("risk_basis"),
        F.lit(") × multiplier="), cells.text_of_float(F.col("sensitivity_multiplier")), F.lit(" ("),
        cells.text_or(sens, "None"), F.lit(") = "), cells.text_of_float(F.col("adjusted_risk")),
        F.lit(" → PRS="), prs.cast("string"))
    return df.select("*", band.alias("prs_band"), trace.alias("prs_trace"))


def with_dp_verified(df: DataFrame, privacy_score: str = "d07") -> DataFrame:
    f = dom.Facts(df)
    checked = f.flag("differential_privacy_applied") & F.coalesce(F.col(privacy_score) == 4, F.lit(False))
    return df.select("*", checked.alias("dp_verified"))


def with_release(df: DataFrame, limit: crit.Limit | None = None) -> DataFrame:
    """Add release_class, release_justification, policy_override_applied.

    Reads cqi, prs, prs_band, sensitivity_class and dp_verified."""
    limit = limit or crit.literals()
    f = dom.Facts(df, limit)
    cqi, prs, band = F.col("cqi"), F.col("prs").cast("string"), F.col("prs_band")
    sens = f.raw("sensitivity_class", "standard")
    guarded = F.coalesce(sens.isin("high_stigma", "critical"), F.lit(False))
    risky = band.isin("High", "Very High")
    shown = cells.text_of_float(cqi)
    say = dom._say
    # (condition, class, justification, override), first match wins
    rules = [
        (guarded & risky, "Restricted",
         say("High-stigma data with ", band, " PRS. Restricted per ", limit("policy_name"), " policy."), True),
        (guarded & ~f.flag("dp_verified"), "Controlled",
         F.lit("High-stigma data defaults to Controlled unless Differential Privacy is independently verified."), True),
        ((cqi >= limit("open_cqi_min")) & (band == limit("open_prs_band")), "Open",
         say("CQI=", shown, " (>=", cells.text_of_float(limit("open_cqi_min")), ") and PRS=", prs, " (",
             limit("open_prs_band"), "). Open access permitted."), False),
        ((cqi >= 70.0) & (band == "Moderate"), "Controlled",
         say("CQI=", shown, " (>=70) but PRS=", prs, " (Moderate). Controlled access required."), False),
        (risky, "Restricted", say("PRS=", prs, " (", band, "). Restricted regardless of CQI."), False),
        ((cqi < 50.0) & (band == "Low"), "Controlled",
         say("CQI=", shown, " (<50). Controlled until quality improved."), False),
        (cqi < 50.0, "Restricted",
         say("CQI=", shown, " (<50) and PRS=", prs, " (", band, "). Restricted."), False),
    ]
    chosen = F
    for test, cls, why, override in rules:
        chosen = chosen.when(test, F.struct(F.lit(cls).alias("c"), why.alias("j"), F.lit(override).alias("o")))
    chosen = chosen.otherwise(F.struct(
        F.lit("Controlled").alias("c"),
        say("CQI=", shown, " (Silver/Gold band). Controlled access.").alias("j"), F.lit(False).alias("o")))
    df = df.select("*", chosen.alias("_release"))
    return df.select("*", F.col("_release.c").alias("release_class"),
                     F.col("_release.j").alias("release_justification"),
                     F.col("_release.o").alias("policy_override_applied")).drop("_release")
