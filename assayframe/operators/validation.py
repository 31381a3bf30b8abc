"""Questionnaire checks that return violations as rows, and the defaults and merges of a form."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayframe.functions import cells, fixed, schema


def _rule(field: str, rule: str, broken: Column, value: Column) -> Column:
    return F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), value.cast("string").alias("value")))


def _outside(c: Column, least, most) -> Column:
    bad = F.lit(False)
    if least is not None:
        bad = bad | (c < least)
    if most is not None:
        bad = bad | (c > most)
    return bad


def form_rules(have: set[str], as_of: Column) -> list[Column]:
    rules = []
    for n in fixed.FORM_REQUIRED:
        rules.append(_rule(n, "required", F.col(n).isNull() if n in have else F.lit(True), F.lit(None)))
    for n, allowed in fixed.FORM_ENUMS.items():
        if n in have:
            rules.append(_rule(n, "enum", ~F.col(n).isin(allowed), F.col(n)))
    for n, (least, most) in fixed.FORM_LENGTHS.items():
        if n in have:
            rules.append(_rule(n, "length", _outside(F.length(n), least, most), F.col(n)))
    for n, (least, most) in fixed.FORM_RANGES.items():
        if n in have:
            rules.append(_rule(n, "range", _outside(F.col(n), least, most), F.col(n)))
    if {"collection_start_date", "collection_end_date"} <= have:
        rules.append(_rule("collection_end_date", "order", F.col("collection_end_date") < F.col("collection_start_date"),
                           F.col("collection_end_date")))
    if {"age_range_min", "age_range_max"} <= have:
        rules.append(_rule("age_range_max", "order", F.col("age_range_max") < F.col("age_range_min"), F.col("age_range_max")))
    for n in ("collection_start_date", "collection_end_date"):
        if n in have:
            rules.append(_rule(n, "future", F.col(n) > as_of, F.col(n)))
    return rules


def violations(forms: DataFrame, key: str = "dataset_id", as_of: dt.date | None = None,
               raw: str | None = None, extra_rules: list[Column] = ()) -> DataFrame:
    """(key, field, rule, value): one row per broken rule. A map stage; nothing is shuffled.

    `as_of` fixes the day that counts as today. `raw` names a JSON text column whose unknown keys
    are reported as `unknown_field`."""
    today = F.lit(as_of) if as_of else F.current_date()
    rules = [*form_rules(set(forms.columns), today), *extra_rules]
    items = F.array(*rules)
    if raw and raw in forms.columns:
        strange = F.transform(
            F.array_except(F.json_object_keys(F.col(raw)), F.array(*[F.lit(n) for n in schema.FORM_FIELDS])),
            lambda k: F.struct(k.alias("field"), F.lit("unknown_field").alias("rule"), F.lit(None).cast("string").alias("value")))
        items = F.concat(items, F.coalesce(strange, F.slice(items, 1, 0)))
    return forms.select(key, F.inline(items)).where(F.col("rule").isNotNull())


def conditional_rules(have: set[str]) -> list[Column]:
    """Rules of the form's conditional questions: an answer that requires another."""
    pairs = [  # (field that must be answered, when)
        ("irr_value", F.col("irr_method").isNotNull() if "irr_method" in have else None),
        ("num_annotators", F.col("annotation_methodology").isNotNull() if "annotation_methodology" in have else None),
        ("annotator_qualifications", F.col("annotation_methodology").isNotNull() if "annotation_methodology" in have else None),
        ("k_anonymity_value", F.lower("deidentification_method").rlike("k-anonymity|l-diversity")
         if "deidentification_method" in have else None),
        ("dp_epsilon", cells.yes(F.col("differential_privacy_applied")) if "differential_privacy_applied" in have else None),
        ("synthetic_utility_evaluated", (F.col("synthetic_data_pct") > 0) if "synthetic_data_pct" in have else None),
        ("synthetic_privacy_tested", (F.col("synthetic_data_pct") > 0) if "synthetic_data_pct" in have else None),
        ("dua_required", F.col("access_control_method").isNotNull() if "access_control_method" in have else None),
    ]
    rules = [_rule(n, "conditional", when & F.col(n).isNull(), F.lit(None)) for n, when in pairs if when is not None and n in have]
    if {"dp_epsilon", "differential_privacy_applied"} <= have:
        rules.append(_rule("dp_epsilon", "positive", cells.yes(F.col("differential_privacy_applied")) & (F.col("dp_epsilon") <= 0),
                           F.col("dp_epsilon")))
    return rules


def conditional_violations(forms: DataFrame, key: str = "dataset_id") -> DataFrame:
    return forms.select(key, F.inline(F.array(*conditional_rules(set(forms.columns))))).where(F.col("rule").isNotNull())


def format_checks(forms: DataFrame, key: str = "dataset_id") -> DataFrame:
    """(key, field, value, well_formed) for identifiers, approval references, links and versions."""
    items = [F.struct(F.lit(n).alias("field"), F.col(n).alias("value"), F.col(n).rlike(p).alias("well_formed"))
             for n, p in fixed.FORMAT_PATTERNS.items() if n in forms.columns]
    return forms.select(key, F.inline(F.array(*items))).where(F.col("value").isNotNull())


def fill_defaults(forms: DataFrame) -> DataFrame:
    """Answers left open take their default."""
    types = {f.name: f.dataType for f in forms.schema.fields}
    out = {}
    for n, v in fixed.FORM_DEFAULTS.items():
        if n in types:
            out[n] = F.coalesce(F.col(n), F.lit(v))
    for n in fixed.FORM_EMPTY_LISTS:
        if isinstance(types.get(n), T.ArrayType):
            out[n] = F.coalesce(F.col(n), F.array().cast(types[n]))
    return forms.select(*[out.get(c, F.col(c)).alias(c) for c in forms.columns])


def merge_raw(forms: DataFrame, raw: str = "raw_form_json", rename: dict[str, str] | None = None) -> DataFrame:
    """Fill NULL or absent fields from the raw form text. The text is parsed once."""
    names = {v: k for k, v in (rename or {}).items()}
    wanted = T.StructType([T.StructField(names.get(n, n), T.ArrayType(T.StringType()) if t.startswith("array") else T.StringType())
                           for n, t in schema.FORM_FIELDS.items()])
    parsed = forms.withColumn("_raw", F.from_json(F.col(raw), wanted))
    out = []
    for n, kind in schema.FORM_FIELDS.items():
        told = F.col("_raw")[names.get(n, n)]
        if n in forms.columns:
            told = told if kind.startswith("array") else told.try_cast(forms.schema[n].dataType)
            out.append(F.coalesce(F.col(n), told).alias(n))
        else:
            out.append((told if kind.startswith("array") else told.try_cast(kind)).alias(n))
    others = [F.col(c) for c in forms.columns if c not in schema.FORM_FIELDS]
    return parsed.select(*others, *out)


def known_fields(forms: DataFrame, raw: str = "raw_form_json") -> DataFrame:
    """Replace the raw text by a map of its known, answered fields."""
    told = F.from_json(F.col(raw), "map<string,string>")
    known = [F.lit(n) for n in schema.FORM_FIELDS]
    return forms.withColumn("known", F.map_filter(told, lambda k, v: k.isin(*known) & v.isNotNull())).drop(raw)


def known_columns(forms: DataFrame, keep: tuple[str, ...] = ("dataset_id", "assessment_id", "raw_form_json")) -> DataFrame:
    return forms.select(*[c for c in forms.columns if c in schema.FORM_FIELDS or c in keep])


ANNOTATION_FIELDS = ["annotation_methodology", "num_annotators", "irr_method", "irr_value", "annotator_qualifications"]


def gate_answers(answers: DataFrame) -> DataFrame:
    """Turn wizard answers into form fields.

    Reads is_annotated, linked_models_text, dictionary_file, lineage_file next to the form fields."""
    out = []
    for c in answers.columns:
        if c in ANNOTATION_FIELDS:
            out.append(F.when(cells.yes(F.col("is_annotated")), F.col(c)).alias(c))
        elif c == "linked_models_text":
            out.append(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0).alias("linked_model_ids"))
        elif c == "data_dictionary_uploaded":
            out.append((cells.filled(F.col("dictionary_file")) | cells.yes(F.col(c))).alias(c))
        elif c == "provenance_pipeline_available":
            out.append((cells.filled(F.col("lineage_file")) | cells.yes(F.col(c))).alias(c))
        elif c not in ("is_annotated", "dictionary_file", "lineage_file"):
            out.append(F.col(c))
    return answers.select(*out)


def result_violations(results: DataFrame, scores: DataFrame, key: str = "assessment_id") -> DataFrame:
    """(key, rule) for stored results and scores that break a table constraint."""
    range_bad = results.where(~F.col("prs").between(0, 100)).select(key, F.lit("prs_range").alias("rule"))
    twice = results.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("result_unique").alias("rule"))
    number = scores.where(~F.col("domain_number").between(1, 15)).select(key, F.lit("domain_range").alias("rule"))
    value = scores.where(~F.col("score").between(1, 4)).select(key, F.lit("score_range").alias("rule"))
    again = (scores.groupBy(key, "domain_number").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(key, F.lit("score_unique").alias("rule")))
    return range_bad.unionByName(twice).unionByName(number).unionByName(value).unionByName(again)
