"""Small column expressions: blanks, truthiness, exact percentages, printed values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- fixed values: characters trimmed as white space ---
WHITE_SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
               "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def clean(c: Column) -> Column:
    """Trim every kind of white space; blank becomes NULL.

    The full trim is slow, so it runs only when an end of the text is not printable ASCII."""
    text = c.cast("string")
    plain = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(plain, text).otherwise(F.nullif(F.trim(text, F.lit(WHITE_SPACE)), F.lit("")))


def filled(c: Column) -> Column:
    """True when a string is neither NULL nor empty."""
    return c.isNotNull() & (c != "")


def yes(c: Column) -> Column:
    """A flag with NULL read as false."""
    return F.coalesce(c.cast("boolean"), F.lit(False))


def missing(c: Column, dtype: T.DataType) -> Column:
    """NULL, or NaN for floating columns."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def pct(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """100*part/whole with two decimals, half up, in integer arithmetic so every engine agrees."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    top, bottom = part * 20000 + whole, whole * 2
    hundredths = F.call_function("div", top, F.nullif(bottom, F.lit(0)))
    return F.when(whole > 0, hundredths / 100.0).otherwise(F.lit(empty).cast("double"))


def text_of_flag(c: Column) -> Column:
    return F.when(c.isNull(), "None").when(c.cast("boolean"), "True").otherwise("False")


def text_of_float(c: Column) -> Column:
    """Shortest decimal text, positional between 1e-4 and 1e16."""
    d = c.cast("double")
    plain = d.cast("string")
    wide = F.regexp_replace(plain.cast("decimal(38,14)").cast("string"), r"(\.\d+?)0+$", "$1")
    positional = (F.abs(d) >= 1e-4) & (F.abs(d) < 1e16)
    return F.when(plain.contains("E") & positional, wide).otherwise(plain)


def text_or(c: Column, other: str) -> Column:
    return F.coalesce(c.cast("string"), F.lit(other))


def lines(items: Iterable[Column]) -> Column:
    """Ordered array of the non-NULL strings.

    `array_remove` is compiled; `array_compact` is a lambda and would interpret every message."""
    items = list(items)
    if not items:
        return F.array().cast("array<string>")
    return F.array_remove(F.array(*[F.coalesce(i.cast("string"), F.lit("")) for i in items]), "")


def any_word(c: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def named(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return df["`" + name.replace("`", "``") + "`"]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
