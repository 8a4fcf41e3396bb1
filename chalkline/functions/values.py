"""Coercion and rounding helpers shared by every module (blank text, numbers-as-text, money)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(c: Column | str, digits: int = 0) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d, always a double; NaN stays NaN."""
    scale = float(10**digits)
    x = as_col(c)
    rounded = F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    return F.when(F.isnan(x), x.cast("double")).otherwise(rounded)


def blank_to_null(c: Column | str) -> Column:
    """Trimmed text; blank and the literal 'nan' become NULL."""
    text = F.trim(as_col(c).cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def to_float(c: Column | str) -> Column:
    return blank_to_null(c).try_cast("double")


def to_int(c: Column | str) -> Column:
    """Truncates toward zero like int(float(text)); NULL when it is not a number."""
    return to_float(c).try_cast("bigint")


def money(c: Column | str) -> Column:
    """'$7,500' -> 7500; NULL when nothing numeric is left."""
    return F.regexp_replace(as_col(c).cast("string"), r"[$,\s]", "").try_cast("double").try_cast("bigint")


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double, NULL when the denominator is NULL or 0."""
    d = as_col(den).cast("double")
    return F.when(d != 0, as_col(num).cast("double") / d)
