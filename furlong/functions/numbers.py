"""Numbers from messy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_double(value: Column) -> Column:
    return value.try_cast("double")


def decimal_comma(value: Column | str) -> Column:
    """'55,5' -> 55.5; anything else that is not a number -> NULL."""
    text = F.trim(F.replace(_col(value).cast("string"), F.lit(","), F.lit(".")))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), to_double(text))


def leading_number(value: Column | str) -> Column:
    """Number at the start of the text, percent signs ignored; '-' and '' -> NULL."""
    text = F.replace(F.trim(_col(value).cast("string")), F.lit("%"), F.lit(""))
    return to_double(
        F.replace(
            F.nullif(F.regexp_extract(text, r"^(\d+(?:[.,]\d+)?)", 1), F.lit("")), F.lit(","), F.lit(".")
        )
    )


def grouped_number(value: Column | str) -> Column:
    """'1.234,50 x' -> 1234.5: dot groups thousands, comma is the decimal mark, never negative."""
    digits = F.regexp_replace(_col(value).cast("string"), r"[^0-9,.-]", "")
    number = to_double(F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return F.when(number >= 0, number)


def whole_number(value: Column | str) -> Column:
    return decimal_comma(value).cast("int")


def non_negative_int(value: Column | str) -> Column:
    number = F.trim(_col(value).cast("string")).try_cast("long")
    return F.when(number >= 0, number)


def crowd_percent(value: Column | str) -> Column:
    """'%8,5(3)' -> 8.5"""
    return leading_number(F.nullif(F.regexp_extract(_col(value), r"%\s*([\d.,]+)", 1), F.lit("")))


def crowd_rank(value: Column | str) -> Column:
    """'%8,5(3)' -> 3"""
    return F.nullif(F.regexp_extract(_col(value), r"\(\s*(\d+)\s*\)", 1), F.lit("")).cast("int")


GRID_CELL = r"^(\d+)\s*\(\s*%?\s*([\d,.]+)\s*\)$"


def grid_number(value: Column | str) -> Column:
    """'7 (%45,74)' -> 7"""
    return F.nullif(F.regexp_extract(F.trim(_col(value)), GRID_CELL, 1), F.lit("")).cast("int")


def grid_percent(value: Column | str) -> Column:
    """'7 (%45,74)' -> 45.74"""
    return decimal_comma(F.nullif(F.regexp_extract(F.trim(_col(value)), GRID_CELL, 2), F.lit("")))


def title_distance(value: Column | str) -> Column:
    """Last stand-alone number of three or four digits."""
    found = F.regexp_extract_all(F.coalesce(_col(value), F.lit("")), F.lit(r"(?<!\d)(\d{3,4})(?!\d)"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("double")


def odds_in_text(value: Column | str) -> Column:
    return decimal_comma(F.nullif(F.regexp_extract(_col(value), r"(\d+[.,]\d+)", 1), F.lit("")))


def race_number(label: Column | str) -> Column:
    """'3. Koşu' -> 3"""
    return F.nullif(F.regexp_extract(_col(label), r"(?i)(\d+)\s*\.?\s*Ko", 1), F.lit("")).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def finite(value: Column) -> Column:
    """Neither NULL, NaN nor infinite."""
    infinite = F.lit(float("inf"))
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < infinite)


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def close(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """Equal within absolute plus relative tolerance; two NULLs are equal."""
    near = F.abs(a - b) <= F.lit(tolerance) + F.lit(tolerance) * F.abs(b)
    return (a.isNull() & b.isNull()) | F.coalesce(near, F.lit(False))
