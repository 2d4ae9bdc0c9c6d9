"""Dates, clock labels and local time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Istanbul"
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^(19|20)\d{6}$", "yyyyMMdd"),
    (r"^\d{8}$", "ddMMyyyy"),
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_date(value: Column | str) -> Column:
    """ISO, D.M.YYYY, YYYYMMDD or DDMMYYYY, tried in this order."""
    text = F.trim(_col(value))
    tries = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)).cast("date"))
        for shape, fmt in DATE_FORMATS
    ]
    return F.coalesce(*tries)


def day_first(value: Column | str) -> Column:
    return F.try_to_timestamp(F.trim(_col(value)), F.lit("d.M.yyyy")).cast("date")


def start_from_label(day: Column, label: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """'3. Koşu 14.30' on a local day -> UTC instant; NULL without a clock time."""
    shape = r"(?<!\d)([01]?\d|2[0-3])[.:](\d{2})(?!\d)"
    hour = F.nullif(F.regexp_extract(_col(label), shape, 1), F.lit("")).cast("int")
    minute = F.nullif(F.regexp_extract(_col(label), shape, 2), F.lit("")).cast("int")
    seconds = hour * 3600 + minute * 60
    return F.to_utc_timestamp(
        F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + seconds.cast("long") * 1_000_000), zone
    )


def race_seconds(value: Column | str) -> Column:
    """'1.34.04' -> 94.04; '58.20' -> 58.2; untimed -> NULL."""
    text = F.trim(_col(value))
    shape = r"^(?:(\d+)[.:])?(\d+)\.(\d+)$"
    minutes = F.coalesce(F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).cast("double"), F.lit(0.0))
    seconds = F.nullif(F.regexp_extract(text, shape, 2), F.lit("")).cast("double")
    fraction = F.concat(F.lit("0."), F.regexp_extract(text, shape, 3)).try_cast("double")
    return F.when(text.rlike(shape), minutes * 60 + seconds + fraction)


def local_day(instant: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(_col(instant), zone).cast("date")


def local_clock(instant: Column | str, zone: str = LOCAL_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(_col(instant), zone), "HH:mm")


def week_label(day: Column | str) -> Column:
    """Monday/Sunday of the week."""
    monday = F.date_trunc("week", _col(day)).cast("date")
    return F.concat(
        F.date_format(monday, "yyyy-MM-dd"), F.lit("/"), F.date_format(F.date_add(monday, 6), "yyyy-MM-dd")
    )


def minutes_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(60_000_000.0)


def cadence_minutes(minutes_to_start: Column) -> Column:
    """How often a race must be refreshed, tighter as the start comes near."""
    return (
        F.when(minutes_to_start <= 10, 1.0)
        .when(minutes_to_start <= 30, 2.0)
        .when(minutes_to_start <= 60, 5.0)
        .otherwise(15.0)
    )


def season(day: Column | str) -> Column:
    month = F.month(_col(day))
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "autumn")
    )
