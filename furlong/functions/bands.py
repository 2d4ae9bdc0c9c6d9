"""Report buckets and label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furlong.functions import text


def _folded(value: Column) -> Column:
    return text.strip_accents(F.lower(F.translate(F.coalesce(value, F.lit("")), text.TURKISH, text.TURKISH_ASCII)))


def surface_group(value: Column) -> Column:
    key = _folded(value)
    return (
        F.when(key.contains("sent"), "synthetic")
        .when(key.contains("kum"), "dirt")
        .when(key.contains("cim"), "turf")
        .otherwise(F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown")))
    )


def breed_group(value: Column) -> Column:
    key = _folded(value)
    return (
        F.when(key.contains("ingiliz"), "thoroughbred").when(key.contains("arap"), "arabian").otherwise("unknown")
    )


def race_type_group(value: Column) -> Column:
    key = _folded(value)
    return (
        F.when(key.contains("g1"), "G1")
        .when(key.contains("g2"), "G2")
        .when(key.contains("g3"), "G3")
        .when(key.contains("kv"), "KV")
        .when(key.contains("maiden"), "maiden")
        .when(key.contains("sart"), "conditions")
        .when(key.contains("hand"), "handicap")
        .otherwise(F.coalesce(F.nullif(value, F.lit("")), F.lit("other")))
    )


def distance_group(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unknown")
        .when(value <= 1200, "<=1200")
        .when(value <= 1600, "1300-1600")
        .when(value <= 2000, "1700-2000")
        .otherwise("2000+")
    )


def field_size_group(value: Column) -> Column:
    return F.when(value <= 6, "<=6").when(value <= 10, "7-10").when(value <= 14, "11-14").otherwise("15+")


def odds_band(value: Column) -> Column:
    return (
        F.when(value.isNull(), "no odds")
        .when(value < 2, "<2")
        .when(value < 4, "2-3.99")
        .when(value < 8, "4-7.99")
        .otherwise("8+")
    )


def market_band(rank: Column) -> Column:
    return (
        F.when(rank.isNull(), "no market")
        .when(rank == 1, "1")
        .when(rank <= 3, "2-3")
        .when(rank <= 6, "4-6")
        .otherwise("7+")
    )


# Lifecycle state -> status of the older status column.
LEGACY_STATUS = {
    "WAITING": "WAITING",
    "PRE_WINDOW": "WAITING",
    "CAPTURING": "FINAL_REFRESH_DUE",
    "FINAL_CAPTURING": "FINAL_REFRESH_DUE",
    "POST_START_RETRY": "MISSED_FINAL_WINDOW",
    "FINAL_CAPTURED": "FINAL_PREDICTION_DONE",
    "RESULT_PENDING": "RESULT_PENDING",
    "RESULT_CAPTURED": "RESULT_CAPTURED",
    "SOURCE_UNSUPPORTED": "SOURCE_UNSUPPORTED",
    "FAILED": "MISSED_FINAL_WINDOW",
}


def legacy_status(state: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LEGACY_STATUS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, state), state)
