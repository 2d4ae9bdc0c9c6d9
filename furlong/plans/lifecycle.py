"""Prediction lifecycle of a race and refresh selection, as pure expressions of time and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import dates

SECOND = 1_000_000
PRE_WINDOW, CAPTURE, EMERGENCY, POST_START = 1800, 900, 120, 120  # seconds


def state(now: Column, start: Column, has_final: Column, has_result: Column, supported: Column) -> Column:
    ahead = F.unix_micros(start) - F.unix_micros(now)
    started = ahead <= 0
    return (
        F.when(~supported, "SOURCE_UNSUPPORTED")
        .when(has_result, "RESULT_CAPTURED")
        .when(has_final & started, "RESULT_PENDING")
        .when(has_final, "FINAL_CAPTURED")
        .when(ahead <= -POST_START * SECOND, "FAILED")
        .when(started, "POST_START_RETRY")
        .when(ahead <= EMERGENCY * SECOND, "FINAL_CAPTURING")
        .when(ahead <= CAPTURE * SECOND, "CAPTURING")
        .when(ahead <= PRE_WINDOW * SECOND, "PRE_WINDOW")
        .otherwise("WAITING")
    )


def failure_reason(now: Column, start: Column, first_seen: Column, agf_at: Column, odds_at: Column) -> Column:
    seen, begin = F.unix_micros(first_seen), F.unix_micros(start)
    return (
        F.when(seen >= begin, "RACE_STARTED")
        .when(seen >= begin - EMERGENCY * SECOND, "LATE_DISCOVERY")
        .when(now >= start, "RACE_STARTED")
        .when(agf_at.isNull(), "NO_AGF")
        .when(odds_at.isNull(), "NO_ODDS")
        .otherwise("UNKNOWN")
    )


def facts(races: DataFrame, predictions: DataFrame, results: DataFrame, agf: DataFrame, odds: DataFrame) -> DataFrame:
    """Final prediction of the last 15 minutes, result, and last market captures up to it."""
    window = (F.col("prediction_time") >= F.timestamp_micros(F.unix_micros("race_start_at") - CAPTURE * SECOND)) & (
        F.col("prediction_time") < F.col("race_start_at")
    )
    final = predictions.filter(window).groupBy("race_id").agg(F.max("prediction_time").alias("final_prediction_at"))
    won = results.filter("result_status = 'finished' AND finish_position = 1").select("race_id").distinct().withColumn(
        "has_result", F.lit(True)
    )
    base = races.join(final, "race_id", "left").join(won, "race_id", "left")
    base = base.withColumn("_limit", F.coalesce("final_prediction_at", "race_start_at"))
    for name, feed in (("agf", agf), ("odds", odds)):
        seen = feed.select("race_id", F.col("captured_at").alias("_c")).join(base.select("race_id", "_limit"), "race_id").filter(
            F.col("_c") <= F.col("_limit")
        ).groupBy("race_id").agg(F.max("_c").alias(f"{name}_at"))
        base = base.join(seen, "race_id", "left")
    return base.withColumn("has_result", F.coalesce("has_result", F.lit(False))).withColumn(
        "has_final", F.col("final_prediction_at").isNotNull()
    ).drop("_limit")


def refresh_due(races: DataFrame, now: Column, last: str = "last_agf_at", start: str = "race_start_at") -> DataFrame:
    """Races of today's local day whose market capture is older than their cadence allows.

    With any race 10 minutes or less away, only the nearest start is considered at all.
    """
    ahead = races.filter(
        (F.col(start) > now) & (dates.local_day(start) == dates.local_day(now))
    ).withColumn("minutes_to_start", dates.minutes_between(now, F.col(start)))
    valid = F.col(last).isNotNull() & (F.col(last) <= now) & (F.col(last) < F.col(start))
    age = dates.minutes_between(F.col(last), now)
    tiered = ahead.withColumn("cadence_minutes", dates.cadence_minutes(F.col("minutes_to_start"))).withColumn(
        "is_due", ~valid | F.coalesce(age >= F.col("cadence_minutes"), F.lit(True))
    )
    nearest = ahead.agg(F.min(F.when(F.col("minutes_to_start") <= 10, F.col(start)))).scalar()
    chosen = F.col("is_due") & (nearest.isNull() | (F.col(start) == nearest))
    mode = F.when(nearest.isNotNull(), "urgent_10m_60s").otherwise("tiered_due")
    return tiered.filter(chosen).withColumn("mode", mode)
