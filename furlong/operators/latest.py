"""Latest row, latest run and first-by-precedence per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators import skew


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key, with their position.

    Spark limits each key to ``n`` rows per map task before the shuffle (window group
    limit), so a hot key costs no more than a cold one.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def latest_by(
    df: DataFrame, keys: list[str], order: list[Column], eligible: Column | None = None
) -> DataFrame:
    """One row per key: the first in ``order`` among the eligible rows."""
    if eligible is not None:
        df = df.filter(eligible)
    return top_n(df, keys, order, 1, "_rn").drop("_rn")


def eligible_asof(captured: str = "captured_at", start: str = "race_start_at") -> Column:
    """Strictly before the start; equal instants are too late."""
    return F.col(captured) < F.col(start)


def latest_run(
    df: DataFrame, keys: list[str], time_col: str, eligible: Column | None = None
) -> DataFrame:
    """All rows carrying the latest (eligible) time of their key."""
    if eligible is not None:
        df = df.filter(eligible)
    return (
        skew.group_totals(df, keys, {"_latest": F.max(time_col)})
        .filter(F.col(time_col) == F.col("_latest"))
        .drop("_latest")
    )


def extreme_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The full row that is best under ``order`` (favourite, best race, worst track)."""
    return latest_by(df, keys, order)
