"""As-of joins: the last observation before (or at) an instant, unmatched rows kept."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.operators import skew


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    left_time: str,
    right_time: str,
    values: dict[str, str],
    allow_exact: bool = False,
    tie_break: list[str] | None = None,
    left_unique: bool = False,
) -> DataFrame:
    """Attach to each left row the last right row of the same key.

    ``values`` maps right columns to output names. Both sides go through one shuffle on the
    key: they are unioned and the last observation is carried forward. ``allow_exact``
    decides whether an observation at the very instant counts. Observations at one instant
    are ordered by ``tie_break`` (right columns; the largest wins). ``left_unique`` says that the
    left side has a row per key, so that only the right one can have hot keys.
    """
    ties = tie_break or []
    observed = F.struct(*[F.col(src).alias(dst) for src, dst in values.items()])
    base = left.withColumns(
        {
            "_time": F.col(left_time),
            "_side": F.lit(1 if allow_exact else 0),
            "_seen": F.lit(None).cast(right.select(observed.alias("o")).schema["o"].dataType),
            **{f"_tie{i}": F.lit(None).cast(right.schema[t].dataType) for i, t in enumerate(ties)},
        }
    )
    feed = right.select(
        *on,
        F.col(right_time).alias("_time"),
        F.lit(0 if allow_exact else 1).alias("_side"),
        observed.alias("_seen"),
        *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)],
    )
    both = base.withColumn("_left", F.lit(True)).unionByName(
        feed.withColumn("_left", F.lit(False)), allowMissingColumns=True
    )
    order = ["_time", "_side", *[f"_tie{i}" for i in range(len(ties))]]
    with skew.checked(feed, on) if left_unique else nullcontext():
        carried = skew.running(
            both, on, order, {"_match": ("last", F.col("_seen"))}, include_current=False
        ).filter("_left")
    return carried.select(
        *left.columns, *[F.col(f"_match.{dst}").alias(dst) for dst in values.values()]
    )


def latest_before(
    targets: DataFrame,
    feed: DataFrame,
    on: list[str],
    start: str,
    captured: str,
    values: dict[str, str],
    allow_exact: bool = False,
) -> DataFrame:
    """Join-then-reduce form for feeds with a handful of rows per key.

    Useful when both sides are already partitioned by ``on``; partial aggregation keeps one
    observation per target and map task.
    """
    early = F.col("_captured") <= F.col(start) if allow_exact else F.col("_captured") < F.col(start)
    narrow = feed.select(
        *on,
        F.col(captured).alias("_captured"),
        *[F.col(src).alias(f"_f_{dst}") for src, dst in values.items()],
    )
    keys = targets.select(*on, start).distinct()
    best = (
        keys.join(narrow, on)
        .filter(early)
        .groupBy(*on, start)
        .agg(
            F.max(
                F.struct("_captured", *[f"_f_{dst}" for dst in values.values()])
            ).alias("_best")
        )
    )
    return targets.join(best, [*on, start], "left").select(
        *targets.columns, *[F.col(f"_best._f_{dst}").alias(dst) for dst in values.values()]
    )
