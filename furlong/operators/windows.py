"""Per-participant history windows and ordered scans. Never looks at the current outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators import skew


def rolling_prior_mean(
    df: DataFrame,
    key: list[str],
    order: skew.Order,
    value: str,
    sizes: dict[int, str],
    skip_nulls: bool = False,
) -> DataFrame:
    """Mean of the last N earlier rows.

    By default a NULL occupies its place among the N rows and is only left out of the mean.
    With ``skip_nulls`` the N latest non-NULL values are averaged instead.
    """
    depth = max(sizes)
    if not skip_nulls:
        return skew.bounded(
            df, key, order, depth,
            lambda w: {
                name: F.avg(value).over(w.rowsBetween(-n, -1)) for n, name in sizes.items()
            },
        )
    # State after each non-NULL row, then the latest such state before every row.
    marked = df.withColumn("_known", F.col(value).isNotNull())
    states = skew.bounded(
        marked, [*key, "_known"], order, depth,
        lambda w: {
            "_state": F.when(
                F.col("_known"),
                F.struct(
                    *[F.avg(value).over(w.rowsBetween(1 - n, 0)).alias(name) for n, name in sizes.items()]
                ),
            )
        },
    )
    carried = skew.running(states, key, order, {"_prior": ("last", F.col("_state"))})
    return carried.withColumns(
        {name: F.col(f"_prior.{name}") for name in sizes.values()}
    ).drop("_known", "_state", "_prior")


def prior_rate(
    df: DataFrame,
    key: list[str],
    category: str | Column,
    order: skew.Order,
    is_win: Column,
    name: str,
    missing: str = "own_key",
) -> DataFrame:
    """Share of earlier starts in the same category that were won; NULL without any.

    ``missing`` says what a NULL category does: ``own_key`` treats it as a category of its
    own, ``null`` gives NULL. Data already partitioned by ``key`` is not shuffled again.
    """
    value = F.col(category) if isinstance(category, str) else category
    df = df.withColumn("_cat", value)
    out = skew.running(
        df, [*key, "_cat"], order,
        {
            "_wins": ("sum", F.when(is_win, 1.0).otherwise(0.0)),
            "_starts": ("count", F.lit(1)),
        },
    )
    rate = F.when(F.col("_starts") > 0, F.col("_wins") / F.col("_starts"))
    if missing == "null":
        rate = F.when(F.col("_cat").isNotNull(), rate)
    return out.withColumn(name, rate).drop("_cat", "_wins", "_starts")


def lag_columns(df: DataFrame, key: list[str], order: skew.Order, columns: dict[str, str]) -> DataFrame:
    """Previous row's values of the same participant."""
    return skew.bounded(
        df, key, order, 1,
        lambda w: {name: F.lag(column).over(w) for column, name in columns.items()},
    )


def change_flag(current: Column, previous: Column, first: int | None = None) -> Column:
    """1 when the value differs from the previous one.

    ``first`` is returned where there is nothing to compare with: 1 for the dataset dialect,
    NULL for the as-of dialect.
    """
    known = current.isNotNull() & previous.isNotNull()
    return F.when(known, (current != previous).cast("int")).otherwise(F.lit(first).cast("int"))


def days_between(later: Column, earlier: Column, whole: bool) -> Column:
    if whole:
        return F.date_diff(later, earlier).cast("double")
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def same_day_alone(df: DataFrame, key: list[str], day: str, name: str = "order_certified") -> DataFrame:
    """True where the participant has one start that day, so the order is certain."""
    return (
        skew.group_totals(df, [*key, day], {"_n": F.count(F.lit(1))})
        .withColumn(name, F.col("_n") == 1)
        .drop("_n")
    )


def normalise_in_group(df: DataFrame, group: list[str], columns: dict[str, str]) -> DataFrame:
    """score / sum of scores in the group; an even share when the sum is not positive."""
    totals = {f"_sum_{c}": F.sum(c) for c in columns}
    out = skew.group_totals(df, group, {**totals, "_n": F.count(F.lit(1))})
    shares = {
        name: F.when(F.col(f"_sum_{c}") > 0, F.col(c) / F.col(f"_sum_{c}")).otherwise(
            F.lit(1.0) / F.col("_n")
        )
        for c, name in columns.items()
    }
    return out.withColumns(shares).drop(*totals, "_n")


def row_mean(columns: list[str]) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / F.lit(float(len(columns)))


def rank_first(
    df: DataFrame, group: list[str], score: str, tie: list[str], name: str = "predicted_rank"
) -> DataFrame:
    """Rank by score descending with an explicit tie-break instead of the row order."""
    return skew.ranked(df, group, [f"-{score}", *tie], name)


def drawdown(df: DataFrame, part: list[str], order: skew.Order, profit: str) -> DataFrame:
    """Cumulative profit and distance from its running peak; the peak starts at 0."""
    cumulated = skew.running(
        df, part, order, {"cumulative_profit": ("sum", F.col(profit))}, include_current=True
    )
    peaked = skew.running(
        cumulated, part, order, {"_peak": ("max", F.col("cumulative_profit"))}, include_current=True
    )
    return peaked.withColumn(
        "drawdown", F.greatest(F.lit(0.0), F.col("_peak")) - F.col("cumulative_profit")
    ).drop("_peak")


def longest_streaks(df: DataFrame, part: list[str], order: skew.Order, hit: Column) -> DataFrame:
    """Longest run of hits and of misses per part (gaps and islands).

    A run is named by the number of opposite outcomes before it, so runs are counted with an
    ordinary grouped count and no row sequence is collected.
    """
    marked = df.withColumn("_hit", hit.cast("int"))
    runs = skew.running(
        marked, part, order,
        {"_hits": ("sum", F.col("_hit")), "_misses": ("sum", 1 - F.col("_hit"))},
    )
    lengths = (
        runs.withColumn("_run", F.when(F.col("_hit") == 1, F.col("_misses")).otherwise(F.col("_hits")))
        .groupBy(*part, "_hit", "_run")
        .agg(F.count(F.lit(1)).alias("_len"))
    )
    return lengths.groupBy(*part).agg(
        F.coalesce(F.max(F.when(F.col("_hit") == 1, F.col("_len"))), F.lit(0)).alias("longest_win"),
        F.coalesce(F.max(F.when(F.col("_hit") == 0, F.col("_len"))), F.lit(0)).alias("longest_loss"),
    )


def trailing_event_counts(
    targets: DataFrame,
    events: DataFrame,
    key: list[str],
    day: str,
    event_day: str,
    counts: dict[str, tuple[int, Column]],
) -> DataFrame:
    """Events of the key in the calendar days [day - span, day - 1] before each target.

    Events are reduced to one row per key and day first, and each span is the difference of
    two running totals: total before ``day`` minus total before ``day - span``. Each total is
    an as-of lookup, so no event is ever paired with every target.
    """
    from furlong.operators.asof import asof_join

    daily = events.groupBy(*key, F.col(event_day).alias("_eday")).agg(
        *[F.count_if(cond).alias(f"_n_{name}") for name, (_, cond) in counts.items()]
    )
    totals = skew.running(
        daily, key, ["_eday"],
        {f"_t_{name}": ("sum", F.col(f"_n_{name}")) for name in counts},
        include_current=True,
    )
    state = {f"_t_{name}": f"_b_{name}" for name in counts}
    out = asof_join(targets, totals, key, day, "_eday", state)
    for span in sorted({s for s, _ in counts.values()}):
        names = [n for n, (s, _) in counts.items() if s == span]
        out = out.withColumn("_from", F.date_sub(day, span))
        out = asof_join(
            out, totals, key, "_from", "_eday", {f"_t_{n}": f"_a_{n}" for n in names}
        ).drop("_from")
    zero = F.lit(0)
    out = out.withColumns(
        {
            n: F.coalesce(F.col(f"_b_{n}"), zero) - F.coalesce(F.col(f"_a_{n}"), zero)
            for n in counts
        }
    )
    return out.drop(*[f"_b_{n}" for n in counts], *[f"_a_{n}" for n in counts])
