"""Completeness, duplicates, missing values and table statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import text
from furlong.operators import latest
from furlong.operators.filters import is_missing


def field_completeness(df: DataFrame, race: list[str], finish: str) -> DataFrame:
    """Per race: do the observed finishes form exactly 1..N with N >= 2?

    Expected starters are a minimum (the largest finish seen); a race without any valid
    finish expects what was found.
    """
    valid = F.when((F.col(finish) > 0) & (F.col(finish) % 1 == 0), F.col(finish))
    # Distinct finishes are reduced first, so the distinct count needs no extra expansion.
    per_finish = df.groupBy(*race, valid.alias("_f")).agg(F.count(F.lit(1)).alias("_n"))
    stats = per_finish.groupBy(*race).agg(
        F.sum("_n").alias("found_starters"),
        F.coalesce(F.sum(F.when(F.col("_f").isNotNull(), F.col("_n"))), F.lit(0)).alias("_numeric"),
        F.count("_f").alias("_unique"),
        F.min("_f").alias("_min"),
        F.max("_f").alias("_max"),
    )
    found = F.col("found_starters")
    complete = (
        (found >= 2) & (F.col("_numeric") == found) & (F.col("_unique") == found)
        & (F.col("_min") == 1) & (F.col("_max") == found)
    )
    return stats.select(
        *race, "found_starters",
        F.coalesce(F.col("_max").cast("double"), found.cast("double")).alias("expected_starters_min"),
        F.greatest(F.lit(0.0), F.col("_max").cast("double") - F.col("_unique")).alias("missing_starters_min"),
        F.coalesce(complete, F.lit(False)).alias("race_field_complete"),
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fail when a key repeats (checked before a many-to-one join)."""
    if duplicate_keys(df, keys).head(1):
        raise ValueError(f"duplicate keys on {keys}")
    return df


def table_stats(tables: dict[str, DataFrame], keys: list[str], race: str = "race_id", time: str = "captured_at") -> DataFrame:
    """Rows, races, first and last capture and duplicate captures, one row per table."""
    out = None
    for name, df in tables.items():
        per_key = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.min(time).alias("_first"), F.max(time).alias("_last")
        )
        row = per_key.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_distinct(race).alias("races"),
            F.min("_first").alias("first_seen"), F.max("_last").alias("last_seen"),
            F.count_if(F.col("_n") > 1).alias("duplicate_captures"),
        ).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def missing_report(df: DataFrame, columns: list[str], sentinels: list[str] | None = None) -> DataFrame:
    """Missing count and percentage per column, in one pass over the table."""
    wide = df.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(is_missing(F.col(c), sentinels)).alias(c) for c in columns],
    )
    long = wide.unpivot(["_total"], columns, "field", "missing")
    return long.select(
        "field", "missing",
        F.round(F.coalesce(F.try_divide(100.0 * F.col("missing"), F.col("_total")), F.lit(0.0)), 2).alias("missing_pct"),
    )


def mean_quality(report: DataFrame) -> DataFrame:
    return report.agg(F.round(100.0 - F.avg("missing_pct"), 2).alias("profile_quality_pct"))


def nonzero_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count_if(F.col(c) > 0).alias(c) for c in columns]
    )
    return wide.unpivot(["total_rows"], columns, "feature_name", "non_zero_count").withColumn(
        "coverage_percent", F.try_divide(100.0 * F.col("non_zero_count"), F.col("total_rows"))
    )


def coverage_ratio(have: DataFrame, key: str, of: DataFrame, label: str) -> DataFrame:
    """Distinct keys present in ``have`` as a percentage of the rows of ``of``."""
    total = of.agg(F.greatest(F.lit(1), F.count(F.lit(1)))).scalar()
    return have.agg(
        F.lit(label).alias("label"), F.count_distinct(key).alias("have")
    ).withColumn("total", total).withColumn("pct", F.round(100.0 * F.col("have") / F.col("total"), 2))


def year_distribution(df: DataFrame, day: str, race: str) -> DataFrame:
    return (
        df.filter(F.col(day).isNotNull())
        .groupBy(F.year(day).alias("year"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(race).alias("races"))
    )


def category_statistics(
    df: DataFrame, horse: str, categories: dict[str, Column], is_win: Column, prize: str
) -> DataFrame:
    """Per horse and dimension: map of category -> (starts, wins, prize_known)."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("category")) for n, c in categories.items()]
    )
    long = df.select(
        horse, F.coalesce(is_win, F.lit(False)).alias("_win"), F.col(prize).isNotNull().alias("_prize"),
        F.explode(pairs).alias("_d"),
    ).select(horse, "_win", "_prize", "_d.*").filter(F.col("category").isNotNull())
    counts = long.groupBy(horse, "dimension", "category").agg(
        F.count(F.lit(1)).alias("starts"), F.count_if("_win").alias("wins"), F.count_if("_prize").alias("prize_known")
    )
    return counts.groupBy(horse, "dimension").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("category", F.struct("starts", "wins", "prize_known").alias("v"))))
        ).alias("stats")
    )


def supported_cities(df: DataFrame, city: str) -> DataFrame:
    """Distinct supported cities by folded key, first spelling kept."""
    cleaned = df.select(text.clean_track(city).alias("city"))
    keyed = cleaned.select("city", text.fold("city").alias("city_key"), text.track_policy("city").alias("policy"))
    return keyed.filter("policy <> 'unsupported'").groupBy("city_key").agg(F.min("city").alias("city"))


def race_rollup(programs: DataFrame) -> DataFrame:
    """Start, track and number of each race from the latest row of each entrant."""
    newest = latest.latest_by(
        programs, ["race_id", "horse_id"], [F.col("captured_at").desc(), F.col("snapshot_id").desc()]
    )
    return newest.groupBy("race_id").agg(
        F.max("race_start_at").alias("race_start_at"), F.max("track").alias("track"),
        F.max("race_no").alias("race_no"), F.count(F.lit(1)).alias("horse_count"),
    )


def count_deltas(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in after:
        n0 = before[name].agg(F.count(F.lit(1))).scalar()
        row = after[name].agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows_after")).withColumn("rows_before", n0)
        out = row if out is None else out.unionByName(row)
    return out.withColumn("delta", F.col("rows_after") - F.col("rows_before")).select(
        "table", "rows_before", "rows_after", "delta"
    )


def status_split(catalog: DataFrame, probes: DataFrame, key: str, status: str = "status_class") -> DataFrame:
    """Rows per probe status, with enabled entries never probed as their own status."""
    enabled = catalog.filter("enabled = 1")
    probed = probes.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    rest = enabled.join(probes.select(key), key, "left_anti").agg(
        F.lit("unprobed").alias(status), F.count(F.lit(1)).alias("n")
    )
    return probed.unionByName(rest)


def group_sum_check(df: DataFrame, group: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Does each group's sum equal one?"""
    from furlong.operators import skew

    out = skew.group_totals(df, group, {"probability_sum": F.sum(value)})
    return out.withColumn("probability_sum_valid", F.abs(F.col("probability_sum") - 1.0) <= tolerance)
