"""Live-monitoring reports over diagnostics rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions import bands, dates, jsonx, text
from furlong.plans.diagnostics import by_dimension


def metrics(stake: float = 1.0) -> list[Column]:
    rank, market, odds = F.col("winner_rank"), F.col("winner_agf_rank"), F.col("bet_official_odds")
    net = F.when(odds.isNotNull(), F.when(rank == 1, stake * (odds - 1.0)).otherwise(-stake))
    pct = lambda n: F.try_divide(100.0 * F.count_if(rank <= n), F.count(F.lit(1)))
    return [
        F.count(F.lit(1)).alias("evaluated_race_count"),
        *[F.coalesce(pct(n), F.lit(0.0)).alias(f"top{n}_accuracy") for n in (1, 3, 5)],
        F.coalesce(F.avg(rank.cast("double")), F.lit(0.0)).alias("average_winner_rank"),
        F.coalesce(F.median(rank), F.lit(0.0)).alias("median_winner_rank"),
        F.count(odds).alias("roi_bet_count"),
        F.coalesce(F.try_divide(100.0 * F.sum(net), stake * F.count(odds)), F.lit(0.0)).alias("roi_percent"),
        F.coalesce(F.sum(net), F.lit(0.0)).alias("net_profit"),
        F.count_if(rank < market).alias("model_over_agf"),
        F.count_if(market < rank).alias("agf_over_model"),
        F.count_if(market == rank).alias("tied_with_agf"),
    ]


def by_model(diag: DataFrame) -> DataFrame:
    return diag.groupBy("model").agg(*metrics())


def segments(diag: DataFrame) -> DataFrame:
    banded = diag.withColumns(
        {
            "_odds": bands.odds_band(F.col("bet_official_odds")),
            "_market": bands.market_band(F.col("winner_agf_rank")),
        }
    )
    return by_dimension(
        banded,
        {
            "track": "track", "distance": "distance_group", "surface": "surface_group",
            "field_size": "field_size_group", "race_type": "race_type_group",
            "odds": "_odds", "agf_rank": "_market",
        },
        metrics(),
    )


def rolling_daily(diag: DataFrame, spans: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Daily top-1 accuracy and its pooled rolling means (ratio of sums, not mean of days).

    Reduced to one row per calendar day before the ordered window.
    """
    daily = diag.groupBy("race_date").agg(
        F.count(F.lit(1)).alias("evaluated_race_count"),
        F.sum((F.col("winner_rank") == 1).cast("long")).alias("_hits"),
        (100.0 * F.count_if(F.col("winner_rank") == 1) / F.count(F.lit(1))).alias("top1_accuracy"),
    )
    out = daily.withColumn("_day", F.unix_date("race_date"))
    for span in spans:
        # one row per calendar day: a few thousand rows for any data volume
        window = Window.orderBy("_day").rangeBetween(1 - span, 0)
        out = out.withColumn(
            f"rolling_{span}_top1_accuracy",
            100.0 * F.sum("_hits").over(window) / F.sum("evaluated_race_count").over(window),
        )
    return out.drop("_day", "_hits")


def model_winner_rank(diag: DataFrame) -> DataFrame:
    return diag.groupBy("model", "race_date").agg(
        F.avg(F.col("winner_rank").cast("double")).alias("average_winner_rank")
    )


def summary(diag: DataFrame) -> DataFrame:
    """Overall metrics with best model and best and worst track (first name wins ties)."""
    overall = diag.agg(
        *metrics(),
        F.count_distinct("race_date").alias("live_prediction_days"),
        F.count_distinct("race_id").alias("total_evaluated_races"),
        F.count(F.lit(1)).alias("total_predictions"),
    )
    hit = 100.0 * F.avg((F.col("winner_rank") == 1).cast("double"))
    per_model = diag.groupBy("model").agg(hit.alias("a"))
    per_track = diag.groupBy(F.coalesce("track", F.lit(text.UNKNOWN_TRACK)).alias("track")).agg(hit.alias("a"))
    best = lambda c: F.min_by(F.col(c), F.struct((-F.col("a")).alias("p"), F.col(c).alias("n")))
    worst = lambda c: F.min_by(F.col(c), F.struct("a", F.col(c).alias("n")))
    models = per_model.agg(best("model").alias("best_model")).withColumn("_k", F.lit(1))
    tracks = per_track.agg(best("track").alias("best_track"), worst("track").alias("worst_track")).withColumn("_k", F.lit(1))
    return overall.withColumn("_k", F.lit(1)).join(models, "_k").join(tracks, "_k").drop("_k")


def null_rates(rows: DataFrame, json_column: str, top: int | None = None) -> DataFrame:
    """Share of NULL per JSON key; with `top` only the worst so many, worst first."""
    long = rows.select(F.explode(jsonx.decode_map(json_column)).alias("feature", "value"))
    rates = long.groupBy("feature").agg((100.0 * F.avg(F.col("value").isNull().cast("double"))).alias("null_rate"))
    return rates if top is None else rates.orderBy(F.col("null_rate").desc(), "feature").limit(top)


def health(programs: DataFrame, predictions: DataFrame, results: DataFrame, diag: DataFrame, low: str, high: str) -> DataFrame:
    """Missing predictions, unmatched results and missing prices of a local-day range."""
    window = dates.local_day("race_start_at").between(F.lit(low).cast("date"), F.lit(high).cast("date"))
    one = lambda df, name: df.agg(F.count_distinct("race_id").alias(name)).withColumn("_k", F.lit(1))
    program = one(programs.filter(window), "_program")
    predicted = one(predictions.filter(window & (F.col("prediction_time") < F.col("race_start_at"))), "_predicted")
    finished = one(
        results.filter(window & (F.col("result_status") == "finished") & (F.col("finish_position") == 1)), "_result"
    )
    rows = diag.filter(F.col("race_date").between(F.lit(low).cast("date"), F.lit(high).cast("date"))).agg(
        F.count_if(F.col("bet_official_odds").isNull()).alias("missing_odds_count"),
        F.count_if(F.col("winner_agf_rank").isNull()).alias("missing_agf_count"),
    ).withColumn("_k", F.lit(1))
    zero = F.lit(0).cast("bigint")
    return program.join(predicted, "_k").join(finished, "_k").join(rows, "_k").select(
        F.greatest(zero, F.col("_program") - F.col("_predicted")).alias("prediction_missing_races"),
        F.greatest(zero, F.col("_predicted") - F.col("_result")).alias("result_unmatched_races"),
        "missing_odds_count", "missing_agf_count",
    )


def lifecycle_counts(lifecycle: DataFrame, status: str = "status") -> DataFrame:
    return lifecycle.groupBy(status).agg(F.count(F.lit(1)).alias("count"))


def latest_monitoring_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("run_at").desc()).limit(1)
