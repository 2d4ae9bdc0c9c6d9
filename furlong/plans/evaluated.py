"""Evaluated top picks: one row per race and model, and the performance reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import dates, text
from furlong.operators import filters, latest, sets, skew
from furlong.schemas import MODELS


def latest_results(results: DataFrame) -> DataFrame:
    return latest.latest_by(
        results, ["race_id", "horse_id"],
        [F.col("captured_at").desc(), F.col("result_id").desc()], filters.finished(),
    )


def latest_programs(programs: DataFrame, eligible: Column | None = None) -> DataFrame:
    return latest.latest_by(
        programs, ["race_id", "horse_id"],
        [F.col("captured_at").desc(), F.col("snapshot_id").desc()], eligible,
    )


def top_picks(predictions: DataFrame, models: dict[str, str]) -> DataFrame:
    """Best horse of each model in the latest pre-start run of each race.

    max_by per model over partial aggregates: the rows are never expanded per model before
    they have been reduced to one candidate per race, run and model.
    """
    early = predictions.filter(F.col("prediction_time") < F.col("race_start_at"))
    payload = ["prediction_id", "horse_id", "model_version", "odds"]
    best = [
        F.min_by(
            F.struct(*payload, F.col(column).alias("probability")),
            # Without a score there is no order key, so an unscored horse is never the best.
            F.when(F.col(column).isNotNull(), F.struct((-F.col(column)).alias("p"), F.col("horse_id").alias("h"))),
        ).alias(model)
        for model, column in models.items()
    ]
    runs = early.groupBy("race_id", "prediction_time").agg(
        F.max("race_start_at").alias("race_start_at"), *best
    )
    newest = latest.latest_by(runs, ["race_id"], [F.col("prediction_time").desc()])
    entries = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).alias("pick")) for m in models]
    )
    return newest.select(
        "race_id", "prediction_time", "race_start_at", F.explode(entries).alias("_e")
    ).select("race_id", "prediction_time", "race_start_at", "_e.model", "_e.pick.*").filter(
        F.col("probability").isNotNull()
    )


def entrants(results: DataFrame, programs: DataFrame) -> DataFrame:
    """Programme and result of every entrant side by side.

    Both sides are already partitioned by (race, horse) from picking their latest rows, so
    the join moves nothing.
    """
    return programs.select(
        "race_id", "horse_id", "horse_name", "race_class", "surface", "distance", "track", "race_no"
    ).join(results.select("race_id", "horse_id", "finish_position", "result_odds"), ["race_id", "horse_id"], "full")


def winners(field: DataFrame) -> DataFrame:
    """Winner set, city and number per race; a dead heat keeps every winner."""
    won = F.col("finish_position") == 1
    named = F.struct("horse_id", F.coalesce("horse_name", F.col("horse_id").cast("string")).alias("n"))
    return field.groupBy("race_id").agg(
        F.array_sort(F.collect_list(F.when(won, named))).alias("_w"),
        F.max(F.when(won, F.col("result_odds"))).alias("winner_decimal_odds"),
        F.max("track").alias("city"), F.max("race_no").alias("race_no"),
    ).filter(F.size("_w") > 0).select(
        "race_id", F.transform("_w", lambda w: w["horse_id"]).alias("winner_ids"),
        F.array_join(F.transform("_w", lambda w: w["n"]), ", ").alias("winner_name"),
        "winner_decimal_odds", "city", "race_no",
    )


def match_keys(prediction_results: DataFrame) -> list[str]:
    """Keys of a matched prediction. A prediction is of one race; where the table names it, rows
    are joined inside of their race."""
    return ["race_id", "prediction_id"] if "race_id" in prediction_results.columns else ["prediction_id"]


def evaluated(
    predictions: DataFrame,
    results: DataFrame,
    programs: DataFrame,
    prediction_results: DataFrame,
    models: dict[str, str] = MODELS,
) -> DataFrame:
    """Was each model's pick among the winners, at which odds, for which return.

    Odds of a correct pick: official, else its own result odds, else the best winner odds.
    Return: -1 when wrong, odds - 1 when right and priced, NULL when right but unpriced.
    """
    field = entrants(latest_results(results), latest_programs(programs))
    picks = top_picks(predictions, models)
    unknown = F.lit(text.UNKNOWN_TRACK)
    core = (
        picks.join(winners(field), "race_id")
        .join(prediction_results.select(*match_keys(prediction_results), "official_odds"), match_keys(prediction_results), "left")
        .join(
            field.select(
                "race_id", "horse_id", "horse_name", "race_class", "surface", "distance",
                F.col("result_odds").alias("_own_odds"),
            ),
            ["race_id", "horse_id"], "left",
        )
    )
    hit = F.array_contains("winner_ids", F.col("horse_id"))
    odds = F.when(hit, F.coalesce("official_odds", "_own_odds", "winner_decimal_odds"))
    return core.select(
        "prediction_id", "race_id", "prediction_time", "race_start_at", "model", "model_version",
        "probability",
        F.col("horse_id").alias("predicted_horse_id"),
        F.coalesce("horse_name", F.col("horse_id").cast("string")).alias("predicted_horse"),
        "winner_name", "winner_ids",
        F.coalesce("city", unknown).alias("city"), "race_no",
        F.coalesce("race_class", unknown).alias("race_class"),
        F.coalesce("surface", unknown).alias("surface"),
        F.coalesce("distance", F.lit(0.0)).alias("distance"),
        dates.local_day("race_start_at").alias("race_date"),
        dates.local_clock("race_start_at").alias("race_time"),
        hit.cast("int").alias("correct"),
        odds.alias("decimal_odds"),
        "winner_decimal_odds",
        F.when(~hit, -1.0).when(odds > 0, odds - 1.0).alias("net_return"),
    )


def source(materialised: DataFrame | None, live: DataFrame) -> DataFrame:
    """The materialised table when it holds rows, else the live plan."""
    if materialised is not None and materialised.head(1):
        return materialised
    return live


def _report() -> list[Column]:
    accuracy = F.coalesce(100.0 * F.avg("correct"), F.lit(0.0))
    roi = F.coalesce(F.try_divide(100.0 * F.sum("net_return"), F.count("net_return")), F.lit(0.0))
    return [
        F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("correct"),
        accuracy.alias("accuracy_percent"),
        roi.alias("roi_percent"),
        F.coalesce(F.sum("net_return"), F.lit(0.0)).alias("net_profit"),
        F.count("net_return").alias("roi_bets"),
    ]


def summary(ev: DataFrame, condition: Column | None = None) -> DataFrame:
    df = ev.filter(condition) if condition is not None else ev
    return df.agg(
        F.count(F.lit(1)).alias("total_predictions"),
        *_report(),
        F.count_distinct("race_id").alias("processed_races"),
    ).withColumn("has_data", F.col("total_predictions") > 0).withColumnRenamed("correct", "correct_predictions")


def by_model(ev: DataFrame, models: list[str], condition: Column | None = None) -> DataFrame:
    """One row per known model, zero-filled where it has no prediction."""
    df = ev.filter(condition) if condition is not None else ev
    found = df.groupBy("model").agg(F.count(F.lit(1)).alias("predictions"), *_report())
    names = df.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return names.join(found, "model", "left").fillna(0).select(
        "model", "predictions", "correct", "accuracy_percent", "roi_percent", "net_profit", "roi_bets"
    )


def history_order(models: list[str]) -> list[Column]:
    return [
        F.col("race_start_at").desc(), F.col("prediction_time").desc(),
        sets.ordered_label(F.col("model"), models).asc(), F.col("race_id").asc(),
    ]


def history_page(
    ev: DataFrame, models: list[str], condition: Column | None = None, page: int = 1, size: int = sets.PAGE_SIZE
) -> sets.Page:
    df = ev.filter(condition) if condition is not None else ev
    return sets.Page.of(df, history_order(models), page, size)


def daily_chart(ev: DataFrame, condition: Column | None = None, days: int = 30) -> DataFrame:
    """The latest days with bets, cumulated from the oldest of them on."""
    df = ev.filter(condition) if condition is not None else ev
    daily = df.groupBy("race_date").agg(
        F.count(F.lit(1)).alias("predictions"),
        (100.0 * F.avg("correct")).alias("accuracy_percent"),
        F.try_divide(100.0 * F.sum("net_return"), F.count("net_return")).alias("roi_percent"),
        F.coalesce(F.sum("net_return"), F.lit(0.0)).alias("daily_profit"),
    )
    recent = daily.orderBy(F.col("race_date").desc()).limit(days)
    return skew.running(
        recent, [], ["race_date"], {"cumulative_profit": ("sum", F.col("daily_profit"))}, include_current=True
    )


def track_options(ev: DataFrame) -> DataFrame:
    """Tracks grouped by their folded key, with one spelling and the dates covered."""
    return ev.groupBy(text.track_key("city").alias("track_key")).agg(
        F.min("city").alias("city"),
        F.count_distinct("race_id").alias("races"),
        F.min("race_date").alias("first_date"),
        F.max("race_date").alias("last_date"),
    )
