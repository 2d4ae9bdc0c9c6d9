"""Model diagnostics: one row per race and model, and the reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import bands, dates, jsonx, text
from furlong.operators import latest, sets, skew
from furlong.plans.evaluated import latest_programs, latest_results, match_keys
from furlong.schemas import MODELS

DIMENSIONS = {
    "surface": "surface_group",
    "breed": "breed_group",
    "race_type": "race_type_group",
    "distance": "distance_group",
    "field_size": "field_size_group",
}


def final_runs(predictions: DataFrame) -> DataFrame:
    return latest.latest_run(
        predictions, ["race_id"], "prediction_time",
        F.col("prediction_time") < F.col("race_start_at"),
    )


RUN_COLUMNS = [
    "race_id", "horse_id", "prediction_id", "prediction_time", "race_start_at",
    "model_version", "agf_percent", "agf_rank", "odds",
]


def rank_models(run: DataFrame, models: dict[str, str], extra: list[str] | None = None) -> DataFrame:
    """Long by model, ranked by probability. Whatever the rows need is joined before this
    point, while there is one row per entrant instead of one per entrant and model."""
    long = sets.unpivot_models(run, models, [*RUN_COLUMNS, *(extra or [])])
    return skew.ranked(long, ["race_id", "model"], ["-probability", "horse_id"], "model_rank")


def diagnostics(
    predictions: DataFrame,
    results: DataFrame,
    programs: DataFrame,
    prediction_results: DataFrame | None = None,
    models: dict[str, str] = MODELS,
) -> DataFrame:
    """Pick, winner, market favourite, hit depth, return and report buckets of each race.

    The winner is the (co-)winner the model ranked best. The return uses the odds known at
    prediction time. All models are computed together; filter on ``model`` for one.
    """
    prog = latest_programs(programs, latest.eligible_asof())
    meta = prog.groupBy("race_id").agg(
        F.max("race_start_at").alias("race_start_at"), F.max("race_no").alias("race_no"),
        F.coalesce(F.max("track"), F.lit(text.UNKNOWN_TRACK)).alias("track"),
        F.max("surface").alias("surface"), F.max("distance").alias("distance"),
        F.max("race_class").alias("race_class"), F.count(F.lit(1)).alias("horse_count"),
    )
    names = prog.select("race_id", "horse_id", "horse_name")
    res = latest_results(results)
    # The race's field is small, so everything about it is reduced in one grouped pass: the
    # pick, the best-ranked winner and the market favourite are minima under an order.
    run = final_runs(predictions).join(
        res.select("race_id", "horse_id", "finish_position", "result_odds"), ["race_id", "horse_id"], "left"
    ).join(names, ["race_id", "horse_id"], "left")
    if prediction_results is not None:
        run = run.join(prediction_results.select(*match_keys(prediction_results), "official_odds"), match_keys(prediction_results), "left")
    else:
        run = run.withColumn("official_odds", F.lit(None).cast("double"))
    rows = rank_models(run, models, ["finish_position", "result_odds", "horse_name", "official_odds"])
    body = F.struct(
        "horse_id", F.coalesce("horse_name", F.col("horse_id").cast("string")).alias("name"),
        "probability", "model_rank", "agf_percent", "agf_rank", "odds", "result_odds",
        "official_odds", "model_version", "prediction_time",
    )
    rank_key = F.struct("model_rank", "horse_id")
    market_key = F.struct(
        F.col("agf_rank").isNull().alias("n"), F.col("agf_rank").alias("r"),
        (-F.coalesce("agf_percent", F.lit(float("-inf")))).alias("p"), F.col("horse_id").alias("h"),
    )
    picked = rows.groupBy("race_id", "model").agg(
        F.min_by(body, rank_key).alias("t"),
        F.min_by(body, F.when(F.col("finish_position") == 1, rank_key)).alias("w"),
        F.min_by(body, market_key).alias("af"),
    ).filter(F.col("w").isNotNull())
    joined = picked.join(meta, "race_id")
    same = F.col("t.horse_id") == F.col("w.horse_id")
    market_hit = F.col("af.horse_id") == F.col("w.horse_id")
    top_odds = F.col("t.odds")
    return joined.select(
        "race_id", dates.local_day("race_start_at").alias("race_date"), "track", "race_no",
        "race_start_at", dates.local_clock("race_start_at").alias("race_time"),
        "surface", "distance", "race_class", "horse_count", "model",
        F.col("t.model_version").alias("model_version"),
        F.col("t.prediction_time").alias("prediction_time"),
        F.col("t.horse_id").alias("top1_horse_id"), F.col("t.name").alias("top1_horse"),
        F.col("t.probability").alias("top1_probability"),
        F.col("w.horse_id").alias("winner_horse_id"), F.col("w.name").alias("winner_horse"),
        F.col("w.model_rank").alias("winner_rank"),
        F.col("w.probability").alias("winner_probability"),
        (F.col("t.probability") - F.col("w.probability")).alias("probability_difference"),
        F.col("w.agf_percent").alias("winner_agf"), F.col("w.agf_rank").alias("winner_agf_rank"),
        F.col("af.horse_id").alias("agf_favorite_id"), F.col("af.name").alias("agf_favorite"),
        F.col("af.agf_percent").alias("agf_favorite_percent"),
        same.cast("int").alias("correct"),
        *[(F.col("w.model_rank") <= n).cast("int").alias(f"top{n}_correct") for n in (2, 3, 5)],
        F.when(same & ~market_hit, "model").when(market_hit & ~same, "market").otherwise("tied").alias("agf_comparison"),
        F.col("w.result_odds").alias("official_odds"),
        top_odds.alias("pre_race_odds"),
        F.coalesce(F.col("t.official_odds"), F.col("t.result_odds")).alias("bet_official_odds"),
        F.when(top_odds > 0, F.when(~same, -1.0).otherwise(top_odds - 1.0)).alias("net_return"),
        bands.surface_group(F.col("surface")).alias("surface_group"),
        bands.breed_group(F.col("race_class")).alias("breed_group"),
        bands.race_type_group(F.col("race_class")).alias("race_type_group"),
        bands.distance_group(F.col("distance")).alias("distance_group"),
        bands.field_size_group(F.col("horse_count")).alias("field_size_group"),
    )


def summary(diag: DataFrame) -> DataFrame:
    pct = lambda c: F.coalesce(100.0 * F.avg(c), F.lit(0.0))
    return diag.agg(
        F.count(F.lit(1)).alias("race_count"),
        pct("correct").alias("top1_accuracy"), pct("top2_correct").alias("top2_accuracy"),
        pct("top3_correct").alias("top3_accuracy"), pct("top5_correct").alias("top5_accuracy"),
        F.coalesce(F.sum("correct"), F.lit(0)).cast("bigint").alias("correct_races"),
        F.count_if(F.col("agf_comparison") == "model").alias("model_over_agf"),
        F.count_if(F.col("agf_comparison") == "market").alias("agf_over_model"),
        F.count_if(F.col("agf_comparison") == "tied").alias("tied"),
    )


def races_page(diag: DataFrame, page: int = 1) -> sets.Page:
    order = [F.col("race_start_at").desc(), F.col("race_no").desc(), F.col("race_id").asc(), F.col("model").asc()]
    return sets.Page.of(diag, order, page)


def winner_rank_histogram(diag: DataFrame) -> DataFrame:
    return diag.groupBy("winner_rank").agg(F.count(F.lit(1)).alias("race_count"))


def by_dimension(diag: DataFrame, dimensions: dict[str, str], metrics: list[Column]) -> DataFrame:
    """Several group-bys in one shuffle: dimensions become rows before the aggregation."""
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias("dimension"), F.col(c).cast("string").alias("group_name"))
            for label, c in dimensions.items()
        ]
    )
    long = diag.withColumn("_d", F.explode(pairs)).select("*", "_d.dimension", "_d.group_name")
    return long.groupBy("dimension", "group_name").agg(*metrics)


def group_performance(diag: DataFrame) -> DataFrame:
    return by_dimension(
        diag, DIMENSIONS,
        [
            F.count(F.lit(1)).alias("race_count"),
            (100.0 * F.avg("correct")).alias("top1_accuracy"),
            (100.0 * F.avg("top3_correct")).alias("top3_accuracy"),
            F.try_divide(100.0 * F.sum("net_return"), F.count("net_return")).alias("roi"),
            F.coalesce(F.sum("net_return"), F.lit(0.0)).alias("net_profit"),
        ],
    )


def extremes(diag: DataFrame, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """The most confident errors and the least confident hits."""
    errors = diag.filter("correct = 0").orderBy(F.col("top1_probability").desc(), "race_id", "model").limit(n)
    hits = diag.filter("correct = 1").orderBy(F.col("top1_probability").asc(), "race_id", "model").limit(n)
    return errors, hits


def filter_options(diag: DataFrame) -> DataFrame:
    """Sorted distinct values of every report dimension, one row per dimension."""
    columns = {
        "tracks": "track", "race_types": "race_type_group", "distances": "distance_group",
        "surfaces": "surface_group", "field_sizes": "field_size_group",
    }
    pairs = F.array(
        *[F.struct(F.lit(k).alias("dimension"), F.col(c).alias("value")) for k, c in columns.items()]
    )
    distinct = diag.select(F.explode(pairs).alias("p")).select("p.*").filter("value <> ''").distinct()
    return distinct.groupBy("dimension").agg(F.array_sort(F.collect_list("value")).alias("options"))


def confidence(top: Column, second: Column, correct: Column) -> Column:
    """High / Medium / Low by top probability and margin, with the outcome in the label."""
    margin = F.greatest(F.lit(0.0), top - second)
    level = (
        F.when((top >= 0.25) | (margin >= 0.10), "High")
        .when((top < 0.15) & (margin < 0.03), "Low")
        .otherwise("Medium")
    )
    suffix = F.when(correct, " Correct").otherwise(" Wrong")
    return F.when(level == "Medium", "Medium Confidence").otherwise(
        F.concat(level, F.lit(" Confidence"), suffix)
    )


def miss_reason(correct: Column, winner_rank: Column, gap: Column) -> Column:
    return (
        F.when(correct, "PICK_WON")
        .when((winner_rank <= 3) & (gap <= 0.03), "CLOSE_CONTENDER")
        .when((winner_rank <= 5) | (gap <= 0.07), "AMONG_CANDIDATES")
        .otherwise("NOT_CONSIDERED")
    )


def race_detail(predictions: DataFrame, results: DataFrame, models: dict[str, str] = MODELS) -> DataFrame:
    """Pick against winner per race and model: gap, confidence, reason, feature maps."""
    run = final_runs(predictions).join(
        latest_results(results).select("race_id", "horse_id", "finish_position"), ["race_id", "horse_id"], "left"
    )
    rows = rank_models(run, models, ["finish_position", "feature_values_json"])
    body = F.struct("horse_id", "probability", "model_rank", "feature_values_json")
    key = F.struct("model_rank", "horse_id")
    race = rows.groupBy("race_id", "model").agg(
        F.min_by(body, key).alias("s"),
        F.min_by(F.col("probability"), F.when(F.col("model_rank") == 2, key)).alias("second"),
        F.min_by(body, F.when(F.col("finish_position") == 1, key)).alias("w"),
    ).filter(F.col("w").isNotNull())
    correct = F.col("s.horse_id") == F.col("w.horse_id")
    gap = F.col("s.probability") - F.col("w.probability")
    return race.select(
        "race_id", "model",
        F.col("s.horse_id").alias("selected_id"), F.col("w.horse_id").alias("winner_id"),
        F.col("w.model_rank").alias("winner_rank"),
        correct.cast("int").alias("correct"), gap.alias("probability_difference"),
        confidence(F.col("s.probability"), F.coalesce("second", F.lit(0.0)), correct).alias("confidence"),
        miss_reason(correct, F.col("w.model_rank"), gap).alias("reason"),
        jsonx.decode_map(F.col("s.feature_values_json")).alias("selected_features"),
        jsonx.decode_map(F.col("w.feature_values_json")).alias("winner_features"),
    )


def feature_comparison(detail: DataFrame) -> DataFrame:
    """One row per feature named by either side; difference where both are numbers."""
    merged = F.map_zip_with(
        "selected_features", "winner_features",
        lambda k, a, b: F.struct(a.alias("selected"), b.alias("winner")),
    )
    rows = detail.select("race_id", "model", F.explode(merged).alias("feature", "v"))
    number = lambda c: c.try_cast("double")
    return rows.select(
        "race_id", "model", "feature",
        F.col("v.selected").alias("model_selection"), F.col("v.winner").alias("winner"),
        (number(F.col("v.selected")) - number(F.col("v.winner"))).alias("difference"),
        F.col("v.selected").eqNullSafe(F.col("v.winner")).alias("equal"),
    )
