"""Result coverage, race-day view, live status and prediction-result comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions import dates, text
from furlong.operators import filters, latest, resolve
from furlong.plans.evaluated import latest_programs, match_keys

# Reasons in the order in which one decides a race's status.
REASON_PRIORITY = [
    "SOURCE_UNSUPPORTED", "ID_MISSING", "DB_WRITE_ERROR", "API_ERROR",
    "AMBIGUOUS_PROGRAM_MATCH", "PROVIDER_RESULT_NOT_PUBLISHED", "DATA_MISSING",
]
WRITE_ERROR_WORDS = "sqlite|write|database|normalization"


def entity(horse_id: Column) -> Column:
    return F.when(horse_id.rlike("^(horse|registry):"), horse_id).otherwise(F.concat(F.lit("horse:"), horse_id))


def horse_reasons(
    programs: DataFrame, results: DataFrame, history: DataFrame, errors: DataFrame, country: str = "ALL"
) -> DataFrame:
    """Why each programme entrant has no result yet.

    Rows stay with their race (race_id is not NULL); see README on coverage.
    programs: race_id, horse_id, horse_name, race_no, race_start_at, track, registry_id (one
    row per entrant); history: horse_key, day, finish; errors: entity_key, day, error_id,
    error_type, message.
    """
    rows = programs.filter(filters.in_country("track", country)).withColumns(
        {
            "day": dates.local_day("race_start_at"),
            "track": text.clean_track("track"),
            "entity_key": entity(F.col("horse_id").cast("string")),
            "registry_key": F.concat(F.lit("registry:"), F.col("registry_id")),
        }
    ).withColumn("track_policy", text.track_policy("track"))
    won = results.filter("result_status = 'finished' AND finish_position = 1").select("race_id").distinct()
    rows = filters.flag_existing(rows, won, ["race_id"], "result_fetched")

    # What errors, history and the programme know of a key and day, in one group each.
    wrong = F.lower(F.concat_ws(" ", "error_type", "message")).rlike(WRITE_ERROR_WORDS)
    facts = errors.select(F.col("entity_key").alias("_key"), "day", F.struct("error_id", wrong.alias("w")).alias("_e"))
    facts = facts.unionByName(
        history.select(
            F.col("horse_key").alias("_key"), "day", F.lit(1).alias("_n"), (~filters.is_missing(F.col("finish"), ["not_available"])).alias("_p")
        ),
        allowMissingColumns=True,
    ).unionByName(rows.select(F.col("registry_key").alias("_key"), "day", F.col("race_id").alias("_race")), allowMissingColumns=True)
    known = facts.filter("_key IS NOT NULL AND day IS NOT NULL").groupBy("_key", "day").agg(
        F.max("_e")["w"].alias("_w"), F.count("_n").alias("_n"), F.max("_p").alias("_p"),
        (F.min("_race") != F.max("_race")).alias("_races"),
    )
    # Only entrants whose reason the race and its track leave open look them up; they travel as keys.
    is_open = ~F.col("result_fetched") & (F.col("track_policy") != "unsupported") & F.col("registry_id").isNotNull()
    keys = ["race_id", "entity_key", "registry_key", "day"]
    looked_up = rows.filter(is_open).select(*keys).distinct()
    for prefix in ("entity", "registry"):
        looked_up = looked_up.join(
            known.select(F.col("_key").alias(f"{prefix}_key"), "day", *[F.col(f"_{c}").alias(f"_{prefix}_{c}") for c in ("w", "n", "p", "races")]),
            [f"{prefix}_key", "day"], "left",
        )
    error = F.coalesce("_entity_w", "_registry_w")
    is_published = F.coalesce("_entity_p", F.lit(False)) | F.coalesce("_registry_p", F.lit(False))
    zero = F.lit(0)
    runs = F.coalesce("_entity_n", zero) + F.when(
        F.col("entity_key") != F.col("registry_key"), F.coalesce("_registry_n", zero)
    ).otherwise(zero)
    found = (
        F.when(error, "DB_WRITE_ERROR")
        .when(error.isNotNull(), "API_ERROR")
        .when(~is_published, "PROVIDER_RESULT_NOT_PUBLISHED")
        .when(F.coalesce("_registry_races", F.lit(False)) | (runs > 1), "AMBIGUOUS_PROGRAM_MATCH")
        .otherwise("DATA_MISSING")
    )
    reasons = looked_up.select(*[F.col(c).alias(f"_r_{c}") for c in keys], found.alias("_found"))
    same = F.col("race_id") == F.col("_r_race_id")
    for c in keys[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    reason = (
        F.when(F.col("result_fetched"), "RESULT_CAPTURED")
        .when(F.col("track_policy") == "unsupported", "SOURCE_UNSUPPORTED")
        .when(F.col("registry_id").isNull(), "ID_MISSING")
        .otherwise(F.col("_found"))
    )
    return rows.join(reasons, same, "left").withColumn("missing_reason", reason).drop(
        *[f"_r_{c}" for c in keys], "_found", "entity_key", "registry_key"
    )


def race_coverage(horses: DataFrame) -> DataFrame:
    """One row per race: status, reasons, and how many entrants each cause concerns."""
    def count(reason: str) -> Column:
        return F.count_if(F.col("missing_reason") == reason)

    races = horses.groupBy("race_id").agg(
        F.max("day").alias("day"), F.max("track").alias("track"), F.max("track_policy").alias("track_policy"),
        F.max("race_no").alias("race_no"), F.max("race_start_at").alias("race_start_at"),
        F.count(F.lit(1)).alias("horse_count"), F.bool_or("result_fetched").alias("result_fetched"),
        F.array_sort(F.collect_set("missing_reason")).alias("_reasons"),
        count("ID_MISSING").alias("id_missing_horse_count"),
        count("PROVIDER_RESULT_NOT_PUBLISHED").alias("source_not_published_count"),
    )
    decisive = F.try_element_at(
        F.filter(F.array(*[F.lit(r) for r in REASON_PRIORITY]), lambda r: F.array_contains("_reasons", r)), F.lit(1)
    )
    return races.withColumns(
        {
            "missing_reason": F.array_join("_reasons", ","),
            "status": F.when(F.col("result_fetched"), "RESULT_CAPTURED").otherwise(F.coalesce(decisive, F.lit("DATA_MISSING"))),
        }
    ).drop("_reasons")


def track_coverage(races: DataFrame) -> DataFrame:
    missing = ~F.col("result_fetched")
    rows = races.withColumn("_r", F.when(missing, F.split("missing_reason", ",")))
    reasons = F.array_sort(F.array_distinct(F.flatten(F.collect_set("_r"))))
    return rows.groupBy("day", "track").agg(
        F.max("track_policy").alias("track_policy"),
        F.count(F.lit(1)).alias("program_races"),
        F.count_if("result_fetched").alias("result_races"),
        F.count_if(missing).alias("missing_races"),
        reasons.alias("_reasons"),
        F.sum(F.when(missing, F.col("id_missing_horse_count")).otherwise(0)).alias("id_missing_horse_count"),
        F.sum(F.when(missing, F.col("source_not_published_count")).otherwise(0)).alias("source_not_published_count"),
    ).withColumn(
        "missing_reason", F.when(F.size("_reasons") > 0, F.array_join("_reasons", ",")).otherwise("NONE")
    ).drop("_reasons")


def warnings(tracks: DataFrame) -> DataFrame:
    prefix = (
        F.when(F.col("track_policy") == "mandatory", "mandatory_track_missing")
        .when(F.col("track_policy") == "unsupported", "unsupported_track_pending")
        .otherwise("track_missing")
    )
    return tracks.filter("missing_races > 0").select(
        "day", "track", prefix.alias("warning"), "missing_races", "missing_reason"
    )


def live_status(races: DataFrame) -> DataFrame:
    """Per track: is the day complete, and which race numbers are still missing."""
    missing = F.when(~F.col("result_fetched"), F.col("race_no"))
    return races.groupBy("day", "track").agg(
        F.count(F.lit(1)).alias("races"), F.count_if("result_fetched").alias("completed"),
        F.bool_and("result_fetched").alias("track_completed"),
        F.array_sort(F.collect_set(missing)).alias("missing_race_nos"),
    )


def race_day(
    races: DataFrame, programs: DataFrame, predictions: DataFrame, results: DataFrame,
    matched: DataFrame, lifecycle: DataFrame | None = None, score: str = "ensemble_probability",
) -> DataFrame:
    """Programme x prediction x winner x match x lifecycle, one row per race."""
    pick = latest.latest_by(
        predictions, ["race_id"],
        [F.col("prediction_time").desc(), F.col(score).desc(), F.col("horse_id").asc()],
        F.col("prediction_time") < F.col("race_start_at"),
    ).select(
        "race_id", "prediction_id", F.col("horse_id").alias("top1_horse_id"), F.col(score).alias("ensemble_probability"),
        "prediction_time", "model_version",
    )
    newest = latest.latest_by(
        results, ["race_id", "horse_id"], [F.col("captured_at").desc(), F.col("result_id").desc()],
        F.col("result_status") == "finished",
    ).filter("finish_position = 1")
    names = latest_programs(programs).select("race_id", "horse_id", "horse_name")
    won = newest.select("race_id", "horse_id", "result_odds").join(
        names.withColumn("_in", F.lit(True)), ["race_id", "horse_id"], "left"
    ).groupBy("race_id").agg(
        F.array_sort(F.collect_list("horse_id")).alias("winner_ids"),
        F.bool_and(F.coalesce("_in", F.lit(False))).alias("winner_mapped"),
        F.map_from_entries(F.collect_list(F.struct("horse_id", "result_odds"))).alias("_odds"),
    )
    out = (
        races.join(pick, "race_id", "left").join(won, "race_id", "left")
        .join(matched.select(*match_keys(matched), F.lit(True).alias("_matched")).distinct(), match_keys(matched), "left")
        .join(
            names.withColumnsRenamed({"horse_id": "top1_horse_id", "horse_name": "_top_name"}),
            ["race_id", "top1_horse_id"], "left",
        )
    )
    has_pick, has_winner = F.col("prediction_id").isNotNull(), F.col("winner_ids").isNotNull()
    correct = F.when(has_winner, has_pick & F.coalesce(F.array_contains("winner_ids", F.col("top1_horse_id")), F.lit(False)))
    odds = F.try_element_at("_odds", F.col("top1_horse_id"))
    mapped = F.coalesce("winner_mapped", F.lit(False))
    status = (
        F.when(F.col("result_fetched") & ~has_pick, "NO_PREDICTION")
        .when(F.col("result_fetched") & ~mapped, "MATCH_ERROR")
        .when(F.col("result_fetched"), "RESULT_CAPTURED")
        .when(F.col("track_policy") == "unsupported", "SOURCE_UNSUPPORTED")
        .when(F.col("missing_reason") == "ID_MISSING", "ID_MISSING")
        .when(~has_pick, "NO_PREDICTION")
        .otherwise("RESULT_PENDING")
    )
    out = out.withColumns(
        {
            "prediction_available": has_pick,
            "top1_horse": F.when(has_pick, F.coalesce("_top_name", F.col("top1_horse_id").cast("string"))),
            "result_status": status, "winner_mapped": mapped,
            "prediction_result_matched": F.coalesce("_matched", F.lit(False)),
            "evaluatable": has_pick & has_winner & mapped & (F.col("track_policy") != "unsupported"),
            "correct": correct, "decimal_odds": odds,
            "net_return": F.when(correct & odds.isNotNull(), odds - 1.0).when(~correct, -1.0),
        }
    ).drop("_odds", "_matched", "_top_name")
    if lifecycle is None:
        return out
    fresh = lifecycle.select(
        "race_id", F.col("agf_snapshot_done_at").alias("final_agf_at"),
        F.col("odds_snapshot_done_at").alias("final_odds_at"),
        F.col("final_prediction_done_at").alias("final_prediction_at"),
        F.col("state").alias("_state"), F.col("updated_at").alias("_updated"),
    )
    joined = out.join(fresh, "race_id", "left")
    default = F.when(F.col("track_policy") == "unsupported", "SOURCE_UNSUPPORTED").otherwise("WAITING")
    return joined.withColumns(
        {
            "freeze_status": F.coalesce("_state", default),
            "prediction_immutable": F.col("final_prediction_at").isNotNull(),
            "next_result_check_at": F.timestamp_micros(F.unix_micros("_updated") + 300_000_000),
        }
    ).drop("_state", "_updated")


def race_day_tracks(view: DataFrame) -> DataFrame:
    return view.groupBy("day", "track").agg(
        F.max("track_policy").alias("track_policy"), F.count(F.lit(1)).alias("program_races"),
        F.count_if("prediction_available").alias("prediction_races"),
        F.count_if("result_fetched").alias("result_races"),
        F.count_if("evaluatable").alias("evaluated_races"),
        F.count_if(~F.col("result_fetched")).alias("missing_result_races"),
    )


def race_day_summary(view: DataFrame) -> DataFrame:
    return view.groupBy("day").agg(
        F.count_distinct("track").alias("track_count"), F.count(F.lit(1)).alias("program_races"),
        F.count_if("prediction_available").alias("prediction_races"),
        F.count_if("result_fetched").alias("result_races"), F.count_if("evaluatable").alias("evaluated_races"),
        F.count_if(~F.col("result_fetched")).alias("missing_result_races"),
    )


def race_day_performance(view: DataFrame) -> DataFrame:
    rows = view.filter("evaluatable")
    return rows.groupBy("day").agg(
        F.count(F.lit(1)).alias("evaluated_races"), F.count_if("correct").alias("correct_races"),
        (100.0 * F.avg(F.col("correct").cast("double"))).alias("accuracy_percent"),
        F.coalesce(F.try_divide(100.0 * F.sum("net_return"), F.count("net_return")), F.lit(0.0)).alias("roi_percent"),
        F.coalesce(F.sum("net_return"), F.lit(0.0)).alias("net_profit"),
    )


def missing_field_rows(programs: DataFrame, fields: list[str], registry: str = "registry_id") -> DataFrame:
    """Entrants lacking any required field, with the list of what is missing."""
    lacking = F.array_compact(
        F.array(
            F.when(F.col(registry).isNull(), F.lit(registry)),
            *[F.when(filters.is_missing(F.col(f)), F.lit(f)) for f in fields],
        )
    )
    return programs.withColumn("missing_fields", lacking).filter(F.size("missing_fields") > 0).withColumn(
        "missing_reason", F.when(F.col(registry).isNull(), "ID_MISSING").otherwise("DATA_MISSING")
    )


def comparisons(actual: DataFrame, predictions: DataFrame, cutoff: float = 85.0) -> DataFrame:
    """Finishers against predictions of the same city and race by name, exact then similar.

    actual: race_date, city, race_no, horse_name, finish_position; predictions: race_date,
    city, race_no, horse_name, predicted_rank, probability.
    """
    block = ["race_date", "city", "race_no"]
    named = predictions.select(
        *block, text.horse_name("horse_name").alias("pred_name"), "predicted_rank", "probability"
    )
    matched = resolve.block_match(
        actual, named, block, "horse_name", "pred_name", cutoff, ["predicted_rank", "probability"]
    )
    won = F.coalesce(F.col("finish_position") == 1, F.lit(False))
    rank = F.coalesce("predicted_rank", F.lit(99))
    return matched.withColumns(
        {"is_top1": (won & (rank == 1)).cast("int"), "is_top3": (won & (rank <= 3)).cast("int")}
    )


def comparison_summary(rows: DataFrame) -> DataFrame:
    won = F.col("finish_position") == 1
    return rows.groupBy("race_date", "city", "race_no").agg(
        F.count(F.lit(1)).alias("total_horses"), F.count("finish_position").alias("result_count"),
        F.count("matched_name").alias("matched_preds"),
        F.max("is_top1").alias("top1_correct"), F.max("is_top3").alias("top3_correct"),
        F.min(F.when(won, F.col("horse_name"))).alias("winner_name"),
        F.min_by(F.coalesce("probability", F.lit(0.0)), F.when(won & F.col("matched_name").isNotNull(), F.col("horse_name"))).alias("winner_prob"),
        F.min_by("predicted_rank", F.when(won & F.col("matched_name").isNotNull(), F.col("horse_name"))).alias("winner_pred_rank"),
    )


def current_predictions(predictions: DataFrame, programs: DataFrame, score: str = "ensemble_probability") -> DataFrame:
    """Latest prediction of every entrant with its race's probability sum checked."""
    from furlong.operators.quality import group_sum_check

    newest = latest.latest_by(
        predictions, ["race_id", "horse_id"], [F.col("prediction_time").desc(), F.col("prediction_id").desc()]
    )
    named = newest.join(
        latest_programs(programs).select("race_id", "horse_id", "horse_name"), ["race_id", "horse_id"], "left"
    ).withColumn("horse_name", F.coalesce("horse_name", F.col("horse_id").cast("string")))
    checked = group_sum_check(named.withColumn("_p", F.coalesce(score, F.lit(0.0))), ["race_id"], "_p").drop("_p")
    return checked.withColumn("probability_sum", F.round("probability_sum", 8))


def today_races(programs: DataFrame, agf: DataFrame) -> DataFrame:
    """Races with the share of entrants captured before the start and the last market capture."""
    newest = latest_programs(programs)
    market = agf.groupBy("race_id").agg(F.max("captured_at").alias("last_agf_at"))
    early = F.count_if(latest.eligible_asof())
    races = newest.groupBy("race_id", "race_start_at", "race_no", "track").agg(
        F.count(F.lit(1)).alias("horse_count"), early.alias("covered")
    )
    return races.join(market, "race_id", "left").withColumn(
        "snapshot_coverage", F.round(100.0 * F.col("covered") / F.col("horse_count"), 1)
    )
