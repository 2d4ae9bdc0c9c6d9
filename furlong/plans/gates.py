"""Provenance gates, coverage gate, status rules and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong import schemas
from furlong.functions import text
from furlong.operators import quality


def provenance_mismatches(predictions: DataFrame, programs: DataFrame) -> DataFrame:
    """Predictions whose archived snapshot is missing, of another entrant or too late."""
    s = programs.select(
        F.col("snapshot_id").alias("feature_snapshot_id"), F.col("race_id").alias("_race"),
        F.col("horse_id").alias("_horse"), F.col("source_request_id").alias("_request"),
        F.col("captured_at").alias("_captured"),
    )
    bad = (
        F.col("_race").isNull() | (F.col("_race") != F.col("race_id")) | (F.col("_horse") != F.col("horse_id"))
        | (F.col("_request") != F.col("source_request_id")) | (F.col("_captured") >= F.col("race_start_at"))
    )
    return predictions.join(s, "feature_snapshot_id", "left").filter(bad).select(*predictions.columns)


def hash_mismatches(predictions: DataFrame, computed: Column, stored: str = "feature_hash") -> DataFrame:
    return predictions.filter(~F.coalesce(computed == F.col(stored), F.lit(False)))


def missed_races(
    programs: DataFrame, predictions: DataFrame, epoch: Column, now: Column, minutes: int = 5
) -> DataFrame:
    """Domestic races since the epoch whose final window has closed without a prediction."""
    races = programs.filter(
        (F.col("race_start_at") >= epoch)
        & (F.timestamp_micros(F.unix_micros("race_start_at") - minutes * 60_000_000) <= now)
        & text.is_domestic_track("track")
    ).select("race_id").distinct()
    return races.join(predictions.select("race_id"), "race_id", "left_anti")


def check_rows(counts: dict[str, DataFrame]) -> DataFrame:
    """(check, violations, passed): each frame holds the offending rows of one check."""
    out = None
    for name, df in counts.items():
        row = df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("passed", F.col("violations") == 0)


def provenance_gate(
    programs: DataFrame, agf: DataFrame, odds: DataFrame, results: DataFrame, predictions: DataFrame,
    features: DataFrame | None = None,
) -> DataFrame:
    """All provenance checks as rows. Late programme rows are allowed and only reported."""
    key = ["source_request_id", "race_id", "horse_id"]
    late_archive = predictions.join(
        programs.select(F.col("snapshot_id").alias("feature_snapshot_id"), F.col("captured_at").alias("_c")),
        "feature_snapshot_id",
    ).filter(F.col("_c") >= F.col("race_start_at"))
    start = F.unix_micros("race_start_at")
    final = predictions.filter(
        (F.unix_micros("prediction_time") >= start - 900_000_000) & (F.col("prediction_time") < F.col("race_start_at"))
    )
    several = final.groupBy("race_id").agg(F.count_distinct("prediction_time").alias("n")).filter("n > 1")
    checks = {
        "no_post_start_predictions": predictions.filter(F.col("prediction_time") >= F.col("race_start_at")),
        "prediction_snapshot_before_start": late_archive,
        "single_final_run_per_race": several,
    }
    for name, df in (("program", programs), ("agf", agf), ("odds", odds), ("results", results)):
        checks[f"no_duplicate_{name}_captures"] = quality.duplicate_keys(df, key)
    if features is not None:
        checks["features_before_start"] = features.filter(F.col("captured_at") >= F.col("race_start_at"))
        checks["no_duplicate_feature_rows"] = quality.duplicate_keys(features, ["race_id", "horse_id"])
        for market in ("agf", "odds"):
            checks[f"{market}_asof"] = features.filter(F.col(f"{market}_captured_at") >= F.col("race_start_at"))
    return check_rows(checks)


def append_only_violations(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose content changed or vanished between two versions of an append-only table."""
    content = [c for c in previous.columns if c not in keys]
    digest = lambda df, name: df.select(
        *keys, F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256).alias(name)
    )
    joined = digest(previous, "_before").join(digest(current, "_after"), keys, "left")
    kind = F.when(F.col("_after").isNull(), "deleted").when(F.col("_after") != F.col("_before"), "updated")
    return joined.withColumn("violation", kind).filter("violation IS NOT NULL").select(*keys, "violation")


def final_gate(checks: dict[str, DataFrame], epoch_known: bool = True) -> DataFrame:
    """One row: the violations of every check, and whether the gate passes. Without a known epoch
    it does not."""
    return check_rows(checks).agg(
        *[F.sum(F.when(F.col("check") == name, F.col("violations"))).alias(name) for name in checks],
        (F.bool_and("passed") & F.lit(epoch_known)).alias("snapshot_coverage_pass"),
    )


def coverage_gate(
    programs: DataFrame, predictions: DataFrame, computed_hash: Column, epoch: Column | None, now: Column,
) -> DataFrame:
    """The snapshot coverage gate: no prediction made after its start, every prediction archived
    with its own programme snapshot and an unchanged feature hash, no race missed since the epoch.
    An empty archive has nothing wrong in it; without an epoch no race counts as missed, but the
    gate does not pass."""
    since = F.lit(None).cast("timestamp") if epoch is None else epoch
    checks = {
        "late_predictions": predictions.filter(~F.coalesce(F.col("prediction_time") < F.col("race_start_at"), F.lit(False))),
        "provenance_mismatches": provenance_mismatches(predictions, programs),
        "hash_mismatches": hash_mismatches(predictions, computed_hash),
        "missed_races": missed_races(programs, predictions, since, now),
    }
    return final_gate(checks, epoch is not None)


def run_status(df: DataFrame) -> DataFrame:
    """Status and readiness from one row of gate results per day.

    Needs leakage_gate_pass, feature_contract_pass, snapshot_coverage_pass, prediction_drift,
    calibration, feature_drift, shadow_days, healthy_days.
    """
    hard = ~(F.col("leakage_gate_pass") & F.col("feature_contract_pass") & F.col("snapshot_coverage_pass"))
    gates = ["prediction_drift", "calibration", "feature_drift"]
    critical, unsure = F.lit(False), F.lit(False)
    for g in gates:
        critical = critical | (F.col(g) == "CRITICAL")
        unsure = unsure | (F.col(g) == "INSUFFICIENT_DATA")
    early = F.col("shadow_days") < 30
    fail = hard | (critical & ~early)
    status = F.when(fail, "FAIL").when(early | unsure, "SHADOW_WARMUP").otherwise("PASS")
    ready = (F.col("shadow_days") >= 90) & (F.col("healthy_days") >= 90) & ~fail & ~unsure
    return df.withColumns({"pipeline_status": status, "production_ready": ready})


def readiness(runs: DataFrame, predictions: DataFrame) -> DataFrame:
    """Latest monitoring row, distinct shadow days, last prediction, attention reasons."""
    newest = runs.orderBy(F.col("run_at").desc()).limit(1)
    days = runs.agg(F.count_distinct("shadow_date")).scalar()
    last = predictions.agg(F.max("prediction_time")).scalar()
    gates = {
        "leakage_gate_pass": "LEAKAGE_GATE", "feature_contract_pass": "FEATURE_CONTRACT",
        "snapshot_coverage_pass": "SNAPSHOT_COVERAGE",
    }
    reasons = F.array_compact(
        F.array(*[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(code)) for c, code in gates.items()])
    )
    return newest.withColumns(
        {"shadow_days": days, "last_prediction_at": last, "attention_reasons": reasons}
    ).withColumns(
        {
            "system_status": F.when(F.size("attention_reasons") == 0, "healthy").otherwise("attention"),
            "ready": F.col("production_ready") & (F.col("shadow_days") >= 90) & (F.size("attention_reasons") == 0),
        }
    )


def warning_list(checks: list[tuple[Column, str]]) -> Column:
    """Ordered, distinct texts of the conditions that hold."""
    return F.array_distinct(
        F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in checks]))
    )


def recency(df: DataFrame, captured: str, start: str, now: Column) -> DataFrame:
    """Late captures and the age of the newest one."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(captured) >= F.col(start)).alias("late_rows"),
        F.max(captured).alias("last_capture"),
    ).withColumn("age_minutes", (F.unix_micros(now) - F.unix_micros("last_capture")) / 60_000_000.0)


# Verdict per kind of dataset column.
VERDICTS = {
    "direct": ("target-race programme value", "CONDITIONAL"),
    "rolling": ("earlier races only", "PASS_WITH_CAVEAT"),
    "outcome": ("known after the race or timing unproven", "EXCLUDED_POST_RACE_OR_UNPROVEN"),
    "identity": ("identifier or context", "NOT_MODEL_FEATURE"),
    "condition": ("no capture time", "NOT_MODEL_FEATURE_UNPROVEN_TIME"),
    "incident": ("report after the event", "NOT_MODEL_FEATURE_POST_RACE"),
    "other": ("placeholder", "NOT_MODEL_FEATURE_UNVERIFIED"),
}
DIRECT = {"track", "distance", "surface", "race_class", "carried_weight", "draw"}
IDENTITY = {"horse_id", "race_id", "race_date", "horse_name", "jockey", "trainer"}


def column_kind(name: str) -> str:
    if name in DIRECT:
        return "direct"
    if name in schemas.MODEL_FEATURES:
        return "rolling"
    if name in schemas.POST_RACE_COLUMNS | schemas.MARKET_COLUMNS:
        return "outcome"
    if name in IDENTITY:
        return "identity"
    if name in schemas.CONDITION_COLUMNS or name in schemas.LOOKUP_COLUMNS:
        return "condition"
    if name in schemas.INCIDENT_COLUMNS:
        return "incident"
    return "other"


def provenance_matrix(df: DataFrame) -> DataFrame:
    """One row per dataset column: source availability, verdict, and how often it is filled."""
    columns = df.columns
    filled = df.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "feature", "non_null")
    static = df.sparkSession.createDataFrame(
        [(c, c in schemas.MODEL_FEATURES, *VERDICTS[column_kind(c)]) for c in columns],
        "feature string, model_used boolean, known_before_race string, verdict string",
    )
    return static.join(filled, "feature")
