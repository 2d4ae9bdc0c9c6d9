import datetime as dt

from pyspark.sql import functions as F

from furlong.plans import gates

START = dt.datetime(2024, 5, 1, 14)


def frames(spark, runs):
    programs = spark.createDataFrame(
        [("s1", 1, 7, "q", START - dt.timedelta(hours=2), START, "Ankara"), ("s2", 2, 8, "q", START - dt.timedelta(hours=2), START, "Ankara")],
        "snapshot_id string, race_id long, horse_id long, source_request_id string, captured_at timestamp, race_start_at timestamp, track string",
    )
    schema = "race_id long, horse_id long, source_request_id string, feature_snapshot_id string, prediction_time timestamp, race_start_at timestamp, feature_hash string"
    return programs, spark.createDataFrame(runs, schema)


def gate(spark, runs, epoch="2024-01-01"):
    since = epoch and F.lit(epoch).cast("timestamp")
    return gates.coverage_gate(*frames(spark, runs), F.concat_ws(":", "race_id", "horse_id"), since, F.lit("2024-05-02").cast("timestamp")).first().asDict()


def run(race, horse, snapshot, minutes=-10, digest=None):
    return race, horse, "q", snapshot, START + dt.timedelta(minutes=minutes), START, digest or f"{race}:{horse}"


def test_coverage_gate(spark):
    whole = [run(1, 7, "s1"), run(2, 8, "s2")]
    clean = dict.fromkeys(("late_predictions", "provenance_mismatches", "hash_mismatches", "missed_races"), 0)
    assert gate(spark, whole) == {**clean, "snapshot_coverage_pass": True}
    assert gate(spark, whole, None) == {**clean, "snapshot_coverage_pass": False}
    bad = gate(spark, [run(1, 7, "s2", 0, "x")])
    assert bad == {"late_predictions": 1, "provenance_mismatches": 1, "hash_mismatches": 1, "missed_races": 1, "snapshot_coverage_pass": False}
    assert gate(spark, []) == {**clean, "missed_races": 2, "snapshot_coverage_pass": False}
