import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from furlong import schemas
from furlong.plans import ml

START = dt.datetime(2024, 5, 1, 14)
AT = START - dt.timedelta(minutes=5)


def frames(spark, starts=(START, START)):
    rows = [(i + 1, 10 + i, start, i + 1, 70 + i, f"q{i}", 0.5, 1.5 if i else None, 3 if i else None, 8.0) for i, start in enumerate(starts)]
    scored = spark.createDataFrame(
        rows, "race_id long, horse_id long, race_start_at timestamp, predicted_rank int, snapshot_id long, source_request_id string, ensemble_probability double, agf_percent double, agf_rank int, odds double"
    ).withColumns({c: F.lit(None).cast("double") for c in schemas.MODEL_FEATURES}).withColumn("distance", F.lit(1400.0))
    minutes = lambda n: AT + dt.timedelta(minutes=n)
    feed = spark.createDataFrame(
        [
            (1, 10, minutes(-9), 1, 20.0, 4, 2.0), (1, 10, minutes(0), 2, 30.0, 1, 3.0), (1, 10, minutes(0), 3, 31.0, 2, None),
            (1, 10, minutes(1), 4, 99.0, 9, 99.0), (2, 11, minutes(-1), 5, None, None, None), (9, 10, minutes(-1), 6, 1.0, 1, 1.0),
        ],
        "race_id long, horse_id long, captured_at timestamp, snapshot_id long, agf_percent double, agf_rank int, odds double",
    )
    return scored, feed


def archive(spark, **more):
    scored, feed = frames(spark, **more)
    return ml.archive(scored, F.lit(AT), "run", feed, feed, "v1", "p1")


def test_market_of_the_prediction_time(spark):
    one, two = archive(spark).orderBy("race_id").collect()
    assert (one.agf_percent, one.agf_rank, one.odds) == (31.0, 2, 8.0)
    assert (two.agf_percent, two.agf_rank, two.odds) == (1.5, 3, 8.0)
    assert (one.prediction_id, one.pipeline_version, one.feature_snapshot_id) == ("run:1:10", "p1", 70)


def test_payload_and_hash(spark):
    rows = archive(spark)
    row = rows.orderBy("race_id").first()
    values = {c: 1400.0 if c == "distance" else None for c in sorted(schemas.MODEL_FEATURES)}
    assert json.loads(row.feature_values_json) == values
    payload = {
        "feature_contract_version": schemas.CONTRACT_VERSION, "features": values, "race_start_at": str(START),
        "snapshot_id": 70, "source_request_id": "q0",
    }
    assert row.feature_hash == hashlib.sha256(json.dumps(payload, separators=(",", ":")).encode()).hexdigest()
    stored = ml.archived_features(rows).orderBy("race_id").first()
    assert stored.archived_at == stored.prediction_time == AT and stored.feature_hash == row.feature_hash


@pytest.mark.parametrize("start", [AT, AT - dt.timedelta(hours=1), None])
def test_started_races_fail(spark, start):
    with pytest.raises(Exception, match="not before the start of race 2"):
        archive(spark, starts=(START, start)).collect()


def test_nothing_scored(spark):
    scored, feed = frames(spark)
    assert ml.archive(scored.limit(0), F.lit(AT), "run", feed, feed, "v1").count() == 0
