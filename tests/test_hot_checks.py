"""Looking for hot keys costs one small job for a chain of windows."""

import uuid

import pytest
from pyspark.sql import functions as F

from furlong.operators import asof, skew
from furlong.plans import features
from tests.conftest import rows


@pytest.fixture
def always_look(spark):
    spark.conf.set("spark.furlong.hotKeyCheckBytes", "0")
    yield
    spark.conf.unset("spark.furlong.hotKeyCheckBytes")


def jobs(spark, plan):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "plan")
    out = plan()
    spark.sparkContext.setJobGroup("rest", "rest")
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


SHARED = ["horse_id", "start", "race_no", "race_id", "carried_weight", "class_key", "distance", "surface_key", "track_key", "jockey_key", "trainer_key"]


def test_a_chain_of_windows_looks_once(spark, always_look):
    starts = spark.range(60).select(
        (F.col("id") % 7).alias("horse_id"), F.timestamp_seconds(F.col("id") * 86400).alias("start"), F.lit(1).alias("race_no"), F.col("id").alias("race_id"),
        F.lit(50.0).alias("carried_weight"), F.lit("c").alias("class_key"), F.lit(1200.0).alias("distance"), F.lit("s").alias("surface_key"),
        F.lit("t").alias("track_key"), F.lit("j").alias("jockey_key"), (F.col("id") % 2).cast("string").alias("trainer_key"), (F.col("id") % 3 + 1).alias("finish_position"),
    )
    build = lambda: features.history_features(starts.select(*SHARED), starts)
    one, _ = jobs(spark, lambda: skew.find_hot(starts, ["horse_id"]))
    _, single = jobs(spark, lambda: skew.find_hot(starts, ["horse_id"]))
    frame, chain = jobs(spark, build)
    assert one is None and 0 < chain == single
    assert frame.count() == 60


def test_a_hot_key_is_still_found_inside(spark, split_everything):
    df = spark.range(30).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    with skew.checked(df, ["k"]):
        assert skew.find_hot(df, ["k"]).count() == 2
    spark.conf.set("spark.furlong.hotKeyRows", "15")
    with skew.checked(df, ["k"]):
        assert jobs(spark, lambda: skew.find_hot(df, ["k", "v"])) == (None, 0)
    assert skew._COLD.get() == ()


def test_unique_left_side_of_an_asof_join(spark, split_everything):
    left = spark.createDataFrame([(k, 10) for k in range(4)], "k int, t int")
    right = spark.createDataFrame([(1, i, i * 2) for i in range(20)] + [(2, 11, 5)], "k int, u int, x int")
    out = asof.asof_join(left, right, ["k"], "t", "u", {"x": "x"}, left_unique=True)
    assert rows(out) == [(0, 10, None), (1, 10, 18), (2, 10, None), (3, 10, None)]
