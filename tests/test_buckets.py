"""Race tables in buckets: same rows, and reports on a race move nothing between tasks."""

import shutil
from functools import partial

import pytest
from conftest import rows
from pyspark.sql import functions as F

from furlong.catalog import base, history, monitors, reports, scores
from furlong.operators import skew, windows

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture
def bucketed(spark, tmp_path, monkeypatch):
    """A copy of the tables whose derived race tables are bucketed, whatever their size."""
    monkeypatch.setattr(base, "MIN_BUCKETED_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in ("lineitem", "orders", "part"):
        shutil.copy(f"{SOURCE}/{name}.parquet", tmp_path)
    yield str(tmp_path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_race_tables_meet_without_a_shuffle(spark, bucketed):
    for live, most in ((reports._live_diag, 0), (reports._live, 2)):  # a full join forgets how its rows lie
        df = live(spark, bucketed)
        assert exchanges(df) <= most
        assert rows(df) == rows(live(spark, SOURCE))
    assert exchanges(scores.valid_races(spark, bucketed)) == 0


def test_a_race_too_large_for_a_task_is_not_bucketed(spark, bucketed, split_everything):
    assert base.buckets(spark, bucketed) == 0


def test_reasons_travel_as_keys_only(spark, bucketed):
    """Rows stay in their race; what leaves it has no names in it, and comes back to the race once."""
    plain = rows(monitors._coverage_horses(spark, SOURCE))
    assert rows(monitors._coverage_horses(spark, bucketed)) == plain
    from furlong.plans import coverage

    wide = monitors._resolved_programs(spark, bucketed)
    results = base.results(spark, bucketed).filter("race_id % 2 = 1")
    none = spark.createDataFrame([], "horse_key string, day date, finish string, entity_key string, error_id bigint, error_type string, message string")
    out = coverage.horse_reasons(wide, results, none.select("horse_key", "day", "finish"), none.select("entity_key", "day", "error_id", "error_type", "message"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and sum("race_id" in line for line in moved) <= 1


def test_feature_frames_shuffle_rows_on_the_horse_once(spark, bucketed):
    plan = history.incremental_features(spark, bucketed)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_known" in line]
    once = [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line and "horse_id" in line]
    assert len(once) == 1


def test_backtest_ranks_entrants_where_their_race_lies(spark, bucketed, monkeypatch):
    """Both folds are reported without a shuffle of the entrants by race, and without looking for hot races."""
    monkeypatch.setattr(scores.ml, "fit", lambda train, models: {})

    def score(df, models):
        with_p = df.withColumns({f"{m}_probability": F.col("price") / 200_000 for m in ("logistic", "ensemble")})
        return windows.rank_first(with_p, ["race_id"], "ensemble_probability", ["horse_id"])

    monkeypatch.setattr(scores.ml, "score", score)
    monkeypatch.setattr(scores.ml, "long_scores", partial(lambda make, scored, models: make(scored, ["logistic", "ensemble"]), scores.ml.long_scores))
    plain = rows(scores.ml_temporal_backtest(spark, SOURCE).select("split", "model", "rows", "races", "top1_accuracy"))
    looked = []
    monkeypatch.setattr(skew, "_input_bytes", lambda df: looked.append(df.columns))
    spark.conf.set("spark.furlong.hotKeyRows", "1000000")
    df = scores.ml_temporal_backtest(spark, bucketed)
    spark.conf.unset("spark.furlong.hotKeyRows")
    assert not [columns for columns in looked if "race_id" in columns]
    plan = df._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "race_id" in line]
    assert sorted(map(str, rows(df.select("split", "model", "rows", "races", "top1_accuracy")))) == sorted(map(str, plain)) and len(plain) == 4
