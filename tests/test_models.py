"""The backtest trains whole models."""

import pytest

from furlong.catalog import scores
from furlong.plans import ml


class Stop(Exception):
    pass


def test_backtest_trains_as_many_trees_as_the_models_have(spark, monkeypatch):
    seen = {}

    def stop(train, models):
        seen.update({name: stages.getStages()[-1].getMaxIter() for name, stages in models.items()})
        raise Stop

    monkeypatch.setattr(ml, "fit", stop)
    with pytest.raises(Stop):
        scores.ml_temporal_backtest(spark, "/root/testdata/sf0.001")
    assert seen == {"logistic": 1000, "catboost": 300, "xgboost": 220}


def test_models_fitted_side_by_side_are_those_fitted_alone(spark):
    rows = spark.createDataFrame([(float(i % 7), "ab"[i % 2], int(i % 3 == 0)) for i in range(60)], "x double, k string, is_win int")
    models = ml.estimators(["x"], ["k"], trees=2)
    fitted = ml.fit(rows, models)
    assert list(fitted) == list(models)
    weighted = ml.class_weights(rows)
    for name, stages in models.items():
        alone = ml.raw_probability(stages.fit(weighted), weighted, "p").select("p").collect()
        assert [r.p for r in ml.raw_probability(fitted[name], weighted, "p").select("p").collect()] == pytest.approx([r.p for r in alone])
