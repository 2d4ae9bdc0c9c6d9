"""Model training, scoring, archiving and importance on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong import schemas
from furlong.functions import jsonx, numbers
from furlong.operators import filters, skew, windows
from furlong.plans import metrics
from furlong.session import shared_dir


@dataclass
class Fold:
    name: str
    train: DataFrame
    evaluate: DataFrame


def prepare(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Categories as text with NULL named, numbers as double with text rejected to NULL."""
    return df.withColumns(
        {
            **{c: F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in categorical},
            **{c: F.col(c).try_cast("double") for c in numeric},
        }
    )


def estimators(
    numeric: list[str], categorical: list[str], label: str = "is_win", weight: str = "weight", trees: int | None = None
) -> dict[str, Pipeline]:
    """Logistic regression on scaled and one-hot inputs; two boosted-tree configurations of 300 and 220 trees
    (``trees``, if given, for both), the second weighting winners by the class ratio."""
    filled = [f"{c}_filled" for c in numeric]
    indexed = [f"{c}_index" for c in categorical]
    impute = Imputer(strategy="median", inputCols=numeric, outputCols=filled)
    index = StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep")
    onehot = OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_vec" for c in categorical], handleInvalid="keep")
    numbers_in = VectorAssembler(inputCols=filled, outputCol="numbers")
    scale = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)
    linear = VectorAssembler(inputCols=["scaled", *[f"{c}_vec" for c in categorical]], outputCol="features")
    plain = VectorAssembler(inputCols=[*filled, *[f"{c}_vec" for c in categorical]], outputCol="features")
    common = dict(featuresCol="features", labelCol=label, seed=42)
    return {
        "logistic": Pipeline(
            stages=[impute, index, onehot, numbers_in, scale, linear,
                    LogisticRegression(featuresCol="features", labelCol=label, maxIter=1000, regParam=1e-4)]
        ),
        "catboost": Pipeline(
            stages=[impute, index, onehot, plain, GBTClassifier(**common, maxIter=trees or 300, maxDepth=6, stepSize=0.05)]
        ),
        "xgboost": Pipeline(
            stages=[impute, index, onehot, plain,
                    GBTClassifier(**common, maxIter=trees or 220, maxDepth=5, stepSize=0.05, subsamplingRate=0.9, weightCol=weight)]
        ),
    }


def class_weights(df: DataFrame, label: str = "is_win", weight: str = "weight") -> DataFrame:
    """Winners weigh negatives / positives, the rest 1."""
    ratio = df.agg(
        F.greatest(F.lit(1), F.count_if(F.col(label) == 0)) / F.greatest(F.lit(1), F.count_if(F.col(label) == 1))
    ).scalar()
    return df.withColumn(weight, F.when(F.col(label) == 1, ratio).otherwise(1.0))


def year_fold(df: DataFrame, day: str, year: int, name: str) -> Fold:
    """Train on the years before, evaluate on the year; fails when the two overlap in time."""
    train = df.filter(F.col(day) < F.make_date(F.lit(year), F.lit(1), F.lit(1)))
    evaluate = df.filter(F.year(day) == year)
    last = train.agg(F.max(day)).first()[0]
    first = evaluate.agg(F.min(day)).first()[0]
    if last is None or first is None or last >= first:
        raise ValueError(f"temporal split {year} is invalid")
    return Fold(name, train, evaluate)


def date_share_cutoff(df: DataFrame, day: str, share: float = 0.8) -> DataFrame:
    """The date that has the given share of distinct dates before it (older split rule)."""
    days = skew.ranked(df.select(day).distinct(), [], [day], "_n")
    total = days.agg(F.count(F.lit(1))).scalar()
    return days.filter(F.col("_n") == F.floor(total * share) + 1).select(F.col(day).alias("cutoff"))


def split_audit(fold: Fold, day: str) -> DataFrame:
    out = None
    for part, df in (("train", fold.train), ("evaluate", fold.evaluate)):
        row = df.agg(
            F.lit(part).alias("part"), F.count(F.lit(1)).alias("rows"), F.count_distinct("race_id").alias("races"),
            F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def training_rows(df: DataFrame) -> DataFrame:
    """Complete races with exactly one winner and at least two runners, labelled."""
    usable = df.filter("finish_position IS NOT NULL AND race_field_complete").withColumn(
        "is_win", (F.col("finish_position") == 1).cast("int")
    )
    return filters.valid_races(usable, ["race_id"], "is_win")


def fit(train: DataFrame, models: dict[str, Pipeline]) -> dict[str, PipelineModel]:
    """All models on the same rows, side by side: boosting is hundreds of short jobs in a row.

    Its lineage grows with the trees unless the context has a folder for checkpoints."""
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(train.sparkSession))
    weighted = class_weights(train)
    with ThreadPool(len(models)) as pool:
        fitted = pool.map(inheritable_thread_target(train.sparkSession)(lambda stages: stages.fit(weighted)), models.values())
    return dict(zip(models, fitted, strict=True))


def raw_probability(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


def score(df: DataFrame, models: dict[str, PipelineModel], race: str = "race_id", tie: str = "horse_id") -> DataFrame:
    """Probabilities normalised within the race, their mean, and the rank by it.

    A model whose output is not a probability fails the job on the row concerned.
    """
    out = df
    for name, model in models.items():
        out = raw_probability(model, out, f"_raw_{name}")
        raw = F.col(f"_raw_{name}")
        valid = numbers.finite(raw) & (raw >= 0) & (raw <= 1)
        out = out.withColumn(
            f"_raw_{name}", F.when(valid, raw).otherwise(F.raise_error(F.lit(f"invalid {name} probability")).cast("double"))
        )
    names = {f"_raw_{n}": f"{n}_probability" for n in models}
    out = windows.normalise_in_group(out, [race], names).drop(*names)
    out = out.withColumn("ensemble_probability", windows.row_mean(list(names.values())))
    return windows.rank_first(out, [race], "ensemble_probability", [tie])


def long_scores(scored: DataFrame, models: list[str]) -> DataFrame:
    """One row per entrant and model with the probability and the outcome."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"{m}_probability").alias("probability")) for m in models]
    )
    return scored.select(
        "race_id", "horse_id", "race_date", "finish_position", "is_win", "odds", F.explode(pairs).alias("_m")
    ).select("*", "_m.model", "_m.probability").drop("_m")


def score_report(long: DataFrame, by: list[str]) -> DataFrame:
    """All evaluation metrics per group."""
    out = metrics.hit_rates(long, by, "probability", "is_win")
    for part in (
        metrics.losses(long, by, "probability", "is_win"),
        metrics.confusion(long, by, "probability", "is_win"),
        metrics.auc(long, by, "probability", "is_win"),
        metrics.calibration_error(long, by, "probability", "is_win"),
        metrics.rank_metrics(long, by, "probability", "finish_position"),
    ):
        out = out.join(part, by)
    return out


def _market_at(times: DataFrame, feed: DataFrame, values: list[str], tie: list[str]) -> DataFrame:
    """Last row of ``feed`` at or before the prediction time, as ``_`` and the value's name.

    Rows of one capture time are ordered by ``tie``. The join and the aggregate share one
    partitioning on the race and horse, and the aggregate keeps a single row a key on the map side.
    """
    known = feed.select("race_id", "horse_id", "captured_at", *tie, *values).join(times, ["race_id", "horse_id"])
    last = F.max_by(F.struct(*values), F.struct("captured_at", *tie))
    seen = known.filter(F.col("captured_at") <= F.col("prediction_time")).groupBy("race_id", "horse_id", "prediction_time").agg(last.alias("_v"))
    return seen.select("race_id", "horse_id", "prediction_time", *[F.col(f"_v.{v}").alias(f"_{v}") for v in values])


def archive(
    scored: DataFrame, prediction_time: Column, run_id: str, agf: DataFrame, odds: DataFrame,
    model_version: str, pipeline_version: str | None = None, tie: list[str] | None = None,
) -> DataFrame:
    """Prediction rows with the market known at prediction time, feature payload and hash.

    One row of a race that has started, or whose start is unknown, fails the job. A market value
    that the latest capture does not have falls back to the one of the scored row.
    """
    early = F.col("prediction_time") < F.col("race_start_at")
    complaint = F.concat(F.lit("prediction is not before the start of race "), F.coalesce(F.col("race_id").cast("string"), F.lit("?")))
    timed = scored.withColumn("prediction_time", prediction_time).withColumn(
        "prediction_time", F.when(early, F.col("prediction_time")).otherwise(F.raise_error(complaint).cast("timestamp"))
    )
    key, tie = ["race_id", "horse_id", "prediction_time"], tie or ["snapshot_id"]
    times = timed.select(*key).distinct()
    timed = timed.join(_market_at(times, agf, ["agf_percent", "agf_rank"], tie), key, "left")
    timed = timed.join(_market_at(times, odds, ["odds"], tie), key, "left")
    present = lambda c, kind: F.col(c).cast(kind) if c in scored.columns else F.lit(None).cast(kind)
    features = schemas.MODEL_FEATURES
    return timed.select(
        F.concat_ws(":", F.lit(run_id), F.col("race_id").cast("string"), F.col("horse_id").cast("string")).alias("prediction_id"),
        F.lit(model_version).alias("model_version"), F.lit(pipeline_version).cast("string").alias("pipeline_version"),
        "race_id", "horse_id", "prediction_time", "race_start_at",
        *[c for c in scored.columns if c.endswith("_probability")], "predicted_rank",
        jsonx.feature_hash(features, "snapshot_id", "source_request_id", "race_start_at", schemas.CONTRACT_VERSION).alias("feature_hash"),
        jsonx.canonical(features).alias("feature_values_json"),
        F.lit(schemas.CONTRACT_VERSION).alias("feature_contract_version"),
        F.col("snapshot_id").alias("feature_snapshot_id"), "source_request_id",
        F.coalesce("_agf_percent", present("agf_percent", "double")).alias("agf_percent"),
        F.coalesce("_agf_rank", present("agf_rank", "int")).alias("agf_rank"),
        F.coalesce("_odds", present("odds", "double")).alias("odds"),
    )


def archived_features(archived: DataFrame) -> DataFrame:
    """The payload table of archived predictions, stamped with their prediction time."""
    return archived.select(
        "prediction_id", "race_id", "horse_id", "prediction_time", "race_start_at", "feature_values_json", "feature_hash",
        "feature_contract_version", F.col("prediction_time").alias("archived_at"),
    )


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: list[str], label: str = "is_win", repeats: int = 3, buckets: int = 256
) -> DataFrame:
    """Rise of the log-loss when one column is shuffled, over all rows.

    Rows are dealt into buckets by a hash; the shuffle is a join on row places of a bucket under
    another order, so no task holds all rows. All features and repeats are rows of one frame, so
    the model is applied once.
    """
    sample = df.select(*features, label, F.monotonically_increasing_id().alias("_id"))
    sample = sample.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(buckets)))
    from furlong.session import checkpoint

    sample = checkpoint(skew.ranked(sample, ["_b"], ["_id"], "_n"))
    base = sample.withColumns({"_feature": F.lit(None).cast("string"), "_repeat": F.lit(0)})
    frames = base
    for r in range(1, repeats + 1):
        moved = skew.ranked(sample.withColumn("_h", F.xxhash64("_id", F.lit(r)).cast("double")), ["_b"], ["_h", "_id"], "_n2")
        other = moved.select("_b", F.col("_n2").alias("_n"), *[F.col(f).alias(f"_o_{f}") for f in features])
        joined = sample.join(other, ["_b", "_n"])
        for f in features:
            frames = frames.unionByName(
                joined.withColumns({f: F.col(f"_o_{f}"), "_feature": F.lit(f), "_repeat": F.lit(r)}).select(*base.columns)
            )
    scored = raw_probability(model, frames, "_p")
    losses = scored.groupBy("_feature", "_repeat").agg(
        metrics.log_loss(F.col("_p"), F.col(label).cast("double")).alias("loss")
    )
    reference = losses.filter("_feature IS NULL").agg(F.max("loss")).scalar()
    return losses.filter("_feature IS NOT NULL").groupBy(F.col("_feature").alias("feature")).agg(
        F.avg("loss").alias("_shuffled")
    ).select("feature", (F.col("_shuffled") - reference).alias("importance"))


def gain_importance(model: PipelineModel, df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Gain of a tree model summed back to the raw columns its inputs came from."""
    importances = model.stages[-1].featureImportances.toArray()
    meta = model.transform(df.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    totals = {c: 0.0 for c in [*numeric, *categorical]}
    for i, value in enumerate(importances):
        raw = next((c for c in totals if names.get(i, "").startswith((f"{c}_filled", f"{c}_vec"))), None)
        if raw:
            totals[raw] += float(value)
    return df.sparkSession.createDataFrame(list(totals.items()), "feature string, importance double")


def importance_rank(importances: DataFrame, by: list[str]) -> DataFrame:
    """Competition rank, best first; unknown values last."""
    from pyspark.sql import Window

    order = F.when(~F.isnan("importance"), F.col("importance")).desc_nulls_last()
    return importances.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(order)))
