"""Evaluation metrics as aggregations: hit rates, losses, AUC, calibration, rank metrics.

Frames are long: one row per (group, race, horse) with a probability and a 0/1 label.
Nothing is collected; curve metrics first reduce to one row per distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators import latest, skew
from furlong.operators.filters import completed_races, fully_priced

LONGSHOT_ODDS = 10.0
EPSILON = 1e-12


def hit_rates(
    df: DataFrame, by: list[str], score: str, label: str, depths: tuple[int, ...] = (1, 3, 5),
    race: str = "race_id", tie: str = "horse_id",
) -> DataFrame:
    """Share of races whose winner is among the first N picks."""
    order = [F.col(score).desc(), F.col(tie).asc()]
    ranked = latest.top_n(df, [*by, race], order, max(depths), "_rank")
    races = ranked.groupBy(*by, race).agg(
        *[F.max(F.when(F.col("_rank") <= n, F.col(label)).otherwise(0)).alias(f"_h{n}") for n in depths]
    )
    return races.groupBy(*by).agg(
        F.count(F.lit(1)).alias("races"),
        *[F.avg(F.col(f"_h{n}").cast("double")).alias(f"top{n}_accuracy") for n in depths],
    )


def market_accuracy(
    df: DataFrame, by: list[str], score: str, label: str, odds: str, race: str = "race_id", tie: str = "horse_id"
) -> DataFrame:
    """Favourite accuracy over fully priced races, long-shot accuracy of the top pick, mean
    probability given to winners."""
    keys = [*by, race]
    per_race = df.groupBy(*keys).agg(
        F.bool_and(F.col(odds).isNotNull()).alias("_priced"),
        F.min_by(F.col(label), F.struct(odds, tie)).alias("_favourite"),
        F.min_by(F.struct(F.col(label).alias("l"), F.col(odds).alias("o")), F.when(F.col(score).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t")))).alias("_top"),
        F.sum(F.when(F.col(label) == 1, F.col(score))).alias("_winner_p"),
        F.count(F.when(F.col(label) == 1, 1)).alias("_winners"),
    )
    longshot = F.col("_top.o") >= LONGSHOT_ODDS
    return per_race.groupBy(*by).agg(
        F.avg(F.when(F.col("_priced"), F.col("_favourite").cast("double"))).alias("favorite_accuracy"),
        F.avg(F.when(longshot, F.col("_top.l").cast("double"))).alias("longshot_accuracy"),
        F.count_if("_priced").alias("certified_odds_races"),
        F.try_divide(F.sum("_winner_p"), F.sum("_winners")).alias("average_winner_probability"),
    )


def log_loss(score: Column, label: Column) -> Column:
    p = F.greatest(F.least(score, F.lit(1 - EPSILON)), F.lit(EPSILON))
    return F.avg(-(label * F.ln(p) + (1 - label) * F.ln(1 - p)))


def brier(score: Column, label: Column) -> Column:
    return F.avg((score - label) * (score - label))


def losses(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    s, y = F.col(score), F.col(label).cast("double")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), log_loss(s, y).alias("log_loss"), brier(s, y).alias("brier_score")
    )


def score_table(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score, with running counts from the top."""
    counts = df.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("_neg"),
    )
    return skew.running(
        counts, by, [f"-{score}"],
        {"_tp": ("sum", F.col("_pos")), "_fp": ("sum", F.col("_neg"))}, include_current=True,
    )


def auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision in one pass over the scores."""
    table = score_table(df, by, score, label)
    # positives of this score beat every negative below it and tie with its own negatives
    wins = F.col("_pos") * (F.col("_neg") * 0.5)
    totals = table.groupBy(*by).agg(
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"),
        F.sum(wins - F.col("_pos") * F.col("_fp").cast("double")).alias("_partial"),
        F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_ap"),
    )
    # sum over scores of pos * (N - fp) + pos * neg / 2, with N pulled out of the sum
    u = F.col("_partial") + F.col("_p") * F.col("_n")
    usable = (F.col("_p") > 0) & (F.col("_n") > 0)
    return totals.select(
        *by,
        F.when(usable, u / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when(F.col("_p") > 0, F.col("_ap") / F.col("_p")).alias("pr_auc"),
    )


def confusion(df: DataFrame, by: list[str], score: str, label: str, threshold: float = 0.5) -> DataFrame:
    hit, truth = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(hit & truth).alias("true_positive"), F.count_if(hit & ~truth).alias("false_positive"),
        F.count_if(~hit & truth).alias("false_negative"), F.count_if(~hit & ~truth).alias("true_negative"),
    )
    tp, fp = F.col("true_positive"), F.col("false_positive")
    fn, tn = F.col("false_negative"), F.col("true_negative")
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return counts.withColumns(
        {
            "accuracy": safe(tp + tn, tp + tn + fp + fn),
            "precision": safe(tp, tp + fp),
            "recall": safe(tp, tp + fn),
            "f1": safe(2 * tp, 2 * tp + fp + fn),
        }
    )


def calibration_bin(score: Column, bins: int = 10) -> Column:
    """1-based bin of (lower, upper] edges; 0 falls into the first bin.

    Counts exact edges below the score: multiplying by the bin count misplaces edge values.
    """
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    below = F.size(F.filter(edges, lambda e: e < score))
    return F.greatest(F.lit(1), F.least(below, F.lit(bins)))


def reliability(df: DataFrame, by: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """All bins of every group, empty ones included."""
    found = df.groupBy(*by, calibration_bin(F.col(score), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(score).alias("mean_probability"),
        F.avg(F.col(label).cast("double")).alias("observed_rate"),
    )
    base = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = base.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    joined = grid.join(found, [*by, "bin"], "left")
    return joined.select(
        *by, "bin",
        ((F.col("bin") - 1) / bins).alias("bin_lower"), (F.col("bin") / bins).alias("bin_upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        "mean_probability", "observed_rate",
        F.abs(F.col("mean_probability") - F.col("observed_rate")).alias("absolute_gap"),
    )


def calibration_error(df: DataFrame, by: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error."""
    per_bin = df.groupBy(*by, calibration_bin(F.col(score), bins).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.abs(F.avg(score) - F.avg(F.col(label).cast("double"))).alias("_gap"),
    )
    return per_bin.groupBy(*by).agg(
        (F.sum(F.col("_n") * F.col("_gap")) / F.sum("_n")).alias("ece"), F.max("_gap").alias("mce")
    )


def calibration_history(
    df: DataFrame, by: list[str], score: str, label: str, min_races: int = 20, threshold: float = 0.15
) -> DataFrame:
    """Reliability table per group with ECE, MCE and a status per group."""
    errors = calibration_error(df, by, score, label)
    races = df.groupBy(*by).agg(F.count_distinct("race_id").alias("_races"))
    enough = F.col("_races") >= min_races
    status = (
        F.when(enough & (F.col("ece") >= threshold), "CRITICAL").when(enough, "PASS").otherwise("INSUFFICIENT_DATA")
    )
    graded = errors.join(races, by).withColumn("status", status).drop("_races")
    return reliability(df, by, score, label).join(graded, by)


def exact_median(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median from counts per distinct value; no group is gathered in one place."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = skew.running(counts, by, [value], {"_upto": ("sum", F.col("_n"))}, include_current=True)
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    placed = skew.left_join_null_safe(upto, totals, by)
    first, second = F.floor((F.col("_total") + 1) / 2), F.ceil((F.col("_total") + 1) / 2)
    holds = lambda place: (F.col("_upto") >= place) & (F.col("_upto") - F.col("_n") < place)
    return placed.groupBy(*by).agg(
        (
            (F.max(F.when(holds(first), F.col(value))) + F.max(F.when(holds(second), F.col(value)))) / 2.0
        ).alias(name)
    )


def rank_metrics(
    df: DataFrame, by: list[str], score: str, finish: str, race: str = "race_id", tie: str = "horse_id"
) -> DataFrame:
    """Mean per-race Spearman(score, -finish), NDCG and reciprocal rank of the winner.

    Places come from skew-safe ranks; tied rows share the mean of the places (and of the
    discounts) they occupy. Every window is keyed by the race, so one shuffle serves all.
    """
    keys = [*by, race]
    known = df.filter(F.col(score).isNotNull() & F.col(finish).isNotNull()).withColumn(
        "_gain", (F.col(finish) == 1).cast("double")
    )
    placed = skew.ranked(known, keys, [f"-{score}", tie], "_pos")
    placed = skew.ranked(placed, keys, [finish, tie], "_fpos")
    discount = 1.0 / F.log2(F.col("_pos") + 1.0)
    placed = skew.group_totals(
        placed, [*keys, score], {"_ps": F.avg("_pos"), "_discount": F.avg(discount)}
    )
    placed = skew.group_totals(placed, [*keys, finish], {"_pf": F.avg("_fpos")})
    placed = skew.group_totals(placed, keys, {"_w": F.sum("_gain")})
    per_race = placed.groupBy(*keys).agg(
        F.corr("_ps", "_pf").alias("_rho"),
        F.sum(F.col("_gain") * F.col("_discount")).alias("_dcg"),
        F.sum(F.when(F.col("_pos") <= F.col("_w"), discount)).alias("_ideal"),
        F.min(F.when(F.col("_gain") == 1, F.col("_pos"))).alias("_best"),
    )
    return per_race.groupBy(*by).agg(
        F.avg(F.when(~F.isnan("_rho"), F.col("_rho"))).alias("rank_correlation"),
        F.avg(F.coalesce(F.try_divide(F.col("_dcg"), F.col("_ideal")), F.lit(0.0))).alias("ndcg"),
        F.avg(1.0 / F.col("_best")).alias("mean_reciprocal_rank"),
    )


def live_metrics(
    df: DataFrame, score: str = "probability", label: str = "winner", odds: str = "pre_race_odds"
) -> DataFrame:
    """Daily rows per model plus one rolling row over the 90 days up to the last day."""
    valid = completed_races(df, ["race_id", "model"], label)
    last = valid.agg(F.max("race_date")).scalar()
    rolling = valid.filter(F.col("race_date") >= F.date_sub(last, 89)).withColumns(
        {"metric_date": last, "window": F.lit("rolling_90d")}
    )
    daily = valid.withColumns({"metric_date": F.col("race_date"), "window": F.lit("daily")})
    rows = daily.unionByName(rolling)
    by = ["metric_date", "window", "model"]
    out = hit_rates(rows, by, score, label)
    for part in (
        losses(rows, by, score, label),
        auc(rows, by, score, label).drop("pr_auc"),
        calibration_error(rows, by, score, label).drop("mce").withColumnRenamed("ece", "calibration_error"),
        market_accuracy(rows, by, score, label, odds),
    ):
        out = out.join(part, by)
    return out.withColumn("status", F.lit("OK"))


def attach_certified_odds(df: DataFrame) -> DataFrame:
    """The odds archived with a prediction are its certified pre-race odds."""
    return df.withColumns(
        {"pre_race_odds": F.col("odds"), "pre_race_odds_captured_at": F.col("prediction_time")}
    )


def priced_races(df: DataFrame, odds: str = "pre_race_odds") -> DataFrame:
    return fully_priced(df, ["race_id"], odds)


def best_model(scores: DataFrame) -> DataFrame:
    """Highest top-1 accuracy, then lowest log-loss."""
    return scores.orderBy(F.col("top1_accuracy").desc(), F.col("log_loss").asc(), "model").limit(1)
