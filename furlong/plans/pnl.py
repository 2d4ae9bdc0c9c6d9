"""Flat-stake profit and loss over evaluated picks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.operators import sets, skew, windows
from furlong.operators.filters import stake_value


def money(ev: DataFrame, stake: float) -> DataFrame:
    """Return and net result of one flat bet per row; NULL where a right pick has no price."""
    stake = stake_value(stake)
    eligible = (F.col("correct") == 0) | F.coalesce(F.col("decimal_odds") > 0, F.lit(False))
    returned = F.when(F.col("correct") == 1, stake * F.col("decimal_odds")).otherwise(0.0)
    return ev.withColumns(
        {
            "stake": F.lit(stake),
            "bet_eligible": eligible.cast("int"),
            "return_amount": F.when(eligible, returned),
            "net_profit": F.when(eligible, returned - stake),
            "odds_status": F.when(eligible, "AVAILABLE").otherwise("ODDS_MISSING"),
        }
    )


ORDER = ["race_start_at", "prediction_time", "race_id"]


def model_summary(bets: DataFrame) -> DataFrame:
    """Totals per model over the rows of :func:`money`."""
    won = (F.col("bet_eligible") == 1) & (F.col("correct") == 1)
    totals = bets.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_races"),
        F.sum("bet_eligible").cast("bigint").alias("bet_races"),
        F.sum("correct").cast("bigint").alias("correct_predictions"),
        F.sum(1 - F.col("correct")).cast("bigint").alias("incorrect_predictions"),
        (100.0 * F.avg("correct")).alias("accuracy_percent"),
        F.coalesce(F.sum(F.when(F.col("bet_eligible") == 1, F.col("stake"))), F.lit(0.0)).alias("total_invested"),
        F.coalesce(F.sum("return_amount"), F.lit(0.0)).alias("total_return"),
        F.count_if(F.col("bet_eligible") == 0).alias("odds_missing_races"),
        F.coalesce(F.avg(F.when(won, F.col("decimal_odds"))), F.lit(0.0)).alias("average_odds"),
        F.coalesce(F.avg(F.when(F.col("bet_eligible") == 1, F.col("probability"))), F.lit(0.0)).alias("average_probability"),
    )
    net = F.col("total_return") - F.col("total_invested")
    return totals.withColumns(
        {
            "net_profit": net,
            "roi_percent": F.coalesce(F.try_divide(100.0 * net, F.col("total_invested")), F.lit(0.0)),
        }
    )


def streaks(bets: DataFrame) -> DataFrame:
    eligible = bets.filter("bet_eligible = 1")
    return windows.longest_streaks(eligible, ["model"], ORDER, F.col("correct") == 1)


def best_worst_race(bets: DataFrame) -> DataFrame:
    """Best and worst eligible race per model; earlier races win ties."""
    eligible = bets.filter("bet_eligible = 1")
    fields = ["race_id", "race_date", "net_profit"]
    ties = [F.col(c) for c in ORDER]
    return eligible.groupBy("model").agg(
        F.min_by(F.struct(*fields), F.struct((-F.col("net_profit")).alias("p"), *ties)).alias("best"),
        F.min_by(F.struct(*fields), F.struct("net_profit", *ties)).alias("worst"),
    ).select(
        "model",
        F.col("best.race_id").alias("best_race"), F.col("best.net_profit").alias("best_profit"),
        F.col("worst.race_id").alias("worst_race"), F.col("worst.net_profit").alias("worst_profit"),
    )


def profit_by(bets: DataFrame, column: str) -> DataFrame:
    return bets.filter("bet_eligible = 1").groupBy(column).agg(F.sum("net_profit").alias("net_profit"))


def best_worst_group(bets: DataFrame, column: str) -> DataFrame:
    groups = profit_by(bets, column)
    return groups.agg(
        F.min_by(F.col(column), F.struct((-F.col("net_profit")).alias("p"), F.col(column).alias("c"))).alias(f"best_{column}"),
        F.min_by(F.col(column), F.struct("net_profit", F.col(column).alias("c"))).alias(f"worst_{column}"),
    )


def odds_extremes(bets: DataFrame) -> DataFrame:
    won = bets.filter("bet_eligible = 1 AND correct = 1")
    return won.agg(
        F.max("decimal_odds").alias("highest_winning_odds"),
        F.min("decimal_odds").alias("lowest_winning_odds"),
        F.coalesce(F.avg("decimal_odds"), F.lit(0.0)).alias("average_winning_odds"),
    )


def cumulative_by_model(
    bets: DataFrame, models: list[str], date: str | None = None, lookback: int = 5
) -> DataFrame:
    """Cumulative daily profit per model over every day any model bet on.

    With a date: the days up to it (``lookback`` days back) and a zero row on the day before
    the first one.
    """
    if date:
        end = F.lit(date).cast("date")
        bets = bets.filter(F.col("race_date").between(F.date_sub(end, lookback), end))
    daily = bets.groupBy("model", "race_date").agg(
        F.coalesce(F.sum(F.when(F.col("bet_eligible") == 1, F.col("net_profit"))), F.lit(0.0)).alias("daily_profit")
    )
    # days x models: both are report dimensions (calendar days, a fixed model list)
    grid = bets.select("race_date").distinct().withColumn(
        "model", F.explode(F.array(*[F.lit(m) for m in models]))
    )
    filled = grid.join(daily, ["model", "race_date"], "left").fillna(0.0, ["daily_profit"])
    out = skew.running(
        filled, ["model"], ["race_date"], {"cumulative_profit": ("sum", F.col("daily_profit"))}, include_current=True
    ).select("model", "race_date", "daily_profit", "cumulative_profit")
    if not date:
        return out
    start = out.groupBy("model").agg(F.date_sub(F.min("race_date"), 1).alias("race_date")).select(
        "model", "race_date", F.lit(0.0).alias("daily_profit"), F.lit(0.0).alias("cumulative_profit")
    )
    return out.unionByName(start)


def history_by_race(bets: DataFrame, primary: str, page: int = 1, size: int = sets.PAGE_SIZE) -> DataFrame:
    """A page of races, each with all its models in one map and the primary model on top."""
    rows = sets.page_by_group(
        bets, ["race_id", "race_start_at"], [F.col("race_start_at").desc(), F.col("race_id").asc()], page, size
    )
    fields = ["predicted_horse", "correct", "probability", "net_profit", "odds_status", "return_amount", "decimal_odds"]
    races = sets.models_by_race(rows, ["race_id", "race_start_at"], fields)
    top = F.try_element_at("models", F.lit(primary))
    return races.withColumns(
        {"predicted_horse": top["predicted_horse"], "correct": top["correct"], "net_profit": top["net_profit"]}
    )


def model_comparison(diag: DataFrame, stake: float) -> DataFrame:
    """Hit depth, winner rank, profit and model-versus-market counts per model."""
    stake = stake_value(stake)
    rank, market = F.col("winner_rank"), F.col("winner_agf_rank")
    invested = F.count("net_return") * F.lit(stake)
    profit = F.coalesce(F.sum("net_return"), F.lit(0.0)) * F.lit(stake)
    pct = lambda n: F.try_divide(100.0 * F.count_if(rank <= n), F.count(F.lit(1)))
    return diag.groupBy("model").agg(
        F.count(F.lit(1)).alias("evaluated_race_count"),
        *[F.count_if(rank <= n).alias(f"top{n}_count") for n in (1, 3, 5)],
        *[pct(n).alias(f"top{n}_accuracy") for n in (1, 3, 5)],
        F.avg(rank.cast("double")).alias("average_winner_rank"),
        F.median(rank).alias("median_winner_rank"),
        profit.alias("net_profit"),
        F.coalesce(F.try_divide(100.0 * profit, invested), F.lit(0.0)).alias("roi_percent"),
        F.count_if(rank < market).alias("model_over_agf"),
        F.count_if(market < rank).alias("agf_over_model"),
        F.count_if(market == rank).alias("tied_with_agf"),
        F.count(market).alias("agf_evaluated_race_count"),
        F.coalesce(F.try_divide(100.0 * F.count_if(rank < market), F.count(market)), F.lit(0.0)).alias("model_advantage_percent"),
    )


def rank_distribution(diag: DataFrame) -> DataFrame:
    return diag.groupBy("model", "winner_rank").agg(F.count(F.lit(1)).alias("race_count"))
