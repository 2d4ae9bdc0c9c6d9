"""Strategy returns and error analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.operators import latest, windows
from furlong.operators.filters import completed_races, fully_priced
from furlong.plans.metrics import LONGSHOT_ODDS


def top_n_bets(
    df: DataFrame, by: list[str], score: str, label: str, odds: str, depths: tuple[int, ...] = (1, 2, 3)
) -> DataFrame:
    """One row per race and strategy: stake, payout of the first winning pick, profit."""
    deepest = max(depths)
    ranked = latest.top_n(
        df, [*by, "race_id"], [F.col(score).desc(), F.col("horse_id").asc()], deepest, "_rank"
    )
    strategies = F.array(
        *[F.struct(F.lit(f"top_{n}").alias("strategy"), F.lit(n).alias("n")) for n in depths]
    )
    long = ranked.withColumn("_s", F.explode(strategies)).filter(F.col("_rank") <= F.col("_s.n"))
    pays = (F.col(label) == 1) & (F.col(odds) > 0)
    races = long.groupBy(*by, F.col("_s.strategy").alias("strategy"), "race_id", "race_date").agg(
        F.count(F.lit(1)).alias("bets"),
        F.coalesce(F.min_by(F.col(odds), F.when(pays, F.col("_rank"))), F.lit(0.0)).alias("payout"),
        F.max(F.coalesce(pays, F.lit(False)).cast("int")).alias("winning_bets"),
        F.avg(odds).alias("selected_average_odds"),
    )
    return races.withColumns(
        {"stake": F.col("bets").cast("double"), "profit": F.col("payout") - F.col("bets")}
    )


def with_drawdown(races: DataFrame, by: list[str]) -> DataFrame:
    return windows.drawdown(races, [*by, "strategy"], ["race_date", "race_id"], "profit")


def top_n_summary(races: DataFrame, by: list[str]) -> DataFrame:
    drawn = with_drawdown(races, by)
    return drawn.groupBy(*by, "strategy").agg(
        F.sum("bets").cast("bigint").alias("bets"),
        F.sum("winning_bets").cast("bigint").alias("wins"),
        F.sum("profit").alias("profit"),
        (F.sum("profit") / F.sum("stake")).alias("roi"),
        F.max("drawdown").alias("max_drawdown"),
    )


def kelly_stake(probability: str, odds: str):
    """(b p - q) / b with b = odds - 1, kept within 0 and 0.25; no edge is no bet."""
    b = F.col(odds) - 1
    edge = F.try_divide(b * F.col(probability) - (1 - F.col(probability)), b)
    return F.coalesce(F.least(F.greatest(edge, F.lit(0.0)), F.lit(0.25)), F.lit(0.0))


def strategies(
    df: DataFrame, probability: str = "ensemble_probability", odds: str = "pre_race_odds", label: str = "winner"
) -> DataFrame:
    """Flat, favourite, value, long-shot and Kelly betting on fully priced completed races."""
    certified = fully_priced(completed_races(df, ["race_id"], label), ["race_id"], odds)
    keep = ["race_id", "horse_id", label, odds, probability]
    base = certified.select(*keep)
    race = ["race_id"]
    tie = F.col("horse_id").asc()
    picks = {
        "flat_betting": latest.latest_by(base, race, [F.col(probability).desc(), tie]),
        "favorite": latest.latest_by(base, race, [F.col(odds).asc(), tie]),
        "value_bet": base.filter(F.col(probability) * F.col(odds) >= 1.05),
        "longshot": latest.latest_by(
            base, race, [F.col(probability).desc(), tie], F.col(odds) >= LONGSHOT_ODDS
        ),
    }
    rows = None
    for name, chosen in picks.items():
        part = chosen.withColumns({"strategy": F.lit(name), "stake": F.lit(1.0)})
        rows = part if rows is None else rows.unionByName(part)
    kelly = base.withColumns({"strategy": F.lit("kelly"), "stake": kelly_stake(probability, odds)})
    rows = rows.unionByName(kelly.filter("stake > 0"))
    payout = F.col("stake") * F.col(odds) * F.col(label)
    totals = rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("stake").alias("stake"), F.sum(payout).alias("payout")
    )
    names = df.sparkSession.createDataFrame([(n,) for n in (*picks, "kelly")], "strategy string")
    filled = names.join(totals, "strategy", "left").fillna(0, ["bets", "stake", "payout"])
    profit = F.col("payout") - F.col("stake")
    return filled.withColumns(
        {
            "profit": profit,
            "roi": F.try_divide(profit, F.col("stake")),
            "status": F.when(F.col("bets") > 0, "CERTIFIED").otherwise("CERTIFIED_NO_BETS"),
        }
    )


def certification(df: DataFrame, odds: str = "pre_race_odds", label: str = "winner") -> DataFrame:
    """One row: CERTIFIED when any completed race is fully priced."""
    certified = fully_priced(completed_races(df, ["race_id"], label), ["race_id"], odds)
    return certified.agg(
        F.when(F.count(F.lit(1)) > 0, "CERTIFIED").otherwise("NOT CERTIFIED").alias("status")
    )


def lost_pick_rates(df: DataFrame, by: list[str], rank: str, label: str, flags: list[str]) -> DataFrame:
    """How often each change flag is set for lost first picks and for actual winners."""
    lost = (F.col(rank) == 1) & (F.col(label) == 0)
    won = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(lost).alias("lost_picks"), F.count_if(won).alias("winners"),
        *[F.avg(F.when(lost, F.col(f).cast("double"))).alias(f"lost_{f}_rate") for f in flags],
        *[F.avg(F.when(won, F.col(f).cast("double"))).alias(f"winner_{f}_rate") for f in flags],
    )
