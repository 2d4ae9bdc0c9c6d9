"""Evaluation metrics, calibration, ranking and strategy returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import base
from furlong.catalog.history import r6
from furlong.catalog.registry import query
from furlong.operators import filters, latest, quality
from furlong.plans import metrics, ml, roi
from furlong.session import load


def _round(df, columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@base.stored
def _scores(spark, d):
    return base.scores_long(spark, d).withColumn("probability", F.round("probability", 9))


L = base.SQL + """, ls AS (SELECT race_id, horse_id, race_date, finish_position, is_win, odds, field_size, model, round(probability, 9) AS probability FROM long_scores)
"""


@query(
    "topn_hit_rates",
    L + """, r AS (SELECT *, row_number() OVER (PARTITION BY model, race_id ORDER BY probability DESC, horse_id) AS rk FROM ls),
g AS (SELECT model, race_id, max(CASE WHEN rk <= 1 THEN is_win ELSE 0 END) AS h1, max(CASE WHEN rk <= 3 THEN is_win ELSE 0 END) AS h3, max(CASE WHEN rk <= 5 THEN is_win ELSE 0 END) AS h5 FROM r GROUP BY ALL)
SELECT model, count(*) AS races, round(avg(h1), 6) AS top1_accuracy, round(avg(h3), 6) AS top3_accuracy, round(avg(h5), 6) AS top5_accuracy FROM g GROUP BY model""",
)
def topn_hit_rates(spark, d):
    out = metrics.hit_rates(_scores(spark, d), ["model"], "probability", "is_win")
    return _round(out, ["top1_accuracy", "top3_accuracy", "top5_accuracy"])


@query(
    "market_accuracy",
    L + """, p AS (SELECT model, race_id, count(odds) = count(*) AS priced, min(odds) AS mo FROM ls GROUP BY ALL),
f AS (SELECT * FROM (SELECT ls.*, row_number() OVER (PARTITION BY ls.model, ls.race_id ORDER BY odds, horse_id) AS fr, row_number() OVER (PARTITION BY ls.model, ls.race_id ORDER BY probability DESC, horse_id) AS tr, p.priced
  FROM ls JOIN p ON ls.model = p.model AND ls.race_id = p.race_id))
SELECT model, round(avg(is_win) FILTER (fr = 1 AND priced), 6) AS favorite_accuracy, round(avg(is_win) FILTER (tr = 1 AND odds >= 10), 6) AS longshot_accuracy,
  count(DISTINCT race_id) FILTER (priced) AS certified_odds_races, round(avg(probability) FILTER (is_win = 1), 6) AS average_winner_probability FROM f GROUP BY model""",
)
def market_accuracy(spark, d):
    out = metrics.market_accuracy(_scores(spark, d), ["model"], "probability", "is_win", "odds")
    return _round(out, ["favorite_accuracy", "longshot_accuracy", "average_winner_probability"])


DOCS = """WITH s AS (SELECT d.doc_id, d.lang, least(1.0, n_chars / 5000.0) AS p, CAST(l.quality AS INTEGER) AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def _docs(spark, d):
    labels = load(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = load(spark, d, "documents").select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("p"))
    return docs.join(labels, "doc_id")


@query(
    "logloss_brier",
    DOCS + """SELECT lang, count(*) AS rows, round(avg(-(y * ln(greatest(least(p, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)))), 6) AS log_loss,
  round(avg((p - y) * (p - y)), 6) AS brier_score FROM s GROUP BY lang""",
)
def logloss_brier(spark, d):
    return _round(metrics.losses(_docs(spark, d), ["lang"], "p", "y"), ["log_loss", "brier_score"])


@query(
    "roc_auc",
    DOCS + """SELECT a.lang, round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*), 6) AS roc_auc
FROM s a JOIN s b ON a.lang = b.lang AND a.y = 1 AND b.y = 0 GROUP BY a.lang""",
)
def roc_auc(spark, d):
    out = metrics.auc(_docs(spark, d), ["lang"], "p", "y")
    return _round(out.filter("roc_auc IS NOT NULL"), ["roc_auc"]).drop("pr_auc")


@query(
    "average_precision",
    L + """, c AS (SELECT model, probability, sum(is_win) AS pos, count(*) AS n FROM ls GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k FROM c WINDOW w AS (PARTITION BY model ORDER BY probability DESC))
SELECT model, round(sum(CAST(pos AS DOUBLE) * tp / k) / sum(pos), 6) AS pr_auc FROM r GROUP BY model""",
)
def average_precision(spark, d):
    return _round(metrics.auc(_scores(spark, d), ["model"], "probability", "is_win"), ["pr_auc"]).drop("roc_auc")


@query(
    "confusion_metrics",
    L + """, c AS (SELECT model, count(*) FILTER (probability >= 0.5 AND is_win = 1) AS tp, count(*) FILTER (probability >= 0.5 AND is_win = 0) AS fp,
  count(*) FILTER (probability < 0.5 AND is_win = 1) AS fn, count(*) FILTER (probability < 0.5 AND is_win = 0) AS tn FROM ls GROUP BY model)
SELECT model, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 6) AS accuracy,
  round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
)
def confusion_metrics(spark, d):
    return _round(metrics.confusion(_scores(spark, d), ["model"], "probability", "is_win"), ["accuracy", "precision", "recall", "f1"])


BIN = "greatest(1, least(10, CAST(len(list_filter([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], lambda e: CAST(e AS DOUBLE) < probability)) AS INTEGER)))"


@query(
    "ece_reliability",
    L + f""", b AS (SELECT model, {BIN} AS bin, count(*) AS n, avg(probability) AS mp, avg(is_win) AS o FROM ls GROUP BY ALL)
SELECT m.model, CAST(g.bin AS INTEGER) AS bin, round((g.bin - 1) / 10.0, 6) AS bin_lower, round(g.bin / 10.0, 6) AS bin_upper, coalesce(n, 0) AS count, round(mp, 6) AS mean_probability, round(o, 6) AS observed_rate, round(abs(mp - o), 6) AS absolute_gap
FROM (VALUES ('a'), ('b'), ('c')) AS m(model) CROSS JOIN range(1, 11) AS g(bin) LEFT JOIN b ON b.model = m.model AND b.bin = g.bin""",
)
def ece_reliability(spark, d):
    out = metrics.reliability(_scores(spark, d), ["model"], "probability", "is_win")
    return _round(out, ["bin_lower", "bin_upper", "mean_probability", "observed_rate", "absolute_gap"])


@query(
    "calibration_weekly",
    L + f""", w AS (SELECT *, CAST(date_trunc('week', race_date) AS DATE) AS monday, {BIN} AS bin FROM ls),
b AS (SELECT monday, model, bin, count(*) AS n, abs(avg(probability) - avg(is_win)) AS gap FROM w GROUP BY ALL),
e AS (SELECT monday, model, sum(n * gap) / sum(n) AS ece, max(gap) AS mce FROM b GROUP BY ALL),
r AS (SELECT monday, model, count(DISTINCT race_id) AS races FROM w GROUP BY ALL)
SELECT strftime(e.monday, '%Y-%m-%d') || '/' || strftime(e.monday + INTERVAL 6 DAY, '%Y-%m-%d') AS week, e.model, round(ece, 6) AS ece, round(mce, 6) AS mce,
  CASE WHEN races >= 20 AND ece >= 0.15 THEN 'CRITICAL' WHEN races >= 20 THEN 'PASS' ELSE 'INSUFFICIENT_DATA' END AS status, CAST(10 AS BIGINT) AS bins
FROM e JOIN r ON e.monday = r.monday AND e.model = r.model""",
)
def calibration_weekly(spark, d):
    from furlong.functions.dates import week_label

    rows = _scores(spark, d).withColumn("week", week_label("race_date"))
    out = metrics.calibration_history(rows, ["week", "model"], "probability", "is_win")
    return out.groupBy("week", "model").agg(
        r6(F.max("ece"), "ece"), r6(F.max("mce"), "mce"), F.max("status").alias("status"), F.count(F.lit(1)).alias("bins")
    )


@query(
    "rank_metrics",
    L + """, r AS (SELECT *, row_number() OVER (PARTITION BY model, race_id ORDER BY probability DESC, horse_id) AS pos, row_number() OVER (PARTITION BY model, race_id ORDER BY finish_position, horse_id) AS fp FROM ls),
t AS (SELECT *, avg(pos) OVER (PARTITION BY model, race_id, probability) AS ps, avg(1.0 / log2(pos + 1)) OVER (PARTITION BY model, race_id, probability) AS disc, avg(fp) OVER (PARTITION BY model, race_id, finish_position) AS pf FROM r),
g AS (SELECT model, race_id, CASE WHEN count(DISTINCT ps) > 1 AND count(DISTINCT pf) > 1 THEN corr(ps, pf) END AS rho, sum(is_win * disc) AS dcg, min(pos) FILTER (is_win = 1) AS best FROM t GROUP BY ALL)
SELECT model, round(avg(rho), 6) AS rank_correlation, round(avg(dcg), 6) AS ndcg, round(avg(1.0 / best), 6) AS mean_reciprocal_rank FROM g GROUP BY model""",
)
def rank_metrics(spark, d):
    out = metrics.rank_metrics(_scores(spark, d), ["model"], "probability", "finish_position")
    return _round(out, ["rank_correlation", "ndcg", "mean_reciprocal_rank"])


@query(
    "rolling_90d",
    L + """, ok AS (SELECT race_id, model FROM ls GROUP BY ALL HAVING sum(is_win) = 1), v AS (SELECT ls.* FROM ls JOIN ok ON ls.race_id = ok.race_id AND ls.model = ok.model),
roll AS (SELECT (SELECT max(race_date) FROM v) AS metric_date, 'rolling_90d' AS "window", v.* FROM v WHERE race_date >= (SELECT max(race_date) FROM v) - 89),
x AS (SELECT *, row_number() OVER (PARTITION BY model, race_id ORDER BY probability DESC, horse_id) AS rk FROM roll)
SELECT metric_date, "window", model, count(DISTINCT race_id) AS races, count(*) AS rows, round(CAST(sum(is_win) FILTER (rk = 1) AS DOUBLE) / count(DISTINCT race_id), 6) AS top1_accuracy, round(avg((probability - is_win) * (probability - is_win)), 6) AS brier_score FROM x GROUP BY ALL""",
)
def rolling_90d(spark, d):
    rows = metrics.attach_certified_odds(
        _scores(spark, d).withColumns({"winner": F.col("is_win"), "prediction_time": F.col("race_date").cast("timestamp")})
    )
    out = metrics.live_metrics(rows).filter(F.col("window") == "rolling_90d")
    return out.select(
        "metric_date", "window", "model", "races", "rows", r6("top1_accuracy"), r6("brier_score")
    )


@query(
    "attach_certified_odds",
    base.SQL + "SELECT prediction_id, odds AS pre_race_odds, prediction_time AS pre_race_odds_captured_at FROM runs",
)
def attach_certified_odds(spark, d):
    return metrics.attach_certified_odds(base.predictions(spark, d)).select(
        "prediction_id", "pre_race_odds", "pre_race_odds_captured_at"
    )


@query(
    "all_priced",
    base.SQL + ", ok AS (SELECT race_id FROM prog GROUP BY race_id HAVING count(odds) = count(*)) SELECT race_id, entrant, odds FROM prog WHERE race_id IN (SELECT race_id FROM ok)",
)
def all_priced(spark, d):
    return filters.fully_priced(base.program(spark, d), ["race_id"], "odds").select("race_id", "entrant", "odds")


@query(
    "roi_topn_drawdown",
    L + """, r AS (SELECT *, row_number() OVER (PARTITION BY model, race_id ORDER BY probability DESC, horse_id) AS rk FROM ls),
b AS (SELECT r.model, s.n, race_id, race_date, count(*) AS bets, coalesce(max(odds) FILTER (is_win = 1 AND odds > 0), 0.0) AS payout, max(CASE WHEN is_win = 1 AND odds > 0 THEN 1 ELSE 0 END) AS w
  FROM r JOIN (VALUES (1), (2), (3)) AS s(n) ON r.rk <= s.n GROUP BY ALL),
c AS (SELECT *, payout - bets AS profit, sum(payout - bets) OVER (PARTITION BY model, n ORDER BY race_date, race_id) AS cum FROM b),
k AS (SELECT *, greatest(0.0, max(cum) OVER (PARTITION BY model, n ORDER BY race_date, race_id)) AS peak FROM c)
SELECT model, 'top_' || n AS strategy, CAST(sum(bets) AS BIGINT) AS bets, CAST(sum(w) AS BIGINT) AS wins, round(sum(profit), 4) AS profit, round(sum(profit) / sum(bets), 6) AS roi, round(max(peak - cum), 4) AS max_drawdown FROM k GROUP BY model, n""",
)
def roi_topn_drawdown(spark, d):
    races = roi.top_n_bets(_scores(spark, d), ["model"], "probability", "is_win", "odds")
    out = roi.top_n_summary(races, ["model"])
    return _round(_round(out, ["profit", "max_drawdown"], 4), ["roi"])


@query(
    "roi_strategies_kelly",
    base.SQL + """, f AS (SELECT race_id, entrant AS horse_id, round(p1, 9) AS p, odds * 3 AS odds, CASE WHEN finish = 1 THEN 1 ELSE 0 END AS winner FROM shares),
ok AS (SELECT race_id FROM f GROUP BY race_id HAVING sum(winner) = 1 AND count(odds) = count(*)), c AS (SELECT f.* FROM f JOIN ok USING (race_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY p DESC, horse_id) AS pr, row_number() OVER (PARTITION BY race_id ORDER BY odds, horse_id) AS orank,
  CASE WHEN odds >= 10 THEN row_number() OVER (PARTITION BY race_id, odds >= 10 ORDER BY p DESC, horse_id) END AS lr FROM c),
bets AS (SELECT 'flat_betting' AS strategy, 1.0 AS stake, odds, winner FROM rk WHERE pr = 1 UNION ALL SELECT 'favorite', 1.0, odds, winner FROM rk WHERE orank = 1
  UNION ALL SELECT 'value_bet', 1.0, odds, winner FROM rk WHERE p * odds >= 1.05 UNION ALL SELECT 'longshot', 1.0, odds, winner FROM rk WHERE lr = 1
  UNION ALL SELECT 'kelly', k, odds, winner FROM (SELECT *, coalesce(least(greatest(((odds - 1) * p - (1 - p)) / nullif(odds - 1, 0), 0.0), 0.25), 0.0) AS k FROM rk) WHERE k > 0)
SELECT strategy, count(*) AS bets, round(sum(stake), 4) AS stake, round(sum(stake * odds * winner), 4) AS payout, round(sum(stake * odds * winner) - sum(stake), 4) AS profit,
  round((sum(stake * odds * winner) - sum(stake)) / sum(stake), 6) AS roi, 'CERTIFIED' AS status FROM bets GROUP BY strategy""",
)
def roi_strategies_kelly(spark, d):
    rows = base.field(spark, d).select(
        "race_id", F.col("entrant").alias("horse_id"), F.round("p1", 9).alias("ensemble_probability"),
        (F.col("odds") * 3).alias("pre_race_odds"), (F.col("finish") == 1).cast("int").alias("winner"),
    )
    return _round(_round(roi.strategies(rows), ["stake", "payout", "profit"], 4), ["roi"])


@query(
    "roi_certification",
    base.SQL + ", f AS (SELECT race_id, odds FROM prog), ok AS (SELECT race_id FROM f GROUP BY race_id HAVING count(odds) = count(*)) SELECT CASE WHEN count(*) > 0 THEN 'CERTIFIED' ELSE 'NOT CERTIFIED' END AS status FROM ok",
)
def roi_certification(spark, d):
    rows = base.field(spark, d).withColumns({"winner": (F.col("finish") == 1).cast("int"), "pre_race_odds": F.col("odds")})
    return roi.certification(rows)


@query(
    "lost_pick_rates",
    base.SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY round(p1, 9) DESC, entrant) AS rk FROM shares),
x AS (SELECT track, rk, CASE WHEN finish = 1 THEN 1 ELSE 0 END AS w, CASE WHEN surface = 'Kum' THEN 1 ELSE 0 END AS dirt_change, CASE WHEN weight > 25 THEN 1 ELSE 0 END AS weight_change FROM r)
SELECT track, count(*) FILTER (rk = 1 AND w = 0) AS lost_picks, count(*) FILTER (w = 1) AS winners, round(avg(dirt_change) FILTER (rk = 1 AND w = 0), 6) AS lost_dirt_change_rate, round(avg(weight_change) FILTER (rk = 1 AND w = 0), 6) AS lost_weight_change_rate,
  round(avg(dirt_change) FILTER (w = 1), 6) AS winner_dirt_change_rate, round(avg(weight_change) FILTER (w = 1), 6) AS winner_weight_change_rate FROM x GROUP BY track""",
)
def lost_pick_rates(spark, d):
    from furlong.operators import windows

    rows = base.field(spark, d).withColumns(
        {"k": F.round("p1", 9), "w": (F.col("finish") == 1).cast("int"), "dirt_change": (F.col("surface") == "Kum").cast("int"),
         "weight_change": (F.col("weight") > 25).cast("int")}
    )
    ranked = windows.rank_first(rows, ["race_id"], "k", ["entrant"], "rk")
    out = roi.lost_pick_rates(ranked, ["track"], "rk", "w", ["dirt_change", "weight_change"])
    return _round(out, [c for c in out.columns if c.endswith("_rate")])


@query(
    "best_model",
    L + """, r AS (SELECT *, row_number() OVER (PARTITION BY model, race_id ORDER BY probability DESC, horse_id) AS rk FROM ls),
s AS (SELECT model, round(CAST(sum(is_win) FILTER (rk = 1) AS DOUBLE) / count(DISTINCT race_id), 6) AS top1_accuracy,
  round(avg(-(is_win * ln(greatest(least(probability, 1 - 1e-12), 1e-12)) + (1 - is_win) * ln(1 - greatest(least(probability, 1 - 1e-12), 1e-12)))), 6) AS log_loss FROM r GROUP BY model)
SELECT model, top1_accuracy, log_loss FROM s ORDER BY top1_accuracy DESC, log_loss, model LIMIT 1""",
)
def best_model(spark, d):
    rows = _scores(spark, d)
    scores = metrics.hit_rates(rows, ["model"], "probability", "is_win", (1,)).join(
        metrics.losses(rows, ["model"], "probability", "is_win"), "model"
    )
    out = _round(scores, ["top1_accuracy", "log_loss"])
    return metrics.best_model(out).select("model", "top1_accuracy", "log_loss")


@query("valid_races", base.SQL + ", w AS (SELECT race_id FROM res GROUP BY race_id HAVING count(*) FILTER (finish_position = 1) = 1 AND count(*) >= 2) SELECT race_id, horse_id FROM res WHERE race_id IN (SELECT race_id FROM w)")
def valid_races(spark, d):
    rows = base.results(spark, d).withColumn("is_win", F.coalesce((F.col("finish_position") == 1).cast("int"), F.lit(0)))
    return filters.valid_races(rows, ["race_id"], "is_win").select("race_id", "horse_id")


@query("completed_races", base.SQL + ", w AS (SELECT race_id FROM res GROUP BY race_id HAVING count(*) = count(finish_position) AND count(*) FILTER (finish_position = 1) = 1) SELECT race_id, horse_id FROM res WHERE race_id IN (SELECT race_id FROM w)")
def completed_races(spark, d):
    rows = base.results(spark, d).withColumn("winner", (F.col("finish_position") == 1).cast("int"))
    return filters.completed_races(rows, ["race_id"], "winner").select("race_id", "horse_id")


@query(
    "probability_sum_check",
    base.SQL + "SELECT race_id, entrant, abs(sum(p1) OVER (PARTITION BY race_id) - 1) <= 1e-6 AS probability_sum_valid, sum(weight) OVER (PARTITION BY race_id) AS weight_sum FROM shares",
)
def probability_sum_check(spark, d):
    out = quality.group_sum_check(base.field(spark, d), ["race_id"], "p1")
    out = out.select("race_id", "entrant", "weight", "probability_sum_valid")
    return quality.group_sum_check(out.withColumnRenamed("probability_sum_valid", "ok"), ["race_id"], "weight").select(
        "race_id", "entrant", F.col("ok").alias("probability_sum_valid"), F.col("probability_sum").alias("weight_sum")
    )


@query(
    "topn_per_group",
    base.SQL + "SELECT * FROM (SELECT track, race_id, entrant, odds, CAST(row_number() OVER (PARTITION BY track ORDER BY odds DESC NULLS LAST, race_id, entrant) AS INTEGER) AS rank FROM prog) WHERE rank <= 3",
)
def topn_per_group(spark, d):
    rows = base.program(spark, d).select("track", "race_id", "entrant", "odds")
    return latest.top_n(rows, ["track"], [F.col("odds").desc_nulls_last(), F.col("race_id"), F.col("entrant")], 3)


@query(
    "min_rank",
    """SELECT o_orderpriority AS grp, o_orderkey AS id, CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE round(o_totalprice / 1000) END DESC NULLS LAST) AS INTEGER) AS rank FROM orders""",
)
def min_rank(spark, d):
    rows = load(spark, d, "orders").select(
        F.col("o_orderpriority").alias("grp"), F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderkey") % 10 != 0, F.round(F.col("o_totalprice") / 1000)).otherwise(F.lit(float("nan"))).alias("importance"),
    )
    return ml.importance_rank(rows, ["grp"]).select("grp", "id", "rank")


def _training(spark, d):
    """Model rows from the programme: seven features, label, odds, day."""
    rows = base.field(spark, d).filter("field_size >= 2")
    return rows.select(
        "race_id", F.col("entrant").alias("horse_id"), F.col("race_start_at").cast("date").alias("race_date"),
        F.col("track"), "surface", "race_class", "distance", F.col("weight").alias("carried_weight"), "price", "discount",
        F.col("finish").cast("double").alias("finish_position"), (F.col("finish") == 1).cast("int").alias("is_win"), "odds",
    )


NUMERIC = ["distance", "carried_weight", "price", "discount"]
CATEGORICAL = ["track", "surface", "race_class"]


@query("ml_temporal_backtest")
def ml_temporal_backtest(spark, d):
    """Two yearly folds: train on earlier years, score the year, all metrics per model."""
    rows = ml.prepare(_training(spark, d), NUMERIC, CATEGORICAL)
    reports = None
    # A fold is reported on its own: a union of both forgets that rows lie by race, and races would be shuffled into few large tasks.
    with base.race_cold(spark, d):
        for year, name in ((1999, "validation"), (2000, "test")):
            fold = ml.year_fold(rows, "race_date", year, name)
            models = ml.fit(fold.train, ml.estimators(NUMERIC, CATEGORICAL))
            scored = ml.score(fold.evaluate, models)
            long = ml.long_scores(scored, [*models, "ensemble"]).withColumn("split", F.lit(name))
            report = ml.score_report(long, ["split", "model"])
            reports = report if reports is None else reports.unionByName(report)
    return reports


@query("permutation_importance")
def permutation_importance(spark, d):
    rows = ml.prepare(_training(spark, d), NUMERIC, CATEGORICAL)
    fold = ml.year_fold(rows, "race_date", 2000, "test")
    model = ml.estimators(NUMERIC, CATEGORICAL, trees=3)["logistic"].fit(ml.class_weights(fold.train))
    out = ml.permutation_importance(model, fold.evaluate, [*NUMERIC, *CATEGORICAL], repeats=2)
    return ml.importance_rank(out.withColumn("model", F.lit("logistic")), ["model"])


@query("gain_importance")
def gain_importance(spark, d):
    rows = ml.prepare(_training(spark, d), NUMERIC, CATEGORICAL)
    fold = ml.year_fold(rows, "race_date", 2000, "test")
    model = ml.estimators(NUMERIC, CATEGORICAL, trees=3)["xgboost"].fit(ml.class_weights(fold.train))
    return ml.gain_importance(model, fold.evaluate, NUMERIC, CATEGORICAL)


@query(
    "temporal_split_audit",
    base.SQL + """, r AS (SELECT race_id, CAST(race_start_at AS DATE) AS day FROM shares WHERE field_size >= 2)
SELECT 'train' AS part, count(*) AS rows, count(DISTINCT race_id) AS races, min(day) AS first_day, max(day) AS last_day FROM r WHERE day < '2000-01-01'
UNION ALL SELECT 'evaluate', count(*), count(DISTINCT race_id), min(day), max(day) FROM r WHERE year(day) = 2000""",
)
def temporal_split_audit(spark, d):
    return ml.split_audit(ml.year_fold(_training(spark, d), "race_date", 2000, "test"), "race_date")


@query(
    "date_share_cutoff",
    "WITH u AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), n AS (SELECT day, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS t FROM u) SELECT day AS cutoff FROM n WHERE k = floor(t * 0.8) + 1",
)
def date_share_cutoff(spark, d):
    return ml.date_share_cutoff(load(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")


@query(
    "model_feature_prep",
    """SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END, 'missing') AS status, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price FROM orders""",
)
def model_feature_prep(spark, d):
    rows = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string")).otherwise(F.lit("n/a")).alias("price"),
    )
    return ml.prepare(rows, ["price"], ["status"])
