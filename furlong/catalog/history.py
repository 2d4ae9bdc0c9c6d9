"""As-of joins, history windows and feature builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong import schemas
from furlong.catalog import base
from furlong.catalog.registry import query
from furlong.functions import text
from furlong.operators import asof, latest, quality, skew, windows
from furlong.plans import features, metrics
from furlong.session import load


def r6(column, name=None):
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name or column)


@query(
    "q_min_slice",
    base.SQL + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY p1 DESC, entrant) AS rk FROM shares WHERE field_size >= 2)
SELECT priority AS track, count(*) AS races, CAST(sum(CASE WHEN finish = 1 THEN 1 ELSE 0 END) AS BIGINT) AS top1_hits,
  round(avg(CASE WHEN finish = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1_accuracy, round(avg(p1), 6) AS mean_top_prob
FROM ranked WHERE rk = 1 GROUP BY priority""",
)
def q_min_slice(spark, d):
    """Latest eligible snapshot per entrant, normalised score, top-1 hit rate per track."""
    rows = base.field(spark, d).filter("field_size >= 2")
    top = latest.latest_by(rows, ["race_id"], [F.col("p1").desc(), F.col("entrant").asc()])
    hit = (F.col("finish") == 1).cast("int")
    return top.groupBy(F.col("priority").alias("track")).agg(
        F.count(F.lit(1)).alias("races"), F.sum(hit).cast("bigint").alias("top1_hits"),
        r6(F.avg(hit.cast("double")), "top1_accuracy"), r6(F.avg("p1"), "mean_top_prob"),
    )


@query("asof_latest_snapshot", base.SQL + "SELECT race_id, entrant, snapshot_id, captured_at, race_start_at FROM prog")
def asof_latest_snapshot(spark, d):
    return base.program(spark, d).select("race_id", "entrant", "snapshot_id", "captured_at", "race_start_at")


@query(
    "asof_market_strict",
    """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
SELECT l.event_id, l.user_id, r.ts AS seen_at, r.value AS seen_value
FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts > r.ts""",
)
def asof_market_strict(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = asof.asof_join(
        events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"),
        ["user_id"], "ts", "ts", {"ts": "seen_at", "value": "seen_value"},
    )
    return out.select("event_id", "user_id", "seen_at", "seen_value")


@query(
    "asof_market_inclusive",
    """WITH l AS (SELECT event_id, user_id, date_trunc('day', ts) AS t FROM events WHERE event_type = 'purchase'),
r AS (SELECT event_id AS rid, user_id, date_trunc('day', ts) AS t, value FROM events WHERE event_type = 'view'),
j AS (SELECT l.event_id, l.user_id, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.t DESC, r.rid DESC) AS rn
  FROM l JOIN r ON l.user_id = r.user_id AND r.t <= l.t)
SELECT l.event_id, l.user_id, j.value AS seen_value FROM l LEFT JOIN j ON l.event_id = j.event_id AND j.rn = 1""",
)
def asof_market_inclusive(spark, d):
    events = load(spark, d, "events").select(
        "event_id", "user_id", F.date_trunc("day", "ts").alias("t"), "event_type", "value"
    )
    out = asof.asof_join(
        events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"),
        ["user_id"], "t", "t", {"value": "seen_value"}, allow_exact=True, tie_break=["event_id"],
    )
    return out.select("event_id", "user_id", "seen_value")


@query(
    "asof_latest_before_start",
    base.SQL + """, best AS (
  SELECT race_id, horse, race_start_at, max({'c': captured_at, 'p': price}) AS b FROM snap WHERE captured_at < race_start_at GROUP BY ALL),
t AS (SELECT DISTINCT race_id, horse, race_start_at FROM snap)
SELECT t.race_id, t.horse, b.b.c AS seen_at, b.b.p AS price FROM t LEFT JOIN best b ON t.race_id = b.race_id AND t.horse = b.horse""",
)
def asof_latest_before_start(spark, d):
    snaps = base.snapshots(spark, d).select("race_id", "horse", "race_start_at", "captured_at", "price")
    targets = snaps.select("race_id", "horse", "race_start_at").distinct()
    return asof.latest_before(
        targets, snaps, ["race_id", "horse"], "race_start_at", "captured_at",
        {"captured_at": "seen_at", "price": "price"},
    ).select("race_id", "horse", "seen_at", "price")


HISTORY_SQL = base.SQL + """, hist AS (
  SELECT *, CASE WHEN entrant <> 4 THEN CAST(finish AS DOUBLE) END AS fin FROM shares)
"""


def _hist(spark, d):
    rows = base.field(spark, d)
    return rows.withColumn("fin", F.when(F.col("entrant") != 4, F.col("finish").cast("double")))


ORDER = ["race_start_at", "race_id", "entrant"]


@query(
    "history_rolling_n",
    HISTORY_SQL + """SELECT race_id, entrant, horse, round(avg(fin) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS last_3,
  round(avg(fin) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS last_5,
  round(avg(fin) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS last_10
FROM hist WINDOW w AS (PARTITION BY horse ORDER BY race_start_at, race_id, entrant)""",
)
def history_rolling_n(spark, d):
    out = windows.rolling_prior_mean(_hist(spark, d), ["horse"], ORDER, "fin", {3: "last_3", 5: "last_5", 10: "last_10"})
    return out.select("race_id", "entrant", "horse", r6("last_3"), r6("last_5"), r6("last_10"))


@query(
    "history_rolling_nonnull",
    HISTORY_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY horse ORDER BY race_start_at, race_id, entrant) AS rn FROM hist),
j AS (SELECT a.race_id, a.entrant, b.fin, row_number() OVER (PARTITION BY a.race_id, a.entrant ORDER BY b.rn DESC) AS k
  FROM n a JOIN n b ON a.horse = b.horse AND b.rn < a.rn AND b.fin IS NOT NULL)
SELECT h.race_id, h.entrant, h.horse, round(avg(fin_) FILTER (k <= 3), 6) AS last_3, round(avg(fin_) FILTER (k <= 5), 6) AS last_5
FROM hist h LEFT JOIN (SELECT race_id, entrant, fin AS fin_, k FROM j) j ON h.race_id = j.race_id AND h.entrant = j.entrant
GROUP BY h.race_id, h.entrant, h.horse""",
)
def history_rolling_nonnull(spark, d):
    out = windows.rolling_prior_mean(_hist(spark, d), ["horse"], ORDER, "fin", {3: "last_3", 5: "last_5"}, skip_nulls=True)
    return out.select("race_id", "entrant", "horse", r6("last_3"), r6("last_5"))


RATE_SQL = """round(CASE WHEN count(*) OVER w > 0 THEN sum(CASE WHEN fin = 1 THEN 1.0 ELSE 0.0 END) OVER w / count(*) OVER w END, 6)"""


@query(
    "prior_win_rate",
    HISTORY_SQL + f"""SELECT race_id, entrant, horse, surface, {RATE_SQL} AS rate FROM hist
WINDOW w AS (PARTITION BY horse, surface ORDER BY race_start_at, race_id, entrant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_win_rate(spark, d):
    rows = _hist(spark, d)
    out = windows.prior_rate(rows, ["horse"], "surface", ORDER, F.col("fin") == 1, "rate")
    return out.select("race_id", "entrant", "horse", "surface", r6("rate"))


@query(
    "prior_rate_normalised",
    HISTORY_SQL + f""", k AS (SELECT *, CASE surface WHEN 'Kum' THEN 'k:' WHEN 'Çim' THEN 'ç:' END AS key FROM hist)
SELECT race_id, entrant, horse, key, CASE WHEN key IS NOT NULL THEN {RATE_SQL} END AS rate FROM k
WINDOW w AS (PARTITION BY horse, key ORDER BY race_start_at, race_id, entrant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def prior_rate_normalised(spark, d):
    key = F.nullif(F.replace(text.surface_keyword("surface"), F.lit("s:"), F.lit("")), F.lit(""))
    rows = _hist(spark, d).withColumn("key", key)
    out = windows.prior_rate(rows, ["horse"], "key", ORDER, F.col("fin") == 1, "rate", missing="null")
    return out.select("race_id", "entrant", "horse", "key", r6("rate"))


@query(
    "lag_changes",
    HISTORY_SQL + """, l AS (SELECT *, lag(weight) OVER w AS pw, lag(race_class) OVER w AS pc, lag(surface) OVER w AS ps FROM hist
  WINDOW w AS (PARTITION BY horse ORDER BY race_start_at, race_id, entrant))
SELECT race_id, entrant, horse, weight - pw AS weight_change,
  CASE WHEN pc IS NULL THEN 1 ELSE CAST(race_class <> pc AS INTEGER) END AS class_change,
  CASE WHEN ps IS NOT NULL THEN CAST(surface <> ps AS INTEGER) END AS surface_change FROM l""",
)
def lag_changes(spark, d):
    out = windows.lag_columns(_hist(spark, d), ["horse"], ORDER, {"weight": "pw", "race_class": "pc", "surface": "ps"})
    return out.select(
        "race_id", "entrant", "horse", (F.col("weight") - F.col("pw")).alias("weight_change"),
        windows.change_flag(F.col("race_class"), F.col("pc"), 1).alias("class_change"),
        windows.change_flag(F.col("surface"), F.col("ps")).alias("surface_change"),
    )


@query(
    "days_since",
    """SELECT event_id, user_id, CAST(date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) AS DOUBLE) AS whole_days,
  round((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 86400000000.0, 6) AS fractional_days
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def days_since(spark, d):
    events = load(spark, d, "events").select("event_id", "user_id", "ts")
    out = windows.lag_columns(events, ["user_id"], ["ts", "event_id"], {"ts": "p"})
    return out.select(
        "event_id", "user_id",
        windows.days_between(F.col("ts").cast("date"), F.col("p").cast("date"), True).alias("whole_days"),
        r6(windows.days_between(F.col("ts"), F.col("p"), False), "fractional_days"),
    )


@query(
    "same_day_quarantine",
    HISTORY_SQL + """, c AS (SELECT *, count(*) OVER (PARTITION BY horse, CAST(race_start_at AS DATE)) = 1 AS certified,
  lag(price) OVER (PARTITION BY horse ORDER BY race_start_at, race_id, entrant) AS prev FROM hist)
SELECT race_id, entrant, horse, certified, CASE WHEN certified THEN prev END AS rating FROM c""",
)
def same_day_quarantine(spark, d):
    rows = windows.lag_columns(_hist(spark, d), ["horse"], ORDER, {"price": "prev"})
    rows = windows.same_day_alone(rows.withColumn("day", F.col("race_start_at").cast("date")), ["horse"], "day", "certified")
    return rows.select("race_id", "entrant", "horse", "certified", F.when(F.col("certified"), F.col("prev")).alias("rating"))


@query(
    "field_completeness",
    """WITH s AS (SELECT l_orderkey AS race_id, count(*) AS found, count(DISTINCT l_linenumber) AS u, min(l_linenumber) AS mn, max(l_linenumber) AS mx
  FROM lineitem GROUP BY l_orderkey)
SELECT race_id, CAST(found AS BIGINT) AS found_starters, CAST(mx AS DOUBLE) AS expected_starters_min,
  CAST(greatest(0, mx - u) AS DOUBLE) AS missing_starters_min,
  found >= 2 AND u = found AND mn = 1 AND mx = found AS race_field_complete FROM s""",
)
def field_completeness(spark, d):
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("race_id"), "l_linenumber")
    return quality.field_completeness(rows, ["race_id"], "l_linenumber")


@query(
    "history_range_join",
    HISTORY_SQL + """SELECT a.race_id, a.entrant, a.horse, count(b.race_id) AS earlier_starts, round(sum(b.price), 2) AS earlier_prices
FROM hist a LEFT JOIN hist b ON a.horse = b.horse AND b.race_start_at < a.race_start_at GROUP BY a.race_id, a.entrant, a.horse""",
)
def history_range_join(spark, d):
    """History strictly before each row, without pairing rows: running totals of earlier
    instants, looked up as of the row's start."""
    rows = _hist(spark, d)
    per_start = rows.groupBy("horse", "race_start_at").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("s"))
    totals = skew.running(
        per_start, ["horse"], ["race_start_at"], {"starts": ("sum", F.col("n")), "prices": ("sum", F.col("s"))}
    ).select("horse", "race_start_at", "starts", "prices")
    return rows.join(totals, ["horse", "race_start_at"]).select(
        "race_id", "entrant", "horse", F.col("starts").alias("earlier_starts"),
        F.round(F.when(F.col("starts") > 0, F.col("prices")), 2).alias("earlier_prices"),
    )


@query(
    "normalise_ensemble_rank",
    base.SQL + """SELECT race_id, entrant, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3, round((p1 + p2 + p3) / 3, 6) AS ensemble,
  CAST(row_number() OVER (PARTITION BY race_id ORDER BY round((p1 + p2 + p3) / 3, 9) DESC, entrant) AS INTEGER) AS predicted_rank FROM shares""",
)
def normalise_ensemble_rank(spark, d):
    rows = base.field(spark, d).withColumn("ensemble", windows.row_mean(["p1", "p2", "p3"]))
    rows = rows.withColumn("key", F.round("ensemble", 9))
    out = windows.rank_first(rows, ["race_id"], "key", ["entrant"])
    return out.select(
        "race_id", "entrant", r6("p1"), r6("p2"), r6("p3"), r6("ensemble"), F.col("predicted_rank").cast("int").alias("predicted_rank")
    )


FEATURE_COLUMNS = [
    "days_since_last_race", "last_3_avg_position", "last_5_avg_position", "last_10_avg_position",
    "surface_win_rate", "distance_win_rate", "track_win_rate", "jockey_horse_win_rate",
    "trainer_horse_win_rate", "weight_change", "distance_change",
]


def _feature_sql(days: str, means: str, flags: str, before: str) -> str:
    """Features of targets ``t`` from history ``h`` by pairing (small data only)."""
    rates = ", ".join(
        f"round(CAST(count(*) FILTER (h_{k} = t_{k} AND fin = 1) AS DOUBLE) / nullif(count(*) FILTER (h_{k} = t_{k}), 0), 6) AS {n}"
        for k, n in (("surface", "surface_win_rate"), ("distance", "distance_win_rate"), ("track", "track_win_rate"),
                     ("jockey", "jockey_horse_win_rate"), ("trainer", "trainer_horse_win_rate"))
    )
    sides = ", ".join(
        f"t.{c} AS t_{c}, h.{c} AS h_{c}" for c in ("surface", "distance", "track", "jockey", "trainer", "weight", "race_class")
    )
    return f""", pairs AS (
  SELECT t.race_id, t.horse, t.start AS t_start, h.start AS h_start, h.race_id AS h_race, h.fin, {sides},
    CASE WHEN h.race_id IS NOT NULL THEN row_number() OVER (PARTITION BY t.race_id, t.horse ORDER BY h.start DESC NULLS LAST, h.race_no DESC, h.race_id DESC) END AS rn,
    CASE WHEN h.fin IS NOT NULL THEN row_number() OVER (PARTITION BY t.race_id, t.horse, h.fin IS NULL ORDER BY h.start DESC, h.race_no DESC, h.race_id DESC) END AS kn
  FROM t LEFT JOIN h ON t.horse = h.horse AND h.start < t.start)
SELECT race_id, horse AS horse_id, {days} AS days_since_last_race,
  {', '.join(f'round(avg(fin) FILTER ({means} <= {n}), 6) AS last_{n}_avg_position' for n in (3, 5, 10))},
  {rates.replace('count(*) FILTER (h_', 'count(*) FILTER (h_race IS NOT NULL AND h_')},
  max(t_weight - h_weight) FILTER (rn = 1) AS weight_change, max(t_distance - h_distance) FILTER (rn = 1) AS distance_change,
  {flags}
FROM pairs GROUP BY race_id, horse"""


FE1_SQL = base.SQL + """, fp AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY race_id, horse ORDER BY captured_at DESC, snapshot_id DESC) AS rn
    FROM snap WHERE captured_at < race_start_at) WHERE rn = 1),
lp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY race_id, horse ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM snap) WHERE rn = 1),
t AS (SELECT *, race_start_at AS start FROM fp),
h AS (
  SELECT horse, race_start_at AS start, race_no, race_id, weight, race_class, distance, surface, track, jockey, trainer, CAST(entrant AS DOUBLE) AS fin FROM fp WHERE horse % 7 <> 0
  UNION ALL
  SELECT horse, race_start_at, 1, race_id, weight, race_class, distance, surface, track, jockey, trainer, CASE WHEN entrant <> 4 THEN CAST(entrant AS DOUBLE) END
  FROM lp WHERE NOT EXISTS (SELECT 1 FROM fp WHERE fp.race_id = lp.race_id AND fp.horse = lp.horse AND fp.horse % 7 <> 0))
""" + _feature_sql(
    "round((epoch_us(max(t_start)) - epoch_us(max(h_start))) / 86400000000.0, 6)", "rn",
    "CAST(max(CASE WHEN t_race_class <> h_race_class THEN 1 ELSE 0 END) FILTER (rn = 1) AS INTEGER) AS class_change, "
    "CAST(max(CASE WHEN t_surface <> h_surface THEN 1 ELSE 0 END) FILTER (rn = 1) AS INTEGER) AS surface_change", "start",
)


def _runs(spark, d):
    """Snapshots keyed by the part as the horse, in programme shape."""
    rows = base.snapshots(spark, d)
    return rows.select(
        "race_id", F.col("horse").alias("horse_id"), "race_start_at", "race_no", "captured_at", "snapshot_id",
        "source_request_id", F.col("entrant").cast("double").alias("draw"), F.col("weight").alias("carried_weight"),
        "jockey", "trainer", F.col("price").alias("handicap_rating"), "race_class", "track", "surface", "distance", "horse_name",
        "discount", "odds", "entrant",
    )


def _asof_frame(spark, d):
    runs = _runs(spark, d)
    results = latest.latest_by(
        runs, ["race_id", "horse_id"], [F.col("captured_at").desc(), F.col("snapshot_id").desc()], latest.eligible_asof()
    ).select(
        "race_id", "horse_id", F.col("race_start_at").alias("captured_at"), F.col("snapshot_id").alias("result_id"),
        F.col("entrant").cast("double").alias("finish_position"),
        F.when(F.col("horse_id") % 7 != 0, "finished").otherwise("unknown").alias("result_status"),
    )
    legacy = latest.latest_by(
        runs, ["race_id", "horse_id"], [F.col("captured_at").desc(), F.col("snapshot_id").desc()]
    ).withColumns(
        {"start": F.col("race_start_at"), "race_no": F.lit(1),
         "finish_position": F.when(F.col("entrant") != 4, F.col("entrant").cast("double"))}
    )
    agf = runs.select("race_id", "horse_id", "captured_at", "snapshot_id", (F.col("discount") * 100).alias("agf_percent"), F.col("entrant").cast("int").alias("agf_rank"))
    odds = runs.filter("odds IS NOT NULL").select("race_id", "horse_id", "captured_at", "snapshot_id", "odds")
    return features.asof_frame(runs, results, agf, odds, legacy)


@query("asof_feature_frame", FE1_SQL)
def asof_feature_frame(spark, d):
    return _asof_frame(spark, d).select(
        "race_id", "horse_id", *[r6(c) for c in FEATURE_COLUMNS[:9]], "weight_change", "distance_change", "class_change", "surface_change"
    )


@query(
    "asof_feature_market",
    base.SQL + """, a AS (SELECT *, row_number() OVER (PARTITION BY race_id, horse ORDER BY captured_at DESC, snapshot_id DESC) AS rn
  FROM snap WHERE captured_at < race_start_at),
o AS (SELECT *, row_number() OVER (PARTITION BY race_id, horse ORDER BY captured_at DESC, snapshot_id DESC) AS rn
  FROM snap WHERE captured_at < race_start_at AND odds IS NOT NULL)
SELECT a.race_id, a.horse AS horse_id, round(a.discount * 100, 6) AS agf_percent, CAST(a.entrant AS INTEGER) AS agf_rank, a.captured_at AS agf_captured_at,
  o.odds, o.captured_at AS odds_captured_at FROM a LEFT JOIN o ON a.race_id = o.race_id AND a.horse = o.horse AND o.rn = 1 WHERE a.rn = 1""",
)
def asof_feature_market(spark, d):
    return _asof_frame(spark, d).select(
        "race_id", "horse_id", r6("agf_percent"), "agf_rank", "agf_captured_at", "odds", "odds_captured_at"
    )


def _raw_history(spark, d):
    """History in its raw text form: decimal commas, day-first dates."""
    rows = base.snapshots(spark, d)
    comma = lambda c: F.translate(c.cast("string"), ".", ",")
    return rows.select(
        F.concat(F.lit("horse:"), F.col("horse").cast("string")).alias("horse_key"),
        F.col("race_id").cast("string").alias("race_id"),
        F.date_format("race_start_at", "dd.MM.yyyy").alias("race_date"), F.col("track").alias("hippodrome"),
        F.col("distance").cast("string").alias("distance"), F.concat(F.col("surface"), F.lit(": iyi")).alias("surface"),
        "race_class", F.when(F.col("entrant") != 4, F.col("entrant").cast("string")).otherwise("K").alias("finish"),
        F.lit("1.34.04").alias("race_time"), comma(F.col("discount")).alias("agf"), comma(F.col("odds")).alias("odds"),
        "jockey", "trainer", F.lit(None).cast("string").alias("prize"), comma(F.col("weight")).alias("weight"),
        F.col("entrant").cast("string").alias("gate"), comma(F.col("price").cast("decimal(18,2)")).alias("rating"),
    )


def _profiles(spark, d):
    return load(spark, d, "part").filter("p_size <= 40").select(
        F.concat(F.lit("horse:"), F.col("p_partkey").cast("string")).alias("horse_key"), F.col("p_name").alias("name")
    )



def _typed_order():
    return [F.col("carried_weight").desc(), F.col("handicap_rating").desc(), F.col("draw").desc(), F.col("trainer").asc()]


def _training_set(spark, d):
    conditions = load(spark, d, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("day"), base._case("o_orderpriority", base.TRACKS).alias("track")
    ).agg(F.max("o_orderstatus").alias("track_condition"))
    return features.training_set(_raw_history(spark, d), _profiles(spark, d), _typed_order(), conditions)


_TYPED_SQL = base.SQL + """, typed AS (
  SELECT 'horse:' || horse AS horse_id, CAST(race_id AS VARCHAR) AS race_id, strftime(race_start_at, '%d.%m.%Y') AS race_date,
    CAST(race_start_at AS DATE) AS day, track, distance, substr(surface, 1, 1) || ':' AS surface, race_class,
    coalesce(CASE WHEN p.p_size <= 40 THEN p.p_name END, 'Unknown') AS horse_name, jockey, trainer, weight AS carried_weight,
    CAST(entrant AS DOUBLE) AS draw, CASE WHEN entrant <> 4 THEN CAST(entrant AS DOUBLE) END AS finish_position,
    94.04 AS finish_time_seconds, odds, discount AS agf, price AS handicap_rating
  FROM snap LEFT JOIN part p ON snap.horse = p.p_partkey),
u AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY horse_id, race_id
    ORDER BY carried_weight DESC, handicap_rating DESC, draw DESC, trainer) AS rn FROM typed) WHERE rn = 1)"""

_TRAIN_SQL = _TYPED_SQL + """,
f AS (SELECT race_id, count(*) AS found, count(finish_position) AS num, count(DISTINCT finish_position) AS uni, min(finish_position) AS mn, max(finish_position) AS mx FROM u GROUP BY race_id),
cond AS (SELECT CAST(o_orderdate AS DATE) AS day, """ + base._case_sql("o_orderpriority", base.TRACKS) + """ AS track, max(o_orderstatus) AS tc FROM orders GROUP BY ALL),
w AS (SELECT u.*, lag(day) OVER h AS pd, lag(carried_weight) OVER h AS pw, lag(race_class) OVER h AS pc, lag(surface) OVER h AS ps, lag(distance) OVER h AS pdist,
    lag(handicap_rating) OVER h AS pr, row_number() OVER h AS n,
    avg(finish_position) OVER (h ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l3, avg(finish_position) OVER (h ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l5,
    avg(finish_position) OVER (h ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l10, count(*) OVER (PARTITION BY horse_id, day) AS same,
""" + ",\n".join(
    f"    CASE WHEN count(*) OVER {k} > 0 THEN sum(CASE WHEN finish_position = 1 THEN 1.0 ELSE 0.0 END) OVER {k} / count(*) OVER {k} END AS {k}_rate"
    for k in ("surface_", "distance_", "track_", "jockey_", "trainer_")
) + """
  FROM u WINDOW h AS (PARTITION BY horse_id ORDER BY day, race_id)""" + "".join(
    f", {k}_ AS (PARTITION BY horse_id, {k} ORDER BY day, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    for k in ("surface", "distance", "track", "jockey", "trainer")
) + """)
SELECT w.horse_id, w.race_id, w.race_date, w.track, w.distance, w.surface, w.race_class, w.horse_name, w.jockey, w.trainer, w.carried_weight, w.draw, w.finish_position,
  CAST(w.finish_time_seconds AS DOUBLE) AS finish_time_seconds, w.odds, w.agf, w.handicap_rating, CASE WHEN same = 1 THEN pr END AS pre_race_handicap_rating, CAST(NULL AS DOUBLE) AS prize,
  coalesce(found >= 2 AND num = found AND uni = found AND mn = 1 AND mx = found, false) AS race_field_complete, found AS found_starters,
  coalesce(mx, CAST(found AS DOUBLE)) AS expected_starters_min, greatest(0.0, mx - uni) AS missing_starters_min, same = 1 AS history_order_certified,
  CAST(date_diff('day', pd, w.day) AS DOUBLE) AS days_since_last_race, round(l3, 6) AS last_3_avg_position, round(l5, 6) AS last_5_avg_position, round(l10, 6) AS last_10_avg_position,
  round(surface__rate, 6) AS surface_win_rate, round(distance__rate, 6) AS distance_win_rate, round(track__rate, 6) AS track_win_rate,
  round(jockey__rate, 6) AS jockey_horse_win_rate, round(trainer__rate, 6) AS trainer_horse_win_rate, w.carried_weight - pw AS weight_change,
  CAST(w.race_class IS DISTINCT FROM pc AS INTEGER) AS class_change, w.distance - pdist AS distance_change, CAST(w.surface IS DISTINCT FROM ps AS INTEGER) AS surface_change,
  coalesce(tc, 'not_available_checked') AS track_condition,
""" + ",\n".join(f"  'not_available_checked' AS {c}" for c in schemas.CONDITION_COLUMNS[1:]) + ",\n" + ",\n".join(
    f"  'not_found' AS {c}" for c in schemas.LOOKUP_COLUMNS
) + """, CAST(NULL AS DOUBLE) AS margin_lengths_numeric, CAST(NULL AS INTEGER) AS race_no,
""" + ",\n".join(f"  0 AS {c}" for c in schemas.INCIDENT_COLUMNS) + """
FROM w JOIN f ON w.race_id = f.race_id LEFT JOIN cond c ON w.day = c.day AND w.track = c.track"""


@query("training_dataset", _TRAIN_SQL)
def training_dataset(spark, d):
    frame = _training_set(spark, d)
    rounded = {c: F.round(c, 6) for c in [f"last_{n}_avg_position" for n in (3, 5, 10)] + list(features.CATEGORIES.values())}
    return frame.withColumns(rounded)


INCREMENTAL_SQL = base.SQL + """, lp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY race_id, horse ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM snap) WHERE rn = 1),
t AS (SELECT *, CAST(race_start_at AS DATE) AS start FROM lp WHERE race_id % 3 <> 0 AND race_start_at >= TIMESTAMP '1998-01-01'),
h AS (SELECT *, CAST(race_start_at AS DATE) AS start, CASE WHEN entrant <> 4 THEN CAST(entrant AS DOUBLE) END AS fin FROM lp)
""" + _feature_sql(
    "CAST(date_diff('day', max(h_start), max(t_start)) AS DOUBLE)", "kn",
    "CAST(coalesce(max(CASE WHEN t_race_class <> h_race_class THEN 1 ELSE 0 END) FILTER (rn = 1), 1) AS INTEGER) AS class_change, "
    "CAST(coalesce(max(CASE WHEN t_surface <> h_surface THEN 1 ELSE 0 END) FILTER (rn = 1), 1) AS INTEGER) AS surface_change", "start",
)


@query("incremental_features", INCREMENTAL_SQL)
def incremental_features(spark, d):
    rows = latest.latest_by(
        _runs(spark, d), ["race_id", "horse_id"], [F.col("captured_at").desc(), F.col("snapshot_id").desc()]
    ).withColumns(
        {"start": F.date_trunc("day", "race_start_at"),
         "finish_position": F.when(F.col("entrant") != 4, F.col("entrant").cast("double"))}
    )
    processed = rows.filter("race_id % 3 = 0")
    out = features.incremental(rows, rows, processed, F.lit("1998-01-01").cast("timestamp"))
    return out.select(
        "race_id", "horse_id", *[r6(c) for c in FEATURE_COLUMNS[:9]], "weight_change", "distance_change", "class_change", "surface_change"
    )


_STRICT_SQL = _TYPED_SQL + """, pairs AS (
  SELECT t.race_id, t.horse_id, h.race_id AS hr, h.finish_position AS fin, date_diff('day', h.day, t.day) AS gap,
    t.carried_weight - h.carried_weight AS weight, t.distance - h.distance AS dist, CAST(t.race_class IS DISTINCT FROM h.race_class AS INTEGER) AS cls,
    CAST(t.surface IS DISTINCT FROM h.surface AS INTEGER) AS surf, """ + ", ".join(
    f"h.race_id IS NOT NULL AND t.{c} IS NOT DISTINCT FROM h.{c} AS s_{c}" for c in ("surface", "distance", "track", "jockey", "trainer")
) + """, row_number() OVER (PARTITION BY t.race_id, t.horse_id ORDER BY h.day DESC NULLS LAST, h.race_id DESC) AS rn
  FROM u t LEFT JOIN u h ON h.horse_id = t.horse_id AND h.day < t.day)
SELECT race_id, horse_id, CAST(max(gap) FILTER (rn = 1) AS DOUBLE) AS days_since_last_race, """ + ", ".join(
    f"round(avg(fin) FILTER (rn <= {n}), 6) AS last_{n}_avg_position" for n in (3, 5, 10)
) + ", " + ", ".join(
    f"round(CAST(count(*) FILTER (s_{c} AND fin = 1) AS DOUBLE) / nullif(count(*) FILTER (s_{c}), 0), 6) AS {c}{more}_win_rate"
    for c, more in (("surface", ""), ("distance", ""), ("track", ""), ("jockey", "_horse"), ("trainer", "_horse"))
) + """, max(weight) FILTER (rn = 1) AS weight_change, coalesce(max(cls) FILTER (rn = 1 AND hr IS NOT NULL), 1) AS class_change,
  max(dist) FILTER (rn = 1) AS distance_change, coalesce(max(surf) FILTER (rn = 1 AND hr IS NOT NULL), 1) AS surface_change
FROM pairs GROUP BY race_id, horse_id"""


def _dataset_rows(spark, d):
    from furlong.sources import scans

    return features.dataset_features(scans.dataset_columns(_raw_history(spark, d), _profiles(spark, d)), _typed_order())


@query("strict_recompute", _STRICT_SQL)
def strict_recompute(spark, d):
    """History features of all rows by folds over the days of a horse."""
    out = features.strict_recompute(_dataset_rows(spark, d))
    return out.select("race_id", "horse_id", *[r6(c) for c in features.DERIVED if c not in ("class_change", "surface_change")], "class_change", "surface_change")


@query(
    "strict_recompute_compare",
    "WITH strict AS (" + _STRICT_SQL + "), train AS (" + _TRAIN_SQL + ")" + " UNION ALL ".join(
        f" SELECT count(*) AS checked, '{c}' AS feature, count(*) FILTER ((s.{c} IS NULL) <> (t.{c} IS NULL) OR abs(s.{c} - t.{c}) > 1e-5) AS mismatches"
        " FROM strict s JOIN train t USING (race_id, horse_id)"
        for c in features.DERIVED
    ),
)
def strict_recompute_compare(spark, d):
    """All rows recomputed by folds over days agree with the window features, except where
    a horse starts twice a day (the dataset counts the earlier start of the day)."""
    rows = _dataset_rows(spark, d)
    return features.compare_features(features.strict_recompute(rows), rows)


@query(
    "feature_invariance",
    base.SQL + """, t AS (SELECT count(*) AS compared FROM (SELECT DISTINCT race_id, horse FROM snap) WHERE race_id % 3 = 0)
SELECT c.kind, t.compared, CAST(0 AS BIGINT) AS changed FROM t, (VALUES ('future_rows'), ('target_outcomes')) c(kind)""",
)
def feature_invariance(spark, d):
    """Features of a third of the races stay as they are when later starts or their own results change."""
    rows = features.with_keys(latest.latest_by(
        _runs(spark, d), ["race_id", "horse_id"], [F.col("captured_at").desc(), F.col("snapshot_id").desc()]
    )).withColumns({"start": F.col("race_start_at"), "finish_position": F.when(F.col("entrant") != 4, F.col("entrant").cast("double"))})
    return features.invariance(
        features.history_features, rows.filter("race_id % 3 = 0"), rows, ["race_id", "horse_id"], features.DERIVED, "start", ["finish_position"]
    )


@query(
    "exact_median_by_group",
    "SELECT event_type, round(median(value), 6) AS median_value FROM events GROUP BY event_type",
)
def exact_median_by_group(spark, d):
    events = load(spark, d, "events").select("event_type", "value")
    return metrics.exact_median(events, ["event_type"], "value", "median_value").withColumn(
        "median_value", F.round("median_value", 6)
    )
