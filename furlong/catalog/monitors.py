"""Drift, data quality, provenance gates, coverage and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong import schemas
from furlong.catalog import base
from furlong.catalog.history import r6
from furlong.catalog.registry import query
from furlong.functions import dates, jsonx, text
from furlong.operators import filters, latest, quality, windows
from furlong.plans import coverage, drift, gates, lifecycle, ml
from furlong.session import load


def _events(spark, d):
    rows = load(spark, d, "events")
    return rows.select(
        "event_id", "ts", "user_id", "event_type", "value", F.col("ts").cast("date").alias("day"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


WIN = """WITH e AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
l AS (SELECT max(day) AS d FROM e),
w AS (SELECT e.*, CASE WHEN day = l.d THEN 'current' ELSE 'reference' END AS win FROM e, l WHERE day BETWEEN l.d - 30 AND l.d)
"""
DIST = """round(sum((c - r) * ln(c / r)), 6) AS psi, round(0.5 * sum(r * ln(r / ((r + c) / 2))) + 0.5 * sum(c * ln(c / ((r + c) / 2))), 6) AS js_distance, round(sum(c * ln(c / r)), 6) AS kl_divergence"""


@query("drift_window_split", WIN + "SELECT win AS window, count(*) AS n, max(l.d) AS as_of_date FROM w, l GROUP BY win")
def drift_window_split(spark, d):
    return drift.split_window(_events(spark, d), "day").groupBy("window").agg(
        F.count(F.lit(1)).alias("n"), F.max("as_of_date").alias("as_of_date")
    )


def _psi_sql(by: str) -> str:
    return f"""rg AS (SELECT {by}, min(value) AS lo, max(value) AS hi FROM w GROUP BY {by}),
b AS (SELECT w.{by}, least(9, CAST(len(list_filter([1,2,3,4,5,6,7,8,9], lambda i: lo + (hi - lo) / 10 * i <= value)) AS INTEGER)) AS bin, win FROM w JOIN rg ON w.{by} = rg.{by}),
g AS (SELECT rg.{by}, x.bin, (SELECT count(*) FROM b WHERE b.{by} = rg.{by} AND b.bin = x.bin AND win = 'reference') + 1e-9 AS rc, (SELECT count(*) FROM b WHERE b.{by} = rg.{by} AND b.bin = x.bin AND win = 'current') + 1e-9 AS cc FROM rg, range(0, 10) AS x(bin)),
s AS (SELECT {by}, rc / sum(rc) OVER (PARTITION BY {by}) AS r, cc / sum(cc) OVER (PARTITION BY {by}) AS c FROM g)
SELECT {by}, {DIST} FROM s GROUP BY {by}"""


@query("psi_numeric", WIN + ", " + _psi_sql("event_type"))
def psi_numeric(spark, d):
    rows = drift.split_window(_events(spark, d), "day")
    return _distances(drift.numeric(rows, ["event_type"], "value"))


def _distances(df):
    return df.withColumns({c: F.round(c, 6) for c in ("psi", "js_distance", "kl_divergence")})


@query(
    "psi_categorical",
    WIN + """, cc AS (SELECT event_type AS cat, count(*) FILTER (win = 'reference') AS rn, count(*) FILTER (win = 'current') AS cn FROM w GROUP BY event_type),
t AS (SELECT sum(rn) AS rt, sum(cn) AS ct FROM cc), s AS (SELECT rn / rt + 1e-9 AS r0, cn / ct + 1e-9 AS c0 FROM cc, t), z AS (SELECT r0 / sum(r0) OVER () AS r, c0 / sum(c0) OVER () AS c FROM s)
SELECT """ + DIST + ", CAST((SELECT sum(CASE WHEN rn = 0 THEN cn ELSE 0 END) / sum(cn) FROM cc) AS DOUBLE) AS unseen_category_rate FROM z",
)
def psi_categorical(spark, d):
    rows = drift.split_window(_events(spark, d), "day")
    return _distances(drift.categorical(rows, [], F.col("event_type")))


@query(
    "psi_categorical_shared",
    WIN + """, cc AS (SELECT user_id AS cat, count(*) FILTER (win = 'reference') AS rn, count(*) FILTER (win = 'current') AS cn FROM w WHERE NOT (win = 'reference' AND user_id % 5 = 0) GROUP BY user_id),
t AS (SELECT sum(rn) AS rt, sum(cn) AS ct FROM cc), s AS (SELECT rn / rt + 1e-9 AS r0, cn / ct + 1e-9 AS c0 FROM cc, t WHERE rn > 0 AND cn > 0), z AS (SELECT r0 / sum(r0) OVER () AS r, c0 / sum(c0) OVER () AS c FROM s)
SELECT """ + DIST + ", round((SELECT sum(CASE WHEN rn = 0 THEN cn ELSE 0 END) / sum(cn) FROM cc), 6) AS unseen_category_rate FROM z",
)
def psi_categorical_shared(spark, d):
    rows = drift.split_window(_events(spark, d), "day").filter("NOT (window = 'reference' AND user_id % 5 = 0)")
    out = _distances(drift.categorical(rows, [], F.col("user_id").cast("string"), intersect=F.lit(True)))
    return out.withColumn("unseen_category_rate", F.round("unseen_category_rate", 6))


@query(
    "feature_drift",
    WIN + """, m AS (SELECT feature, count(*) FILTER (win = 'current') AS current_rows, count(*) FILTER (win = 'reference') AS reference_rows, round(avg(v) FILTER (win = 'current'), 6) AS current_mean, round(avg(v) FILTER (win = 'reference'), 6) AS reference_mean,
  round(median(v) FILTER (win = 'current'), 6) AS current_median, round(median(v) FILTER (win = 'reference'), 6) AS reference_median, round(stddev_samp(v) FILTER (win = 'current'), 6) AS current_std, max(v) FILTER (win = 'reference') AS reference_max,
  round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) FILTER (win = 'current'), 6) AS current_missing_rate
  FROM (SELECT 'value' AS feature, value AS v, win FROM w UNION ALL SELECT 'k', CASE WHEN event_id % 9 <> 0 THEN k END, win FROM w) GROUP BY feature)
SELECT *, 'numeric' AS feature_type FROM m UNION ALL
SELECT 'event_type', count(*) FILTER (win = 'current'), count(*) FILTER (win = 'reference'), NULL, NULL, NULL, NULL, NULL, NULL, 0.0, 'categorical' FROM w""",
)
def feature_drift(spark, d):
    rows = _events(spark, d).withColumn("k", F.when(F.col("event_id") % 9 != 0, F.col("k")))
    out = drift.feature_report(rows, "day", ["value", "k"], ["event_type"])
    rounded = ["current_mean", "reference_mean", "current_median", "reference_median", "current_std", "current_missing_rate"]
    return out.select(
        "feature", "feature_type", "current_rows", "reference_rows", *[r6(c) for c in rounded], "reference_max"
    )


@query("feature_drift_status")
def feature_drift_status(spark, d):
    """Distances and alarm status of every feature, with the overall status."""
    report = drift.feature_report(_events(spark, d), "day", ["value", "k"], ["event_type"])
    overall = drift.overall_status(report).select(F.lit("overall").alias("feature"), "status")
    return report.select("feature", "psi", "js_distance", "kl_divergence", "unseen_category_rate", "missing_rate_delta", "status").unionByName(
        overall, allowMissingColumns=True
    )


def _race_events(spark, d):
    """Predictions by day for drift: one model per score column."""
    rows = base.scores_long(spark, d)
    return rows.withColumns(
        {"winner": F.col("is_win"), "race_class": F.when(F.col("field_size") > 2, "big").otherwise("small"),
         "result_status": F.when(F.col("horse_id") == 4, "scratched").otherwise("finished")}
    )


PD = base.SQL + """, l AS (SELECT max(race_date) AS d FROM long_scores),
w AS (SELECT s.*, CASE WHEN race_date = l.d THEN 'current' ELSE 'reference' END AS win FROM long_scores s, l WHERE race_date BETWEEN l.d - 30 AND l.d)
"""


@query(
    "prediction_drift",
    PD + """, t AS (SELECT model, win, race_id, max(probability) AS p FROM w GROUP BY ALL),
c AS (SELECT model, abs(avg(p) FILTER (win = 'current') - avg(p) FILTER (win = 'reference')) AS cs FROM t GROUP BY model)
SELECT w.model, count(*) FILTER (win = 'current') AS current_rows, count(*) FILTER (win = 'reference') AS reference_rows,
  round(abs(avg(probability) FILTER (win = 'current' AND is_win = 1) - avg(probability) FILTER (win = 'reference' AND is_win = 1)), 6) AS winner_probability_shift, round(max(cs), 6) AS confidence_shift FROM w JOIN c ON w.model = c.model GROUP BY w.model""",
)
def prediction_drift(spark, d):
    out = drift.prediction_report(_race_events(spark, d), "race_date")
    return out.select("model", "current_rows", "reference_rows", r6("winner_probability_shift"), r6("confidence_shift"))


@query("target_drift")
def target_drift(spark, d):
    return drift.target_report(_race_events(spark, d).filter("model = 'a'"), "race_date")


@query(
    "sliding_calendar_counts",
    """WITH t AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events)
SELECT t.event_id, t.user_id, count(*) FILTER (e.event_type = 'error' AND e.day >= t.day - 3) AS errors_3d, count(*) FILTER (e.event_type = 'view' AND e.day >= t.day - 10) AS views_10d
FROM t LEFT JOIN e ON e.user_id = t.user_id AND e.day < t.day AND e.day >= t.day - 10 GROUP BY t.event_id, t.user_id""",
)
def sliding_calendar_counts(spark, d):
    rows = _events(spark, d)
    targets = rows.filter("event_type = 'purchase'").select("event_id", "user_id", "day")
    out = windows.trailing_event_counts(
        targets, rows.select("user_id", F.col("day").alias("event_day"), "event_type"), ["user_id"], "day", "event_day",
        {"errors_3d": (3, F.col("event_type") == "error"), "views_10d": (10, F.col("event_type") == "view")},
    )
    return out.select("event_id", "user_id", "errors_3d", "views_10d")


@query("dup_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, d):
    return quality.duplicate_keys(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(
    "table_stats",
    base.SQL + """SELECT 'program' AS "table", CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT race_id) AS races, min(f) AS first_seen, max(l) AS last_seen, count(*) FILTER (n > 1) AS duplicate_captures
FROM (SELECT race_id, entrant, source_request_id, count(*) AS n, min(captured_at) AS f, max(captured_at) AS l FROM snap GROUP BY ALL)
UNION ALL SELECT 'odds', CAST(sum(n) AS BIGINT), count(DISTINCT race_id), min(f), max(l), count(*) FILTER (n > 1)
FROM (SELECT race_id, entrant, source_request_id, count(*) AS n, min(captured_at) AS f, max(captured_at) AS l FROM snap WHERE odds IS NOT NULL GROUP BY ALL)""",
)
def table_stats(spark, d):
    snaps = base.snapshots(spark, d).select("race_id", "entrant", "source_request_id", "captured_at", "odds")
    return quality.table_stats(
        {"program": snaps, "odds": snaps.filter("odds IS NOT NULL")}, ["source_request_id", "race_id", "entrant"]
    )


@query(
    "missing_fields",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '  ' ELSE c_name END AS c_name, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END AS c_nationkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'not_available' ELSE c_mktsegment END AS c_mktsegment FROM customer)
SELECT 'c_name' AS field, count(*) FILTER (trim(c_name) = '') AS missing, round(100.0 * count(*) FILTER (trim(c_name) = '') / count(*), 2) AS missing_pct FROM c
UNION ALL SELECT 'c_nationkey', count(*) FILTER (c_nationkey IS NULL), round(100.0 * count(*) FILTER (c_nationkey IS NULL) / count(*), 2) FROM c
UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment = 'not_available'), round(100.0 * count(*) FILTER (c_mktsegment = 'not_available') / count(*), 2) FROM c""",
)
def missing_fields(spark, d):
    rows = load(spark, d, "customer").select(
        F.when(F.col("c_custkey") % 4 == 0, "  ").otherwise(F.col("c_name")).alias("c_name"),
        F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "not_available").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    return quality.missing_report(rows, rows.columns, ["not_available"])


@query("missing_predicate", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY') OR c_nationkey IS NULL")
def missing_predicate(spark, d):
    rows = load(spark, d, "customer")
    return rows.filter(filters.is_missing(F.col("c_mktsegment"), ["MACHINERY"]) | filters.is_missing(F.col("c_nationkey"))).select("c_custkey")


def _late_predictions(spark, d):
    """Runs archived against any capture of their entrant, some of them too late."""
    snaps = base.snapshots(spark, d)
    return snaps.select(
        F.concat_ws(":", "race_id", "entrant", "snapshot_id").alias("prediction_id"), "race_id", F.col("entrant").alias("horse_id"),
        F.col("captured_at").alias("prediction_time"), "race_start_at", F.col("snapshot_id").alias("feature_snapshot_id"), "source_request_id",
    )


@query(
    "provenance_gate",
    base.SQL + """, p AS (SELECT race_id, entrant, captured_at, race_start_at, snapshot_id, source_request_id FROM snap), k AS (SELECT count(*) AS n FROM p GROUP BY source_request_id, race_id, entrant),
o AS (SELECT count(*) AS n FROM snap WHERE odds IS NOT NULL GROUP BY source_request_id, race_id, entrant), u AS (SELECT snapshot_id FROM allprog)
SELECT "check", violations, violations = 0 AS passed FROM (
SELECT 'no_post_start_predictions' AS "check", (SELECT count(*) FROM p WHERE captured_at >= race_start_at) AS violations
UNION ALL SELECT 'prediction_snapshot_before_start', (SELECT count(*) FROM p JOIN snap s ON s.snapshot_id = p.snapshot_id WHERE s.captured_at >= p.race_start_at)
UNION ALL SELECT 'single_final_run_per_race', (SELECT count(*) FROM (SELECT race_id FROM p WHERE captured_at >= race_start_at - INTERVAL 15 MINUTE AND captured_at < race_start_at GROUP BY race_id HAVING count(DISTINCT captured_at) > 1))
UNION ALL SELECT 'no_duplicate_program_captures', (SELECT count(*) FROM k WHERE n > 1) UNION ALL SELECT 'no_duplicate_agf_captures', (SELECT count(*) FROM k WHERE n > 1)
UNION ALL SELECT 'no_duplicate_odds_captures', (SELECT count(*) FROM o WHERE n > 1) UNION ALL SELECT 'no_duplicate_results_captures', 0)""",
)
def provenance_gate(spark, d):
    programs = base.programs(spark, d)
    return gates.provenance_gate(
        programs, programs, programs.filter("odds IS NOT NULL"), base.results(spark, d), _late_predictions(spark, d)
    )


@query(
    "provenance_mismatch",
    base.SQL + """, v AS (SELECT prediction_id, race_id, horse_id, race_start_at, CASE WHEN horse_id = 3 THEN snapshot_id + 1 ELSE snapshot_id END AS sid, CASE WHEN horse_id = 2 THEN 'other' ELSE source_request_id END AS req FROM runs WHERE run = 2)
SELECT v.prediction_id FROM v LEFT JOIN prog s ON s.snapshot_id = v.sid AND s.race_id = v.race_id AND s.entrant = v.horse_id
WHERE s.snapshot_id IS NULL OR s.source_request_id <> v.req""",
)
def provenance_mismatch(spark, d):
    """Snapshot ids repeat across races here, so the archived id carries its race."""
    tag = lambda df, sid: df.withColumn("feature_snapshot_id", F.concat_ws(":", "race_id", "horse_id", sid))
    run = base.predictions(spark, d).filter("prediction_id LIKE '2:%'").withColumns(
        {
            "_sid": F.when(F.col("horse_id") == 3, F.col("feature_snapshot_id") + 1).otherwise(F.col("feature_snapshot_id")),
            "source_request_id": F.when(F.col("horse_id") == 2, "other").otherwise(F.col("source_request_id")),
        }
    )
    programs = base.program(spark, d).withColumn("horse_id", F.col("entrant"))
    programs = tag(programs, "snapshot_id").withColumn("snapshot_id", F.col("feature_snapshot_id"))
    return gates.provenance_mismatches(tag(run, "_sid"), programs).select("prediction_id")


@query(
    "coverage_missed",
    base.SQL + """SELECT DISTINCT race_id FROM snap WHERE race_start_at >= TIMESTAMP '1996-01-01' AND race_start_at - INTERVAL 5 MINUTE <= TIMESTAMP '2000-01-01' AND track NOT LIKE 'Paris%' AND race_id NOT IN (SELECT race_id FROM runs)""",
)
def coverage_missed(spark, d):
    at = lambda s: F.lit(s).cast("timestamp")
    return gates.missed_races(base.programs(spark, d), base.predictions(spark, d), at("1996-01-01"), at("2000-01-01"))


#: Model features that the archived rows carry; the others are unknown.
_ARCHIVED = {"track": "track", "race_class": "race_class", "distance": "CAST(distance AS BIGINT)", "draw": "entrant", "surface": "surface"}
_ARCHIVE_FEATURES = ",".join(
    f'"{c}":' + (
        f"' || {_ARCHIVED[c]} || '" if c in ("distance", "draw") else f"\"' || {_ARCHIVED[c]} || '\"" if c in _ARCHIVED else "null"
    )
    for c in sorted(schemas.MODEL_FEATURES)
)


@query(
    "prediction_archive",
    base.SQL + f""", m AS (SELECT * EXCLUDE (rn) FROM (SELECT p.race_id, p.entrant, s.discount, s.odds,
    row_number() OVER (PARTITION BY p.race_id, p.entrant ORDER BY s.captured_at DESC, s.snapshot_id DESC) AS rn
  FROM prog p JOIN snap s ON s.race_id = p.race_id AND s.entrant = p.entrant AND s.captured_at <= p.race_start_at - INTERVAL 1 DAY) WHERE rn = 1),
a AS (SELECT prog.*, m.discount AS md, m.odds AS mo, '{{{_ARCHIVE_FEATURES}}}' AS payload FROM prog LEFT JOIN m USING (race_id, entrant))
SELECT 'run:' || race_id || ':' || entrant AS prediction_id, race_id, entrant AS horse_id, race_start_at - INTERVAL 1 DAY AS prediction_time,
  payload AS feature_values_json, sha256('{{"feature_contract_version":"{schemas.CONTRACT_VERSION}","features":' || payload || ',"race_start_at":"' || CAST(race_start_at AS VARCHAR)
    || '","snapshot_id":' || snapshot_id || ',"source_request_id":"' || source_request_id || '"}}') AS feature_hash,
  snapshot_id AS feature_snapshot_id, coalesce(CASE WHEN entrant <> 3 THEN md END, 0.5) AS agf_percent,
  CAST(CASE WHEN md IS NULL THEN 9 ELSE entrant END AS INTEGER) AS agf_rank, mo AS odds
FROM a""",
)
def prediction_archive(spark, d):
    """Predictions a day before each start; some races have no market by then, entrant 3 has no share."""
    known = {name: F.expr(sql) for name, sql in _ARCHIVED.items()}
    scored = base.program(spark, d).withColumn("horse_id", F.col("entrant")).withColumns(
        {**{c: known.get(c, F.lit(None).cast("double")) for c in schemas.MODEL_FEATURES}, "predicted_rank": F.lit(1),
         "ensemble_probability": F.lit(0.5), "agf_percent": F.lit(0.5), "agf_rank": F.lit(9), "odds": F.lit(None).cast("double")}
    )
    feed = base.snapshots(spark, d).select(
        "race_id", F.col("entrant").alias("horse_id"), "captured_at", "snapshot_id", "odds",
        F.when(F.col("entrant") != 3, F.col("discount")).alias("agf_percent"), F.col("entrant").cast("int").alias("agf_rank"),
    )
    out = ml.archive(scored, F.col("race_start_at") - F.expr("INTERVAL 1 DAY"), "run", feed, feed, "v1", "p1")
    return out.select(
        "prediction_id", "race_id", "horse_id", "prediction_time", "feature_values_json", "feature_hash", "feature_snapshot_id", "agf_percent", "agf_rank", "odds"
    )


@query(
    "coverage_gate",
    base.SQL + """, v AS (SELECT prediction_id, race_id, horse_id, race_start_at, prediction_time, CASE WHEN horse_id = 3 THEN snapshot_id + 1 ELSE snapshot_id END AS sid, CASE WHEN horse_id = 2 THEN 'other' ELSE source_request_id END AS req FROM runs WHERE run >= 2),
c AS (SELECT (SELECT count(*) FROM v WHERE prediction_time >= race_start_at) AS late_predictions,
(SELECT count(*) FROM v LEFT JOIN prog s ON s.snapshot_id = v.sid AND s.race_id = v.race_id AND s.entrant = v.horse_id WHERE s.snapshot_id IS NULL OR s.source_request_id <> v.req) AS provenance_mismatches,
(SELECT count(*) FROM v WHERE horse_id = 5) AS hash_mismatches,
(SELECT count(DISTINCT race_id) FROM prog WHERE race_start_at >= TIMESTAMP '1996-01-01' AND race_start_at - INTERVAL 5 MINUTE <= TIMESTAMP '2000-01-01' AND track NOT LIKE 'Paris%' AND race_id NOT IN (SELECT race_id FROM v)) AS missed_races)
SELECT *, late_predictions + provenance_mismatches + hash_mismatches + missed_races = 0 AS snapshot_coverage_pass FROM c""",
)
def coverage_gate(spark, d):
    """Some archived ids are wrong, entrant 5's hashes are of other values, and one run is late."""
    at = lambda s: F.lit(s).cast("timestamp")
    tag = lambda df, sid: df.withColumn("_tag", F.concat_ws(":", "race_id", "horse_id", sid))
    make = lambda: jsonx.feature_hash(["agf_percent", "odds"], "feature_snapshot_id", "source_request_id", "race_start_at", "v2")
    runs = base.predictions(spark, d).filter("prediction_id NOT LIKE '1:%'").withColumns(
        {
            "feature_snapshot_id": F.when(F.col("horse_id") == 3, F.col("feature_snapshot_id") + 1).otherwise(F.col("feature_snapshot_id")),
            "source_request_id": F.when(F.col("horse_id") == 2, "other").otherwise(F.col("source_request_id")),
        }
    )
    runs = tag(runs, "feature_snapshot_id").drop("feature_snapshot_id").withColumnRenamed("_tag", "feature_snapshot_id")
    runs = runs.withColumn("feature_hash", make()).withColumn(
        "agf_percent", F.when(F.col("horse_id") == 5, F.col("agf_percent") + 1).otherwise(F.col("agf_percent"))
    )
    programs = tag(base.program(spark, d).withColumn("horse_id", F.col("entrant")), "snapshot_id").drop("snapshot_id")
    programs = programs.withColumnRenamed("_tag", "snapshot_id")
    return gates.coverage_gate(programs, runs, make(), at("1996-01-01"), at("2000-01-01"))


@query(
    "append_only_audit",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'deleted' ELSE 'updated' END AS violation FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0",
)
def append_only_audit(spark, d):
    before = load(spark, d, "orders")
    after = before.filter("o_orderkey % 11 <> 0").withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    )
    return gates.append_only_violations(before, after, ["o_orderkey"])


@query("feature_hash_verify", base.SQL + "SELECT prediction_id FROM runs WHERE run = 2 AND horse_id = 5")
def feature_hash_verify(spark, d):
    """Stored hashes of entrant 5 were made from other values; exactly those must fail."""
    run = base.predictions(spark, d).filter("prediction_id LIKE '2:%'")
    make = lambda: jsonx.feature_hash(["agf_percent", "odds"], "feature_snapshot_id", "source_request_id", "race_start_at", "v2")
    stored = run.withColumn("feature_hash", make())
    forged = stored.withColumn("agf_percent", F.when(F.col("horse_id") == 5, F.col("agf_percent") + 1).otherwise(F.col("agf_percent")))
    return gates.hash_mismatches(forged, make()).select("prediction_id")


@query(
    "provenance_matrix",
    """SELECT 'c_acctbal' AS feature, false AS model_used, 'NOT_MODEL_FEATURE_UNVERIFIED' AS verdict, count(c_acctbal) AS non_null FROM customer UNION ALL SELECT 'track', true, 'CONDITIONAL', count(c_mktsegment) FROM customer
UNION ALL SELECT 'odds', false, 'EXCLUDED_POST_RACE_OR_UNPROVEN', count(c_acctbal) FILTER (c_acctbal > 0) FROM customer""",
)
def provenance_matrix(spark, d):
    rows = load(spark, d, "customer").select(
        "c_acctbal", F.col("c_mktsegment").alias("track"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("odds")
    )
    return gates.provenance_matrix(rows).select("feature", "model_used", "verdict", "non_null")


@query(
    "recency_checks",
    base.SQL + "SELECT count(*) AS rows, count(*) FILTER (captured_at >= race_start_at) AS late_rows, max(captured_at) AS last_capture, round((epoch_us(TIMESTAMP '2002-01-01') - epoch_us(max(captured_at))) / 60000000.0, 4) AS age_minutes FROM snap",
)
def recency_checks(spark, d):
    out = gates.recency(base.snapshots(spark, d), "captured_at", "race_start_at", F.lit("2002-01-01").cast("timestamp"))
    return out.withColumn("age_minutes", F.round("age_minutes", 4))


@query(
    "warnings_list",
    """SELECT o_orderkey AS id, array_to_string(list_distinct_keep([CASE WHEN o_totalprice > 300000 THEN 'HIGH' END, CASE WHEN o_orderstatus = 'P' THEN 'OPEN' END]), '|') AS warnings FROM orders""".replace(
        "list_distinct_keep(", "list_filter("
    ).replace("END])", "END], lambda x: x IS NOT NULL)"),
)
def warnings_list(spark, d):
    rows = load(spark, d, "orders")
    checks = [
        (F.col("o_totalprice") > 300000, "HIGH"), (F.col("o_totalprice") > 400000, "HIGH"), (F.col("o_orderstatus") == "P", "OPEN"),
    ]
    return rows.select(F.col("o_orderkey").alias("id"), F.array_join(gates.warning_list(checks), "|").alias("warnings"))


@query(
    "readiness_rollup",
    """WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderdate + to_seconds(o_orderkey) AS run_at, o_orderstatus <> 'P' AS leak, o_totalprice > 50000 AS con, o_orderkey % 3 <> 0 AS cov FROM orders), x AS (SELECT * FROM r ORDER BY run_at DESC LIMIT 1)
SELECT run_at, (SELECT count(DISTINCT day) FROM r) AS shadow_days, (SELECT max(ts) FROM events) AS last_prediction_at, array_to_string(list_filter([CASE WHEN NOT leak THEN 'LEAKAGE_GATE' END, CASE WHEN NOT con THEN 'FEATURE_CONTRACT' END, CASE WHEN NOT cov THEN 'SNAPSHOT_COVERAGE' END], lambda v: v IS NOT NULL), '|') AS attention_reasons,
  CASE WHEN leak AND con AND cov THEN 'healthy' ELSE 'attention' END AS system_status FROM x""",
)
def readiness_rollup(spark, d):
    runs = load(spark, d, "orders").select(
        F.col("o_orderdate").cast("date").alias("shadow_date"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey") * 1_000_000).alias("run_at"),
        (F.col("o_orderstatus") != "P").alias("leakage_gate_pass"), (F.col("o_totalprice") > 50000).alias("feature_contract_pass"),
        (F.col("o_orderkey") % 3 != 0).alias("snapshot_coverage_pass"), F.lit(True).alias("production_ready"),
    )
    out = gates.readiness(runs, load(spark, d, "events").withColumnRenamed("ts", "prediction_time"))
    return out.select(
        "run_at", "shadow_days", "last_prediction_at", F.array_join("attention_reasons", "|").alias("attention_reasons"), "system_status"
    )


@query(
    "run_status",
    """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, bool_and(o_totalprice > 1000) AS hard, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p FROM orders GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY day) AS sd FROM d)
SELECT day, CASE WHEN NOT hard OR (p >= 3 AND sd >= 30) THEN 'FAIL' WHEN sd < 30 OR n < 3 THEN 'SHADOW_WARMUP' ELSE 'PASS' END AS pipeline_status, sd >= 90 AND hard AND p < 3 AND n >= 3 AS production_ready FROM k""",
)
def run_status(spark, d):
    from furlong.operators import skew

    per_day = load(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_totalprice") > 1000).alias("hard"), F.count_if(F.col("o_orderstatus") == "P").alias("p")
    )
    rows = skew.ranked(per_day, [], ["day"], "shadow_days").withColumns(
        {
            "leakage_gate_pass": F.col("hard"), "feature_contract_pass": F.lit(True), "snapshot_coverage_pass": F.lit(True),
            "prediction_drift": F.when(F.col("p") >= 3, "CRITICAL").otherwise("PASS"),
            "calibration": F.when(F.col("n") < 3, "INSUFFICIENT_DATA").otherwise("PASS"), "feature_drift": F.lit("PASS"),
            "healthy_days": F.col("shadow_days"),
        }
    )
    return gates.run_status(rows).select("day", "pipeline_status", "production_ready")


def _resolved_programs(spark, d):
    """All entrants with an id (missing for every ninth horse)."""
    rows = latest.latest_by(base.snapshots(spark, d), ["race_id", "entrant"], base.latest_order())
    return rows.select(
        "race_id", F.col("horse").cast("string").alias("horse_id"), "entrant", "horse_name", "race_no", "race_start_at", "track", "jockey", "trainer",
        F.when(F.col("horse") % 9 != 0, F.concat(F.lit("R"), F.col("horse").cast("string"))).alias("registry_id"),
    )


@base.stored
def _coverage_horses(spark, d):
    """Odd races have results; history covers two thirds of the horses; some have errors."""
    programs = _resolved_programs(spark, d)
    results = base.results(spark, d).filter("race_id % 2 = 1")
    snaps = base.snapshots(spark, d).filter("horse % 3 <> 0")
    history = snaps.select(
        F.concat(F.lit("horse:"), F.col("horse").cast("string")).alias("horse_key"), dates.local_day("race_start_at").alias("day"),
        F.when(F.col("entrant") != 4, F.col("entrant").cast("string")).otherwise("not_available").alias("finish"),
    )
    errors = snaps.filter("horse % 10 = 1").select(
        F.concat(F.lit("registry:R"), F.col("horse").cast("string")).alias("entity_key"), dates.local_day("race_start_at").alias("day"),
        F.col("snapshot_id").alias("error_id"), F.lit("ApiError").alias("error_type"),
        F.when(F.col("horse") % 20 == 1, "database locked").otherwise("timeout").alias("message"),
    )
    return coverage.horse_reasons(programs, results, history, errors).select(
        "race_id", "entrant", "race_no", "race_start_at", "day", "track", "track_policy", "result_fetched", "missing_reason"
    )


COV = base.SQL + """, pr AS (SELECT race_id, entrant, horse, horse_name, race_no, race_start_at, CAST(race_start_at + INTERVAL 3 HOUR AS DATE) AS day, CASE WHEN horse % 9 <> 0 THEN 'R' || horse END AS rid,
    CASE WHEN track LIKE 'İstanbul%' THEN 'İstanbul' WHEN track = 'Şirinyer' THEN 'İzmir' ELSE track END AS track FROM allprog),
won AS (SELECT DISTINCT race_id FROM res WHERE finish_position = 1 AND result_status = 'finished' AND race_id % 2 = 1),
hi AS (SELECT horse, CAST(race_start_at + INTERVAL 3 HOUR AS DATE) AS day, count(*) AS n, bool_or(entrant <> 4) AS p FROM snap WHERE horse % 3 <> 0 GROUP BY ALL),
rc AS (SELECT horse, day, count(DISTINCT race_id) AS k FROM pr GROUP BY ALL),
hr AS (SELECT pr.*, won.race_id IS NOT NULL AS fetched, CASE WHEN track LIKE 'Paris%' THEN 'unsupported' WHEN track IN ('İstanbul', 'İzmir') THEN 'mandatory' ELSE 'supported' END AS policy, hi.n, hi.p, rc.k,
  CASE WHEN won.race_id IS NOT NULL THEN 'RESULT_CAPTURED' WHEN track LIKE 'Paris%' THEN 'SOURCE_UNSUPPORTED' WHEN rid IS NULL THEN 'ID_MISSING' WHEN hi.n IS NOT NULL AND pr.horse % 20 = 1 THEN 'DB_WRITE_ERROR' WHEN hi.n IS NOT NULL AND pr.horse % 10 = 1 THEN 'API_ERROR'
    WHEN NOT coalesce(p, false) THEN 'PROVIDER_RESULT_NOT_PUBLISHED' WHEN rc.k > 1 OR hi.n > 1 THEN 'AMBIGUOUS_PROGRAM_MATCH' ELSE 'DATA_MISSING' END AS reason
  FROM pr LEFT JOIN won ON pr.race_id = won.race_id LEFT JOIN hi ON hi.horse = pr.horse AND hi.day = pr.day LEFT JOIN rc ON rc.horse = pr.horse AND rc.day = pr.day),
ra AS (SELECT race_id, max(day) AS day, max(track) AS track, max(policy) AS policy, max(race_no) AS race_no, count(*) AS horse_count, bool_or(fetched) AS fetched, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, list(DISTINCT reason) AS rl,
    count(*) FILTER (reason = 'ID_MISSING') AS idm, count(*) FILTER (reason = 'PROVIDER_RESULT_NOT_PUBLISHED') AS np FROM hr GROUP BY race_id)
"""


@query("horse_missing_reasons", COV + "SELECT race_id, entrant, reason AS missing_reason, policy AS track_policy FROM hr")
def horse_missing_reasons(spark, d):
    return _coverage_horses(spark, d).select("race_id", "entrant", "missing_reason", "track_policy")


@query(
    "results_coverage",
    COV + """SELECT race_id, day, track, policy AS track_policy, horse_count, fetched AS result_fetched, reasons AS missing_reason, idm AS id_missing_horse_count, np AS source_not_published_count,
  CASE WHEN fetched THEN 'RESULT_CAPTURED' WHEN list_contains(rl, 'SOURCE_UNSUPPORTED') THEN 'SOURCE_UNSUPPORTED' WHEN list_contains(rl, 'ID_MISSING') THEN 'ID_MISSING' WHEN list_contains(rl, 'DB_WRITE_ERROR') THEN 'DB_WRITE_ERROR'
   WHEN list_contains(rl, 'API_ERROR') THEN 'API_ERROR' WHEN list_contains(rl, 'AMBIGUOUS_PROGRAM_MATCH') THEN 'AMBIGUOUS_PROGRAM_MATCH' WHEN list_contains(rl, 'PROVIDER_RESULT_NOT_PUBLISHED') THEN 'PROVIDER_RESULT_NOT_PUBLISHED' ELSE 'DATA_MISSING' END AS status FROM ra""",
)
def results_coverage(spark, d):
    return coverage.race_coverage(_coverage_horses(spark, d)).drop("race_no", "race_start_at")


@query(
    "coverage_tracks",
    COV + """, x AS (SELECT day, track, u.r AS r FROM ra, unnest(rl) AS u(r) WHERE NOT fetched)
SELECT ra.day, ra.track, max(policy) AS track_policy, count(*) AS program_races, count(*) FILTER (fetched) AS result_races, count(*) FILTER (NOT fetched) AS missing_races,
  coalesce((SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM x WHERE x.day = ra.day AND x.track = ra.track), 'NONE') AS missing_reason, CAST(sum(CASE WHEN NOT fetched THEN idm ELSE 0 END) AS BIGINT) AS id_missing_horse_count,
  CAST(sum(CASE WHEN NOT fetched THEN np ELSE 0 END) AS BIGINT) AS source_not_published_count FROM ra GROUP BY ra.day, ra.track""",
)
def coverage_tracks(spark, d):
    return coverage.track_coverage(coverage.race_coverage(_coverage_horses(spark, d)))


@query("coverage_warnings", COV + "SELECT day, track, CASE max(policy) WHEN 'mandatory' THEN 'mandatory_track_missing' WHEN 'unsupported' THEN 'unsupported_track_pending' ELSE 'track_missing' END AS warning, count(*) FILTER (NOT fetched) AS missing_races FROM ra GROUP BY day, track HAVING count(*) FILTER (NOT fetched) > 0")
def coverage_warnings(spark, d):
    tracks = coverage.track_coverage(coverage.race_coverage(_coverage_horses(spark, d)))
    return coverage.warnings(tracks).drop("missing_reason")


@query("live_status", COV + "SELECT day, track, count(*) AS races, count(*) FILTER (fetched) AS completed, bool_and(fetched) AS track_completed, coalesce(string_agg(DISTINCT race_no, ',' ORDER BY race_no) FILTER (NOT fetched), '') AS missing_race_nos FROM ra GROUP BY day, track")
def live_status(spark, d):
    out = coverage.live_status(coverage.race_coverage(_coverage_horses(spark, d)))
    return out.withColumn("missing_race_nos", F.array_join(F.transform("missing_race_nos", lambda x: x.cast("string")), ","))


@base.stored
def _race_day(spark, d):
    races = coverage.race_coverage(_coverage_horses(spark, d))
    results = base.results(spark, d).filter("race_id % 2 = 1")
    life = races.filter("race_id % 5 = 0").select(
        "race_id", F.lit("FINAL_CAPTURED").alias("state"), F.col("race_start_at").alias("updated_at"),
        F.col("race_start_at").alias("final_prediction_done_at"), F.lit(None).cast("timestamp").alias("agf_snapshot_done_at"),
        F.lit(None).cast("timestamp").alias("odds_snapshot_done_at"),
    )
    return coverage.race_day(
        races, base.programs(spark, d), base.predictions(spark, d), results, base.prediction_results(spark, d), life
    )


RD = COV + """, pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY prediction_time DESC, ensemble DESC, horse_id) AS rn FROM runs WHERE prediction_time < race_start_at) WHERE rn = 1),
wn AS (SELECT race_id, list(horse_id) AS ids, map_from_entries(list((horse_id, result_odds))) AS od FROM res WHERE result_status = 'finished' AND finish_position = 1 AND race_id % 2 = 1 GROUP BY race_id),
rd AS (SELECT ra.*, pick.horse_id AS top1, pick.prediction_id IS NOT NULL AS has_pick, wn.ids IS NOT NULL AS has_win, CASE WHEN wn.ids IS NOT NULL THEN coalesce(list_contains(wn.ids, pick.horse_id), false) END AS correct, wn.od[pick.horse_id] AS odds,
   o.prediction_id IS NOT NULL AS matched FROM ra LEFT JOIN pick ON pick.race_id = ra.race_id LEFT JOIN wn ON wn.race_id = ra.race_id LEFT JOIN official o ON o.prediction_id = pick.prediction_id)
"""


@query(
    "raceday_status",
    RD + """SELECT race_id, top1 AS top1_horse_id, has_pick AS prediction_available, CAST(correct AS INTEGER) AS correct, matched AS prediction_result_matched, has_pick AND has_win AND policy <> 'unsupported' AS evaluatable,
  CASE WHEN fetched AND NOT has_pick THEN 'NO_PREDICTION' WHEN fetched THEN 'RESULT_CAPTURED' WHEN policy = 'unsupported' THEN 'SOURCE_UNSUPPORTED' WHEN reasons = 'ID_MISSING' THEN 'ID_MISSING' WHEN NOT has_pick THEN 'NO_PREDICTION' ELSE 'RESULT_PENDING' END AS result_status,
  round(CASE WHEN correct AND odds IS NOT NULL THEN odds - 1 WHEN NOT correct THEN -1.0 END, 4) AS net_return,
  CASE WHEN race_id % 5 = 0 THEN 'FINAL_CAPTURED' WHEN policy = 'unsupported' THEN 'SOURCE_UNSUPPORTED' ELSE 'WAITING' END AS freeze_status FROM rd""",
)
def raceday_status(spark, d):
    return _race_day(spark, d).select(
        "race_id", "top1_horse_id", "prediction_available", F.col("correct").cast("int").alias("correct"), "prediction_result_matched", "evaluatable", "result_status",
        F.round("net_return", 4).alias("net_return"), "freeze_status",
    )


@query("raceday_summary", RD + "SELECT day, count(DISTINCT track) AS track_count, count(*) AS program_races, count(*) FILTER (has_pick) AS prediction_races, count(*) FILTER (fetched) AS result_races, count(*) FILTER (has_pick AND has_win AND policy <> 'unsupported') AS evaluated_races, count(*) FILTER (NOT fetched) AS missing_result_races FROM rd GROUP BY day")
def raceday_summary(spark, d):
    return coverage.race_day_summary(_race_day(spark, d))


@query("raceday_tracks", RD + "SELECT day, track, max(policy) AS track_policy, count(*) AS program_races, count(*) FILTER (has_pick) AS prediction_races, count(*) FILTER (fetched) AS result_races, count(*) FILTER (has_pick AND has_win AND policy <> 'unsupported') AS evaluated_races, count(*) FILTER (NOT fetched) AS missing_result_races FROM rd GROUP BY day, track")
def raceday_tracks(spark, d):
    return coverage.race_day_tracks(_race_day(spark, d))


@query(
    "raceday_performance",
    RD + """, e AS (SELECT *, CASE WHEN correct AND odds IS NOT NULL THEN odds - 1 WHEN NOT correct THEN -1.0 END AS net FROM rd WHERE has_pick AND has_win AND policy <> 'unsupported')
SELECT day, count(*) AS evaluated_races, count(*) FILTER (correct) AS correct_races, round(100.0 * count(*) FILTER (correct) / count(*), 6) AS accuracy_percent, round(coalesce(100.0 * sum(net) / nullif(count(net), 0), 0), 6) AS roi_percent, round(coalesce(sum(net), 0), 4) AS net_profit FROM e GROUP BY day""",
)
def raceday_performance(spark, d):
    out = coverage.race_day_performance(_race_day(spark, d))
    return out.withColumns({"accuracy_percent": F.round("accuracy_percent", 6), "roi_percent": F.round("roi_percent", 6), "net_profit": F.round("net_profit", 4)})


@query(
    "missing_field_rows",
    COV + """SELECT race_id, entrant, CASE WHEN rid IS NULL THEN 'ID_MISSING' ELSE 'DATA_MISSING' END AS missing_reason, array_to_string(list_filter([CASE WHEN rid IS NULL THEN 'registry_id' END, CASE WHEN entrant = 6 THEN 'jockey' END], lambda x: x IS NOT NULL), ',') AS missing_fields
FROM pr WHERE rid IS NULL OR entrant = 6""",
)
def missing_field_rows(spark, d):
    rows = _resolved_programs(spark, d).withColumn("jockey", F.when(F.col("entrant") != 6, F.col("jockey")).otherwise(" "))
    out = coverage.missing_field_rows(rows, ["horse_name", "jockey", "trainer"])
    return out.select("race_id", "entrant", "missing_reason", F.array_join("missing_fields", ",").alias("missing_fields"))


@query(
    "current_predictions",
    base.SQL + "SELECT race_id, horse_id, 'H' || s.horse AS horse_name, round(sum(ensemble) OVER (PARTITION BY r.race_id), 6) AS probability_sum, abs(sum(ensemble) OVER (PARTITION BY r.race_id) - 1) <= 1e-6 AS probability_sum_valid FROM runs r JOIN (SELECT race_id AS q, entrant, horse FROM allprog) s ON s.q = r.race_id AND s.entrant = r.horse_id WHERE run = 3",
)
def current_predictions(spark, d):
    out = coverage.current_predictions(base.predictions(spark, d), base.programs(spark, d))
    return out.select("race_id", "horse_id", "horse_name", r6("probability_sum"), "probability_sum_valid")


@query(
    "today_races",
    base.SQL + """, m AS (SELECT race_id, max(captured_at) AS last_agf_at FROM snap WHERE odds IS NOT NULL GROUP BY race_id)
SELECT p.race_id, race_no, track, count(*) AS horse_count, count(*) FILTER (captured_at < race_start_at) AS covered, round(100.0 * count(*) FILTER (captured_at < race_start_at) / count(*), 1) AS snapshot_coverage, max(m.last_agf_at) AS last_agf_at
FROM allprog p LEFT JOIN m ON m.race_id = p.race_id GROUP BY p.race_id, race_no, track""",
)
def today_races(spark, d):
    programs = base.programs(spark, d)
    return coverage.today_races(programs, programs.filter("odds IS NOT NULL")).drop("race_start_at")


@query(
    "lifecycle_state",
    base.SQL + """, r AS (SELECT race_id, max(race_start_at) AS start, max(track) AS track FROM allprog GROUP BY race_id),
n AS (SELECT r.*, start - to_minutes(race_id % 61 - 10) AS now, race_id % 3 = 0 AS fin, race_id % 7 = 0 AS res FROM r), a AS (SELECT *, epoch(start) - epoch(now) AS ahead FROM n)
SELECT race_id, CASE WHEN track LIKE 'Paris%' THEN 'SOURCE_UNSUPPORTED' WHEN res THEN 'RESULT_CAPTURED' WHEN fin AND ahead <= 0 THEN 'RESULT_PENDING' WHEN fin THEN 'FINAL_CAPTURED' WHEN ahead <= -120 THEN 'FAILED' WHEN ahead <= 0 THEN 'POST_START_RETRY'
  WHEN ahead <= 120 THEN 'FINAL_CAPTURING' WHEN ahead <= 900 THEN 'CAPTURING' WHEN ahead <= 1800 THEN 'PRE_WINDOW' ELSE 'WAITING' END AS state FROM a""",
)
def lifecycle_state(spark, d):
    races = quality.race_rollup(base.programs(spark, d))
    now = F.timestamp_micros(F.unix_micros("race_start_at") - (F.col("race_id") % 61 - 10) * 60_000_000)
    rows = races.withColumn("now", now)
    state = lifecycle.state(
        F.col("now"), F.col("race_start_at"), F.col("race_id") % 3 == 0, F.col("race_id") % 7 == 0, text.is_domestic_track("track")
    )
    return rows.select("race_id", state.alias("state"))


@query(
    "lifecycle_counts",
    base.SQL + """, r AS (SELECT race_id FROM allprog GROUP BY race_id), s AS (SELECT race_id % 4 AS k FROM r)
SELECT CASE k WHEN 0 THEN 'WAITING' WHEN 1 THEN 'FINAL_REFRESH_DUE' WHEN 2 THEN 'MISSED_FINAL_WINDOW' ELSE 'OTHER' END AS status, count(*) AS count FROM s GROUP BY 1""",
)
def lifecycle_counts(spark, d):
    from furlong.functions.bands import legacy_status
    from furlong.plans.shadow import lifecycle_counts as counts

    state = F.element_at(F.array(*[F.lit(s) for s in ("PRE_WINDOW", "CAPTURING", "FAILED", "OTHER")]), (F.col("race_id") % 4 + 1).cast("int"))
    rows = base.programs(spark, d).select("race_id").distinct().withColumn("status", legacy_status(state))
    return counts(rows)


@query(
    "lifecycle_facts",
    base.SQL + """, r AS (SELECT race_id, max(race_start_at) AS s FROM allprog GROUP BY race_id), pf AS (SELECT race_id, race_start_at - to_minutes(race_id % 30) AS pt, race_start_at AS st FROM (SELECT DISTINCT race_id, race_start_at FROM prog)),
f AS (SELECT race_id, max(pt) AS fp FROM pf WHERE pt >= st - INTERVAL 15 MINUTE AND pt < st GROUP BY race_id), b AS (SELECT r.race_id, f.fp, coalesce(f.fp, r.s) AS lim FROM r LEFT JOIN f ON f.race_id = r.race_id)
SELECT b.race_id, b.fp AS final_prediction_at, b.fp IS NOT NULL AS has_final, b.race_id IN (SELECT race_id FROM res WHERE finish_position = 1 AND result_status = 'finished') AS has_result,
  (SELECT max(captured_at) FROM snap WHERE snap.race_id = b.race_id AND captured_at <= b.lim) AS agf_at, (SELECT max(captured_at) FROM snap WHERE snap.race_id = b.race_id AND captured_at <= b.lim AND odds IS NOT NULL) AS odds_at FROM b""",
)
def lifecycle_facts(spark, d):
    programs = base.programs(spark, d)
    races = quality.race_rollup(programs).select("race_id", "race_start_at")
    preds = base.program(spark, d).select("race_id", "race_start_at").distinct().withColumn(
        "prediction_time", F.timestamp_micros(F.unix_micros("race_start_at") - (F.col("race_id") % 30) * 60_000_000)
    )
    out = lifecycle.facts(races, preds, base.results(spark, d), programs, programs.filter("odds IS NOT NULL"))
    return out.select("race_id", "final_prediction_at", "has_final", "has_result", "agf_at", "odds_at")


@query(
    "refresh_due",
    """WITH r AS (SELECT event_id AS race_id, ts AS start, ts - to_minutes(event_id % 40) AS last FROM events), n AS (SELECT TIMESTAMP '2024-01-15 09:00:00' AS now),
a AS (SELECT r.*, now, (epoch_us(start) - epoch_us(now)) / 60000000.0 AS ms FROM r, n WHERE start > now AND CAST(start + INTERVAL 3 HOUR AS DATE) = CAST(now + INTERVAL 3 HOUR AS DATE)),
c AS (SELECT *, CASE WHEN ms <= 10 THEN 1 WHEN ms <= 30 THEN 2 WHEN ms <= 60 THEN 5 ELSE 15 END AS cad, last <= now AND last < start AS ok, (SELECT min(start) FROM a WHERE ms <= 10) AS near FROM a)
SELECT race_id, CASE WHEN near IS NOT NULL THEN 'urgent_10m_60s' ELSE 'tiered_due' END AS mode FROM c WHERE (NOT ok OR (epoch_us(now) - epoch_us(last)) / 60000000.0 >= cad) AND (near IS NULL OR start = near)""",
)
def refresh_due(spark, d):
    rows = load(spark, d, "events").select(
        F.col("event_id").alias("race_id"), F.col("ts").alias("race_start_at"),
        F.timestamp_micros(F.unix_micros("ts") - (F.col("event_id") % 40) * 60_000_000).alias("last_agf_at"),
    )
    return lifecycle.refresh_due(rows, F.lit("2024-01-15 09:00:00").cast("timestamp")).select("race_id", "mode")
