"""Sinks and streaming: every query writes, reads back and reports what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import base, reports
from furlong.catalog.registry import query
from furlong.operators import latest
from furlong.plans import evaluated, shadow
from furlong.session import load, shared_dir
from furlong.sinks import tables
from furlong.streaming import ingest, lifecycle


def _path(spark, d, name):
    """A fresh folder for one run of one query."""
    import uuid

    return f"{shared_dir(spark)}/flows/{name}-{uuid.uuid4().hex}"


def _orders(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


@query(
    "upsert_latest",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders",
)
def upsert_latest(spark, d):
    path = _path(spark, d, "upsert")
    rows = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    tables.upsert(rows, path, ["o_orderkey"])
    tables.upsert(rows.filter("o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, ["o_orderkey"])
    return tables.read(spark, path)


@query("insert_ignore", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def insert_ignore(spark, d):
    path = _path(spark, d, "ignore")
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey")
    order = [F.col("o_orderkey").asc()]
    tables.insert_ignore(rows, path, ["o_custkey"], order)
    tables.insert_ignore(rows.withColumn("o_orderkey", F.col("o_orderkey") + 1), path, ["o_custkey"], order)
    return tables.read(spark, path)


@query(
    "coalesce_upsert",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS plain, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS keep_new, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'new' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'old' END AS keep_first FROM orders""",
)
def coalesce_upsert(spark, d):
    path = _path(spark, d, "coalesce")
    k = F.col("o_orderkey")
    old = load(spark, d, "orders").select(
        "o_orderkey", F.lit("old").alias("plain"), F.lit("old").alias("keep_new"), F.when(k % 3 != 0, "old").alias("keep_first")
    )
    new = load(spark, d, "orders").filter("o_orderkey % 2 = 0").select(
        "o_orderkey", F.lit("new").alias("plain"), F.when(k % 4 == 0, "new").alias("keep_new"), F.lit("new").alias("keep_first")
    )
    tables.coalesce_upsert(old, path, ["o_orderkey"], ["keep_new"], ["keep_first"])
    tables.coalesce_upsert(new, path, ["o_orderkey"], ["keep_new"], ["keep_first"])
    return tables.read(spark, path)


@query(
    "replace_by_key",
    "SELECT k, max(v) AS v FROM (SELECT o_custkey AS k, o_orderkey AS v FROM orders UNION ALL SELECT c_custkey, c_custkey + 1000000 FROM customer WHERE c_custkey % 2 = 0) GROUP BY k",
)
def replace_by_key(spark, d):
    old = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    new = load(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") + 1000000).alias("v"))
    path = _path(spark, d, "replace")
    for batch in (old, new):
        tables.replace_by_key(batch, path, ["k"], [F.col("v").desc()])
    return tables.read(spark, path)


@query("partition_replace", "SELECT o_orderpriority AS p, o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END AS price FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0)")
def partition_replace(spark, d):
    path = _path(spark, d, "partition")
    rows = load(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), "o_orderkey", F.col("o_totalprice").alias("price"))
    tables.replace_partitions(rows, path, "p")
    tables.replace_partitions(rows.filter("p = '5-LOW' AND o_orderkey % 2 = 1").withColumn("price", F.lit(0.0)), path, "p")
    return spark.read.parquet(path).withColumn("p", F.col("p").cast("string"))


@query("view_rebuild", "SELECT CAST(0 AS BIGINT) AS rows_before_first, count(*) AS rows_after, count(*) AS rows_before_second FROM orders")
def view_rebuild(spark, d):
    path = _path(spark, d, "rebuild")
    rows = _orders(spark, d)
    first = tables.rebuild(rows, path)
    second = tables.rebuild(rows, path)
    counted = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows_after"))
    return counted.select(
        F.lit(first["rows_before"]).cast("bigint").alias("rows_before_first"), "rows_after", F.lit(second["rows_before"]).cast("bigint").alias("rows_before_second")
    )


@query("materialised_view", reports.PERF_SUMMARY_SQL)
def materialised_view(spark, d):
    """The evaluation table written in full; the summary then reads it."""
    path = _path(spark, d, "evaluated")
    live = evaluated.evaluated(
        base.predictions(spark, d), base.results(spark, d), base.programs(spark, d), base.prediction_results(spark, d)
    )
    tables.rebuild(live, path)
    return reports._rounded(evaluated.summary(evaluated.source(tables.read_or_none(spark, path), live)))


@query(
    "table_sync_counts",
    "SELECT 'orders' AS \"table\", count(*) FILTER (o_orderkey % 3 = 0) AS inserted FROM orders UNION ALL SELECT 'customer', count(*) FILTER (c_custkey % 2 = 0) FROM customer",
)
def table_sync_counts(spark, d):
    orders, customer = load(spark, d, "orders"), load(spark, d, "customer")
    _, counts = tables.sync_missing(
        {"orders": orders, "customer": customer},
        {"orders": orders.filter("o_orderkey % 3 <> 0"), "customer": customer.filter("c_custkey % 2 <> 0")},
        {"orders": ["o_orderkey"], "customer": ["c_custkey"]},
    )
    return counts


@query("export_roundtrip", "SELECT k.copy, count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_keys, 4 AS columns FROM orders CROSS JOIN (VALUES ('csv'), ('parquet')) AS k(copy) GROUP BY k.copy")
def export_roundtrip(spark, d):
    path = _path(spark, d, "export")
    rows = _orders(spark, d)
    tables.export(rows, path)
    return tables.check_export(spark, path, ["o_orderkey"], "o_orderdate", [1996, 1997])


@query("daily_and_latest", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def daily_and_latest(spark, d):
    path = _path(spark, d, "daily")
    report = load(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("month"), F.col("o_orderdate").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    tables.write_daily_and_latest(report, path, "month")
    return spark.read.parquet(f"{path}/latest").select("day", "n")


@query("archive_filter", "SELECT count(*) AS n FROM orders")
def archive_filter(spark, d):
    """Appending an archive twice adds each row once."""
    path = _path(spark, d, "archive")
    for _ in range(2):
        tables.insert_ignore(_orders(spark, d), path, ["o_orderkey"])
    return tables.read(spark, path).agg(F.count(F.lit(1)).alias("n"))


# --- streaming ---------------------------------------------------------------------------


@query("stream_dedup_ingest", "SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL")
def stream_dedup_ingest(spark, d):
    """First capture per (user, hour, type) within the watermark."""
    stream = ingest.read_table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    kept = ingest.deduplicated(stream, ["user_id", "hour", "event_type"], "ts")
    path = _path(spark, d, "dedup")
    rows = ingest.drain(kept, f"{path}/data", f"{path}/checkpoint")
    return rows.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("kinds"))


@query(
    "stream_latest_state",
    "SELECT user_id, max(ts) FILTER (hour(ts) < 18) AS captured, arg_max(value, ts) FILTER (hour(ts) < 18) AS value, count(*) FILTER (hour(ts) >= 18) AS late_rows FROM events GROUP BY user_id",
)
def stream_latest_state(spark, d):
    """Latest value before 18:00 per user; later rows are kept only as a count. State lives as long as
    the day's watermark; the changes go into a table in parts by day."""
    stream = ingest.read_table(spark, d, "events").withColumn("start", F.date_trunc("day", "ts") + F.expr("INTERVAL 18 HOUR"))
    flagged = ingest.with_late_flag(stream, "ts", "start")
    state = ingest.latest_state(flagged, ["user_id"], "ts", ["value"])
    path = _path(spark, d, "state")
    days = ingest.drain(state, f"{path}/data", f"{path}/checkpoint", "update", ["user_id", "span_start"], F.date_format("span_start", "yyyy-MM-dd"))
    return days.groupBy("user_id").agg(F.max("ts").alias("captured"), F.max_by("value", "ts").alias("value"), F.sum("late_rows").alias("late_rows"))


@query(
    "stream_match",
    "SELECT p.event_id, r.event_id AS result_id FROM events p JOIN events r ON p.user_id = r.user_id AND p.event_type = 'view' AND r.event_type = 'purchase' AND r.ts > p.ts AND r.ts <= p.ts + INTERVAL 2 HOUR",
)
def stream_match(spark, d):
    both = ingest.read_table(spark, d, "events")
    predictions = both.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    results = ingest.read_table(spark, d, "events").filter("event_type = 'purchase'").select(
        F.col("event_id").alias("result_id"), "user_id", F.col("ts").alias("result_ts")
    )
    joined = ingest.matched(predictions, results, "user_id", "ts", "result_ts", within="2 hours")
    path = _path(spark, d, "match")
    return ingest.drain(joined.select("event_id", "result_id"), f"{path}/data", f"{path}/checkpoint")


@query(
    "stream_window_accuracy",
    "SELECT date_trunc('day', ts) AS window_start, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM events GROUP BY 1",
)
def stream_window_accuracy(spark, d):
    stream = ingest.read_table(spark, d, "events").withColumn("hit", F.col("event_type") == "purchase")
    out = ingest.windowed_accuracy(stream, "ts", "hit", "1 day")
    path = _path(spark, d, "window")
    month = F.date_format("window_start", "yyyy-MM")
    return ingest.drain(out, f"{path}/data", f"{path}/checkpoint", "update", ["window_start"], month).select("window_start", "n", "hits")


@query(
    "stream_sliding_accuracy",
    """WITH w AS (SELECT unnest(range(7)) AS k), x AS (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS s, event_type FROM events, w) SELECT s AS window_start, count(*) AS n, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM x GROUP BY 1""",
)
def stream_sliding_accuracy(spark, d):
    stream = ingest.read_table(spark, d, "events").withColumn("hit", F.col("event_type") == "purchase")
    out = ingest.windowed_accuracy(stream, "ts", "hit", "7 days", "1 day")
    path = _path(spark, d, "sliding")
    month = F.date_format("window_start", "yyyy-MM")
    return ingest.drain(out, f"{path}/data", f"{path}/checkpoint", "update", ["window_start"], month).select("window_start", "n", "hits")


@query("stream_incremental_materialise", "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_incremental_materialise(spark, d):
    """Every batch rebuilds the rows of the users it touches from the appended log."""
    path = _path(spark, d, "incremental")
    stream = ingest.read_table(spark, d, "events").select("event_id", "user_id", "value")

    def build(batch):
        # The log is laid out by user, so a batch reads the parts of its users only.
        log = tables.KeyedTable(batch.sparkSession, f"{path}/log", ["event_id"], F.pmod(F.xxhash64("user_id"), F.lit(tables.PARTS)))
        log.insert_ignore(batch)
        mine = log.rows_of(log.touched(batch)).join(batch.select("user_id").distinct(), "user_id", "left_semi")
        return mine.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))

    ingest.rebuild_batches(stream, f"{path}/table", build, ["user_id"], f"{path}/checkpoint")
    return tables.read(spark, f"{path}/table")


LIFECYCLE_SQL = """
WITH e AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS race_id, date_trunc('day', ts) + INTERVAL 12 HOUR AS start, user_id % 50 <> 0 AS supported,
  CASE event_type WHEN 'view' THEN 'prediction' WHEN 'purchase' THEN 'result' ELSE 'seen' END AS kind, date_trunc('millisecond', ts) AS moment FROM events),
r AS (SELECT race_id, start, supported, min(moment) AS begun FROM e GROUP BY ALL),
t AS (SELECT race_id, start, supported, moment AS t FROM e UNION
  SELECT race_id, start, supported, start + to_seconds(m) FROM r, (VALUES (-1800), (-900), (-120), (0), (120)) AS marks(m) WHERE start + to_seconds(m) > begun),
f AS (SELECT t.race_id, t.start, t.supported, t.t, bool_or(kind = 'prediction' AND moment >= t.start - INTERVAL 15 MINUTE AND moment < t.start) AS final, bool_or(kind = 'result') AS result
  FROM t JOIN e ON e.race_id = t.race_id AND e.moment <= t.t GROUP BY ALL),
s AS (SELECT race_id, t, CASE WHEN NOT supported THEN 'SOURCE_UNSUPPORTED' WHEN result THEN 'RESULT_CAPTURED' WHEN final AND t >= start THEN 'RESULT_PENDING' WHEN final THEN 'FINAL_CAPTURED'
  WHEN t >= start + INTERVAL 2 MINUTE THEN 'FAILED' WHEN t >= start THEN 'POST_START_RETRY' WHEN t >= start - INTERVAL 2 MINUTE THEN 'FINAL_CAPTURING'
  WHEN t >= start - INTERVAL 15 MINUTE THEN 'CAPTURING' WHEN t >= start - INTERVAL 30 MINUTE THEN 'PRE_WINDOW' ELSE 'WAITING' END AS state FROM f
  WHERE t <= (SELECT max(moment) - INTERVAL 1 MINUTE FROM e))
SELECT race_id, state, t AS "at" FROM (SELECT *, lag(state) OVER (PARTITION BY race_id ORDER BY t) AS before FROM s) WHERE state IS DISTINCT FROM before"""


@query("stream_lifecycle", LIFECYCLE_SQL)
def stream_lifecycle(spark, d):
    """State changes per user-day race from seen, prediction and result events."""
    start = F.date_trunc("day", "ts") + F.expr("INTERVAL 12 HOUR")
    kind = F.when(F.col("event_type") == "view", "prediction").when(F.col("event_type") == "purchase", "result").otherwise("seen")
    events = ingest.read_table(spark, d, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("race_id"),
        start.alias("race_start_at"), kind.alias("kind"), F.col("ts").alias("at"), (F.col("user_id") % 50 != 0).alias("supported"),
    )
    path = _path(spark, d, "lifecycle")
    return ingest.drain(lifecycle.transitions(events), f"{path}/data", f"{path}/checkpoint")


@query(
    "latest_monitor_run",
    "SELECT event_id, ts AS run_at FROM events ORDER BY ts DESC LIMIT 1",
)
def latest_monitor_run(spark, d):
    return shadow.latest_monitoring_run(load(spark, d, "events").select("event_id", F.col("ts").alias("run_at")))


@query("extreme_rows", "SELECT o_orderpriority AS track, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY 1")
def extreme_rows(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderpriority").alias("track"), F.col("o_orderkey").alias("best"), "o_totalprice")
    return latest.extreme_row(rows, ["track"], [F.col("o_totalprice").desc(), F.col("best").asc()]).select("track", "best")
