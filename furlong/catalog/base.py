"""The given tables seen as race data, once as DataFrames and once as SQL.

orders are races, line items are captures of their entrants, parts are horses, suppliers are
trainers. Captures of one (order, line number) repeat, so they form snapshots; about half of
them lie after the order date and are therefore late.
"""

from __future__ import annotations

from contextlib import AbstractContextManager, nullcontext
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import latest, skew, windows
from furlong.session import load, written

TRACKS = {
    "1-URGENT": "İstanbul (3. Y.G.)",
    "2-HIGH": "Şirinyer",
    "3-MEDIUM": "Ankara",
    "4-NOT SPECIFIED": "Paris Longchamp",
    "5-LOW": "Şanlıurfa",
}
SURFACES = {"R": "Kum", "A": "Çim", "N": "Sentetik"}
CLASSES = {"F": "Maiden, İngiliz, 58 kg", "O": "Handikap 15, Arap", "P": "Şartlı 3"}


def _case(column: str, table: dict[str, str]) -> Column:
    expr = F.lit(None).cast("string")
    for key, value in reversed(table.items()):
        expr = F.when(F.col(column) == key, value).otherwise(expr)
    return expr


def _case_sql(column: str, table: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column}='{k}' THEN '{v}'" for k, v in table.items()) + " END"


#: Line items of fewer bytes are not bucketed; above, a bucket stands for BUCKET_BYTES of them at most.
MIN_BUCKETED_BYTES = 16 << 20
BUCKET_BYTES = 4 << 20
_BUCKETS: dict[str, int] = {}


def buckets(spark: SparkSession, d: str) -> int:
    """How many buckets the race tables of ``d`` have: in proportion to the input, so that a bucket
    stays small at any size. 0 (no buckets) where the input is small or a race too large for one task.

    Never fewer than the shuffle partitions, to which a join would raise a smaller number."""
    if d not in _BUCKETS:
        line = load(spark, d, "lineitem").select("l_orderkey")
        size = skew._input_bytes(load(spark, d, "lineitem")) or 0
        small = size < MIN_BUCKETED_BYTES or skew.find_hot(line, ["l_orderkey"]) is not None
        _BUCKETS[d] = 0 if small else max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    return _BUCKETS[d]


def race_cold(spark: SparkSession, d: str) -> AbstractContextManager:
    """For windows inside whose keys contain the race: in buckets no race is hot, so none looks for one."""
    return skew.cold(["race_id"]) if buckets(spark, d) else nullcontext()


def stored(build):
    """Write the table once per application, in buckets by race, and read it from there.

    All tables of one input have the same buckets, so one derived from another by race is written,
    joined and reduced without a shuffle."""

    @wraps(build)
    def get(spark: SparkSession, d: str) -> DataFrame:
        name = f"{build.__name__}/{d.strip('/').replace('/', '-')}"
        count = buckets(spark, d)

        def without_checks() -> DataFrame:
            with race_cold(spark, d):
                return build(spark, d)

        return written(spark, name, without_checks, "race_id", count)

    return get


@stored
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    line = load(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    part = load(spark, d, "part").select("p_partkey", "p_size")
    # part and orders grow with the data: their join strategy is left to AQE. Parts come first, so
    # that rows stay where the race puts them.
    line = line.join(part, line["l_partkey"] == part["p_partkey"], "left")
    if count := buckets(spark, d):
        line, orders = line.repartition(count, "l_orderkey"), orders.repartition(count, "o_orderkey")
    rows = line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
    supp = F.col("l_suppkey").cast("string")
    return rows.select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").cast("bigint").alias("entrant"),
        F.col("l_partkey").alias("horse"), F.col("l_shipdate").alias("captured_at"),
        F.col("o_orderdate").alias("race_start_at"),
        (F.col("l_orderkey") % 12 + 1).cast("int").alias("race_no"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        _case("o_orderpriority", TRACKS).alias("track"), _case("l_returnflag", SURFACES).alias("surface"),
        _case("o_orderstatus", CLASSES).alias("race_class"),
        (F.coalesce("p_size", F.lit(10)) * 20 + 1000).cast("double").alias("distance"),
        F.col("l_quantity").alias("weight"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.concat(F.lit("H"), F.col("l_partkey").cast("string")).alias("horse_name"),
        F.concat(F.lit("J"), (F.col("l_suppkey") % 50).cast("string")).alias("jockey"),
        F.concat(F.lit("T"), supp).alias("trainer"),
        (F.col("l_partkey") * 1_000_000_000 + F.col("l_suppkey") * 1000 + F.col("l_quantity").cast("bigint")).alias("snapshot_id"),
        F.concat(F.lit("req"), (F.col("l_suppkey") % 97).cast("string")).alias("source_request_id"),
        F.when(F.col("l_quantity") >= 3, 1 + F.floor(F.col("l_extendedprice") / 100) / 100.0).alias("odds"),
    )




def latest_order() -> list[Column]:
    return [F.col("captured_at").desc(), F.col("snapshot_id").desc()]


@stored
def program(spark: SparkSession, d: str) -> DataFrame:
    """Latest capture before the start per (race, entrant)."""
    return latest.latest_by(snapshots(spark, d), ["race_id", "entrant"], latest_order(), latest.eligible_asof())


@stored
def field(spark: SparkSession, d: str) -> DataFrame:
    """Programme rows with the finish, the field size and the scores."""
    rows = skew.ranked(program(spark, d), ["race_id"], ["tax", "discount", "entrant"], "finish")
    rows = rows.withColumn("edge", F.col("discount") + 0.01)
    rows = windows.normalise_in_group(
        rows, ["race_id"], {"price": "p1", "weight": "p2", "edge": "p3"}
    )
    return skew.group_totals(rows, ["race_id"], {"field_size": F.count(F.lit(1))})


def programs(spark: SparkSession, d: str) -> DataFrame:
    """All captures in programme shape, keyed by the entrant number."""
    return snapshots(spark, d).withColumn("horse_id", F.col("entrant"))


@stored
def results(spark: SparkSession, d: str) -> DataFrame:
    """One result per programme entrant; equal keys share a finish (dead heats)."""
    rows = program(spark, d).withColumn("_key", F.col("tax") * 1000 + F.col("discount"))
    ties = rows.groupBy("race_id", "_key").agg(F.count(F.lit(1)).alias("_n"))
    places = skew.running(ties, ["race_id"], ["_key"], {"_before": ("sum", F.col("_n"))})
    placed = rows.join(places.drop("_n"), ["race_id", "_key"])
    scratched = F.col("weight") == 50
    return placed.select(
        "race_id", F.col("entrant").alias("horse_id"), "race_start_at", "race_no",
        (F.col("race_start_at") + F.expr("INTERVAL 1 HOUR")).alias("captured_at"),
        F.col("entrant").alias("result_id"),
        F.when(~scratched, (F.col("_before") + 1).cast("double")).alias("finish_position"),
        F.when(scratched, "scratched").otherwise("finished").alias("result_status"),
        F.col("odds").alias("result_odds"), "source_request_id",
        F.date_format("race_start_at", "m.ss.SS").alias("finish_time"),
    )


@stored
def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Three runs per race: an old one, the valid one, and one after the start. Some entrants
    have no score of the first model."""
    rows = windows.normalise_in_group(
        program(spark, d).withColumn("edge", F.col("discount") + 0.01),
        ["race_id"], {"price": "p1", "weight": "p2", "edge": "p3"},
    )
    rows = skew.ranked(rows, ["race_id"], ["-discount", "entrant"], "_agf")
    runs = rows.withColumn("run", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    valid = F.col("run") == 2
    hours = F.when(F.col("run") == 1, -48).when(valid, -24).otherwise(1)
    return runs.select(
        F.concat_ws(":", F.col("run").cast("string"), F.col("race_id").cast("string"), F.col("entrant").cast("string")).alias("prediction_id"),
        "race_id", F.col("entrant").alias("horse_id"),
        F.timestamp_micros(F.unix_micros("race_start_at") + hours.cast("bigint") * 3_600_000_000).alias("prediction_time"),
        "race_start_at", F.lit("v1").alias("model_version"),
        F.when(F.col("weight") != 7, F.round(F.when(valid, F.col("p1")).otherwise(F.col("p2")), 9)).alias("logistic_probability"),
        F.round(F.when(valid, F.col("p2")).otherwise(F.col("p1")), 9).alias("catboost_probability"),
        F.round("p3", 9).alias("xgboost_probability"),
        F.round((F.col("p1") + F.col("p2") + F.col("p3")) / 3.0, 9).alias("ensemble_probability"),
        (F.col("discount") * 100).alias("agf_percent"),
        F.when(F.col("weight") >= 5, F.col("_agf").cast("int")).alias("agf_rank"), "odds",
        F.to_json(F.struct("distance", F.col("jockey").alias("jockey"), F.when(F.col("weight") >= 5, F.col("weight")).alias("weight")), {"ignoreNullFields": "false"}).alias("feature_values_json"),
        F.col("snapshot_id").alias("feature_snapshot_id"), "source_request_id",
    )


@stored
def prediction_results(spark: SparkSession, d: str) -> DataFrame:
    rows = program(spark, d).filter("race_id % 2 = 0 AND odds IS NOT NULL")
    return rows.select(
        "race_id", F.concat_ws(":", F.lit("2"), F.col("race_id").cast("string"), F.col("entrant").cast("string")).alias("prediction_id"),
        (F.col("odds") + 0.5).alias("official_odds"),
    )


def scores_long(spark: SparkSession, d: str) -> DataFrame:
    """Field rows long by score: race, entrant, model, probability, is_win, odds, day."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(c).alias("probability")) for m, c in (("a", "p1"), ("b", "p2"), ("c", "p3"))]
    )
    rows = field(spark, d).withColumn("_m", F.explode(pairs))
    return rows.select(
        "race_id", F.col("entrant").alias("horse_id"), F.col("race_start_at").cast("date").alias("race_date"),
        F.col("finish").alias("finish_position"), (F.col("finish") == 1).cast("int").alias("is_win"),
        "odds", "field_size", F.col("_m.model").alias("model"), F.col("_m.probability").alias("probability"),
    )


SQL = f"""
WITH snap AS (
  SELECT l_orderkey AS race_id, CAST(l_linenumber AS BIGINT) AS entrant, l_partkey AS horse,
    l_shipdate AS captured_at, o_orderdate AS race_start_at, CAST(l_orderkey % 12 + 1 AS INTEGER) AS race_no,
    o_orderpriority AS priority, o_orderstatus AS status,
    {_case_sql('o_orderpriority', TRACKS)} AS track, {_case_sql('l_returnflag', SURFACES)} AS surface,
    {_case_sql('o_orderstatus', CLASSES)} AS race_class,
    CAST(coalesce(p_size, 10) * 20 + 1000 AS DOUBLE) AS distance,
    l_quantity AS weight, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
    'H' || l_partkey AS horse_name, 'J' || (l_suppkey % 50) AS jockey, 'T' || l_suppkey AS trainer,
    l_partkey * 1000000000 + l_suppkey * 1000 + CAST(l_quantity AS BIGINT) AS snapshot_id,
    'req' || (l_suppkey % 97) AS source_request_id,
    CASE WHEN l_quantity >= 3 THEN 1 + floor(l_extendedprice / 100) / 100.0 END AS odds
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
),
prog AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY race_id, entrant ORDER BY captured_at DESC, snapshot_id DESC) AS rn
    FROM snap WHERE captured_at < race_start_at) WHERE rn = 1
),
allprog AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY race_id, entrant ORDER BY captured_at DESC, snapshot_id DESC) AS rn
    FROM snap) WHERE rn = 1
),
shares AS (
  SELECT *, discount + 0.01 AS edge, price / sum(price) OVER w AS p1, weight / sum(weight) OVER w AS p2,
    (discount + 0.01) / sum(discount + 0.01) OVER w AS p3, count(*) OVER w AS field_size,
    row_number() OVER (PARTITION BY race_id ORDER BY discount DESC, entrant) AS agf_no,
    row_number() OVER (PARTITION BY race_id ORDER BY tax, discount, entrant) AS finish
  FROM prog WINDOW w AS (PARTITION BY race_id)
),
res AS (
  SELECT race_id, entrant AS horse_id, race_start_at, race_no, race_start_at + INTERVAL 1 HOUR AS captured_at,
    CASE WHEN weight <> 50 THEN CAST(rank() OVER (PARTITION BY race_id ORDER BY tax * 1000 + discount) AS DOUBLE) END AS finish_position,
    CASE WHEN weight = 50 THEN 'scratched' ELSE 'finished' END AS result_status, odds AS result_odds
  FROM prog
),
runs AS (
  SELECT r.run || ':' || race_id || ':' || entrant AS prediction_id, r.run AS run, race_id, entrant AS horse_id,
    race_start_at + CASE r.run WHEN 1 THEN INTERVAL (-48) HOUR WHEN 2 THEN INTERVAL (-24) HOUR ELSE INTERVAL 1 HOUR END AS prediction_time,
    race_start_at, CASE WHEN weight <> 7 THEN round(CASE WHEN r.run = 2 THEN p1 ELSE p2 END, 9) END AS logistic, round(CASE WHEN r.run = 2 THEN p2 ELSE p1 END, 9) AS catboost,
    round(p3, 9) AS xgboost, round((p1 + p2 + p3) / 3.0, 9) AS ensemble, discount * 100 AS agf_percent,
    CASE WHEN weight >= 5 THEN CAST(agf_no AS INTEGER) END AS agf_rank, odds, weight, jockey, distance,
    snapshot_id, source_request_id
  FROM shares CROSS JOIN (VALUES (1), (2), (3)) AS r(run)
),
official AS (
  SELECT '2:' || race_id || ':' || entrant AS prediction_id, odds + 0.5 AS official_odds
  FROM prog WHERE race_id % 2 = 0 AND odds IS NOT NULL
),
long_scores AS (
  SELECT race_id, entrant AS horse_id, CAST(race_start_at AS DATE) AS race_date, finish AS finish_position,
    CASE WHEN finish = 1 THEN 1 ELSE 0 END AS is_win, odds, field_size, m.model,
    CASE m.model WHEN 'a' THEN p1 WHEN 'b' THEN p2 ELSE p3 END AS probability
  FROM shares CROSS JOIN (VALUES ('a'), ('b'), ('c')) AS m(model)
)
"""
