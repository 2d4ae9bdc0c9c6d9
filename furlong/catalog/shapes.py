"""Scalar functions, set operations, reshaping, aggregations and small joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import base
from furlong.catalog.registry import query
from furlong.functions import bands, dates, jsonx, numbers, text
from furlong.operators import quality, sets
from furlong.plans import features
from furlong.session import load


@query(
    "text_keys",
    """SELECT p_partkey AS id, upper(p_name) AS folded, upper(regexp_replace(p_name, '[^A-Za-z ]', '', 'g')) AS cleaned, lower(replace(p_name, ' ', '')) AS person, upper(regexp_replace(p_name || '-' || p_brand, '[^A-Za-z0-9]+', ' ', 'g')) AS ascii_text,
  upper(p_name) AS stored, upper(p_name) AS bare, CASE WHEN p_size % 2 = 0 THEN 'ISTANBUL' ELSE 'SANLIURFA' END AS track_key FROM part""",
)
def text_keys(spark, d):
    accented = F.translate("p_name", "aiou", "âîôü")
    track = F.when(F.col("p_size") % 2 == 0, "veliefendi hipodromu (3. Y.G.)").otherwise("Şanlıurfa (12. Yarış Günü)")
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("id"), text.fold(accented).alias("folded"), text.clean_name("p_name").alias("cleaned"),
        text.person_key("p_name").alias("person"), text.ascii_key(F.concat_ws("-", "p_name", "p_brand")).alias("ascii_text"),
        text.horse_name(F.concat("p_name", F.lit("  (8) "))).alias("stored"), text.name_key(F.concat("p_name", F.lit(" KG DB"))).alias("bare"),
        text.track_key(track).alias("track_key"),
    )


@query(
    "category_normalise",
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'maiden' WHEN 1 THEN 'handikap 15/dhow' ELSE '__MISSING__' END AS race_class, CASE p_partkey % 3 WHEN 0 THEN 'k:' WHEN 1 THEN 'ç:' ELSE '__MISSING__' END AS surface, lower(p_name) AS name FROM part""",
)
def category_normalise(spark, d):
    m = F.col("p_partkey") % 3
    cls = F.when(m == 0, "MAİDEN, 58 kg, E.I.D. 1.30, 1400 Çim").when(m == 1, "Handikap  15 / DHÖW, 1400")
    surface = F.when(m == 0, "KUM : ağır").when(m == 1, "Çim")
    return load(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.translate(text.normalise_category(cls, "race_class"), "ö", "o").alias("race_class"),
        text.normalise_category(surface, "surface").alias("surface"), text.normalise_category(F.upper("p_name")).alias("name"),
    )


@query(
    "bands",
    """SELECT l_orderkey AS race_id, l_linenumber AS no, CASE WHEN l_discount = 0 THEN 'no odds' WHEN l_discount * 100 < 2 THEN '<2' WHEN l_discount * 100 < 4 THEN '2-3.99' WHEN l_discount * 100 < 8 THEN '4-7.99' ELSE '8+' END AS odds_band,
  CASE WHEN l_linenumber = 1 THEN '1' WHEN l_linenumber <= 3 THEN '2-3' WHEN l_linenumber <= 6 THEN '4-6' ELSE '7+' END AS market_band, CASE WHEN l_quantity * 50 <= 1200 THEN '<=1200' WHEN l_quantity * 50 <= 1600 THEN '1300-1600' WHEN l_quantity * 50 <= 2000 THEN '1700-2000' ELSE '2000+' END AS distance_group,
  CASE WHEN l_quantity <= 6 THEN '<=6' WHEN l_quantity <= 10 THEN '7-10' WHEN l_quantity <= 14 THEN '11-14' ELSE '15+' END AS field_group FROM lineitem""",
)
def band_labels(spark, d):
    odds = F.when(F.col("l_discount") != 0, F.col("l_discount") * 100)
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_linenumber").alias("no"), bands.odds_band(odds).alias("odds_band"),
        bands.market_band(F.col("l_linenumber")).alias("market_band"), bands.distance_group(F.col("l_quantity") * 50).alias("distance_group"),
        bands.field_size_group(F.col("l_quantity")).alias("field_group"),
    )


@query(
    "parse_numbers_dates",
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS dotted, CAST(o_orderdate AS DATE) AS packed, o_totalprice AS comma, o_totalprice AS grouped, CAST(floor(o_totalprice) AS INTEGER) AS whole, CAST(o_orderkey % 90 AS DOUBLE) AS percent,
  CAST(o_orderkey % 20 AS INTEGER) AS rank, CAST(1000 + o_orderkey % 1000 AS DOUBLE) AS distance, CAST(o_orderkey % 9 + 1 AS INTEGER) AS race_no, CAST(60.0 + (o_orderkey % 60) + 0.25 AS DOUBLE) AS seconds,
  CAST(o_orderdate AS DATE) + to_minutes(17 * 60 + CAST(o_orderkey % 60 AS BIGINT)) - INTERVAL 3 HOUR AS start_utc FROM orders WHERE o_orderdate >= TIMESTAMP '1900-01-01'""".replace(
        "CAST(o_orderdate AS DATE) + to_minutes(17 * 60 + CAST(o_orderkey % 60 AS BIGINT)) - INTERVAL 3 HOUR AS start_utc",
        "TIMESTAMP '2026-01-10 00:00:00' + to_minutes(14 * 60 + CAST(o_orderkey % 60 AS BIGINT)) AS start_utc",
    ),
)
def parse_numbers_dates(spark, d):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    s = lambda c: c.cast("string")
    label = F.concat(s(key % 9 + 1), F.lit(". Koşu 17."), F.lpad(s(key % 60), 2, "0"))
    return load(spark, d, "orders").select(
        key.alias("id"), dates.parse_date(F.date_format(day, "yyyy-MM-dd")).alias("iso"), dates.parse_date(F.date_format(day, "dd.MM.yyyy")).alias("dotted"),
        dates.parse_date(F.date_format(day, "yyyyMMdd")).alias("packed"), numbers.decimal_comma(F.translate(s(price), ".", ",")).alias("comma"),
        numbers.grouped_number(F.concat(F.translate(F.format_number(price, 2), ",.", ".,"), F.lit(" TL"))).alias("grouped"),
        numbers.whole_number(F.translate(s(price), ".", ",")).alias("whole"),
        numbers.crowd_percent(F.concat(F.lit("%"), s(key % 90), F.lit("("), s(key % 20), F.lit(")"))).alias("percent"),
        numbers.crowd_rank(F.concat(F.lit("%"), s(key % 90), F.lit("("), s(key % 20), F.lit(")"))).alias("rank"),
        numbers.title_distance(F.concat(F.lit("3 Yaşlı 58 kg, "), s(1000 + key % 1000), F.lit(" Çim"))).alias("distance"),
        numbers.race_number(label).alias("race_no"),
        F.round(dates.race_seconds(F.concat(F.lit("1."), s(key % 60), F.lit(".25"))), 2).alias("seconds"),
        dates.start_from_label(F.lit("2026-01-10").cast("date"), label).alias("start_utc"),
    )


@query(
    "seasons_weeks",
    """SELECT o_orderkey AS id, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) <= 5 THEN 'spring' WHEN month(o_orderdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season,
  strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' || strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS week FROM orders""",
)
def seasons_weeks(spark, d):
    return load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), dates.season("o_orderdate").alias("season"), dates.week_label("o_orderdate").alias("week")
    )


@query(
    "number_guards",
    """SELECT l_orderkey AS id, l_linenumber AS no, least(greatest(l_discount * 10, 0.1), 0.6) AS clipped, nullif(l_tax, 0) AS nonzero, abs(l_extendedprice / l_quantity - round(l_extendedprice / l_quantity, 2)) <= 1e-3 AS near FROM lineitem""",
)
def number_guards(spark, d):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("no"), numbers.clip(F.col("l_discount") * 10, 0.1, 0.6).alias("clipped"),
        F.when(numbers.finite(F.col("l_tax")) & (F.col("l_tax") != 0), F.col("l_tax")).alias("nonzero"),
        (F.abs(unit - F.round(unit, 2)) <= 1e-3).alias("near"),
    )


@query(
    "json_map_columns",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(len(json_keys(props)) AS INTEGER) AS n FROM events",
)
def json_map_columns(spark, d):
    rows = load(spark, d, "events").withColumn("m", jsonx.decode_map("props"))
    return rows.select("event_id", F.try_element_at("m", F.lit("k")).try_cast("double").alias("k"), F.size("m").alias("n"))


@query(
    "entity_keys",
    "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 1 THEN 'horse:' || c_custkey WHEN c_custkey % 3 = 2 THEN 'registry:T' || c_custkey ELSE 'name:' || substr(sha256(upper(c_name)), 1, 20) END AS entity, 'run' || c_custkey AS run FROM customer",
)
def entity_keys(spark, d):
    key = F.col("c_custkey")
    horse = F.when(key % 3 == 1, key).otherwise(0)
    registry = F.when(key % 3 == 2, F.concat(F.lit("T"), key.cast("string")))
    return load(spark, d, "customer").select(
        key.alias("id"), jsonx.entity_key(horse, registry, F.col("c_name")).alias("entity"),
        jsonx.run_prefix(F.concat_ws(":", F.concat(F.lit("run"), key.cast("string")), F.lit("7"))).alias("run"),
    )


@query("scan_project_types", "SELECT o_orderkey AS race_id, CAST(o_orderdate AS DATE) AS race_date, o_totalprice AS prize FROM orders")
def scan_project_types(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.select(F.col("o_orderkey").alias("race_id"), F.col("o_orderdate").cast("date").alias("race_date"), F.col("o_totalprice").alias("prize"))


@query(
    "string_agg",
    "SELECT s_nationkey AS nation, string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS suppliers, count(*) AS n FROM supplier GROUP BY s_nationkey",
)
def string_agg(spark, d):
    return load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.array_join(F.array_sort(F.collect_set("s_name")), "|").alias("suppliers"), F.count(F.lit(1)).alias("n")
    )


@query(
    "distinct_counts",
    "SELECT l_returnflag AS surface, count(DISTINCT l_orderkey) AS races, count(DISTINCT l_partkey) AS horses, count(*) AS rows FROM lineitem GROUP BY 1",
)
def distinct_counts(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("surface")).agg(
        F.count_distinct("l_orderkey").alias("races"), F.count_distinct("l_partkey").alias("horses"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "null_safe_ratio",
    base.SQL + "SELECT track, surface, round(coalesce(100.0 * sum(CASE WHEN odds > 500 THEN odds END) / nullif(count(CASE WHEN odds > 500 THEN odds END), 0), 0), 4) AS ratio FROM prog GROUP BY ALL",
)
def null_safe_ratio(spark, d):
    high = F.when(F.col("odds") > 500, F.col("odds"))
    return base.program(spark, d).groupBy("track", "surface").agg(
        F.round(F.coalesce(F.try_divide(100.0 * F.sum(high), F.count(high)), F.lit(0.0)), 4).alias("ratio")
    )


@query("conditional_counts", "SELECT o_orderpriority AS track, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY 1")
def conditional_counts(spark, d):
    return load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("track")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"),
        F.count_if(F.col("o_totalprice") > 200000).alias("large"),
    )


@query(
    "category_stats_map",
    """WITH r AS (SELECT l_partkey AS horse, l_returnflag AS surface, CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 'winter' WHEN month(l_shipdate) <= 5 THEN 'spring' WHEN month(l_shipdate) <= 8 THEN 'summer' ELSE 'autumn' END AS season, l_linenumber = 1 AS win, l_tax > 0 AS prize FROM lineitem),
x AS (SELECT horse, 'surface' AS dimension, surface AS category, win, prize FROM r UNION ALL SELECT horse, 'season', season, win, prize FROM r), g AS (SELECT horse, dimension, category, count(*) AS s, count(*) FILTER (win) AS w, count(*) FILTER (prize) AS p FROM x GROUP BY ALL)
SELECT horse, dimension, string_agg(category || ':' || s || ':' || w || ':' || p, ',' ORDER BY category) AS stats FROM g GROUP BY horse, dimension""",
)
def category_stats_map(spark, d):
    rows = load(spark, d, "lineitem").select(
        F.col("l_partkey").alias("horse"), "l_returnflag", "l_shipdate", "l_linenumber", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("prize")
    )
    out = quality.category_statistics(
        rows, "horse", {"surface": F.col("l_returnflag"), "season": dates.season("l_shipdate")}, F.col("l_linenumber") == 1, "prize"
    )
    entries = F.array_sort(F.map_entries("stats"), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))
    line = F.transform(entries, lambda e: F.concat_ws(":", e["key"], e["value"]["starts"], e["value"]["wins"], e["value"]["prize_known"]))
    return out.select("horse", "dimension", F.array_join(line, ",").alias("stats"))


@query(
    "coverage_ratios",
    """SELECT 'orders' AS label, count(DISTINCT o_custkey) AS have, (SELECT count(*) FROM customer) AS total, round(100.0 * count(DISTINCT o_custkey) / (SELECT count(*) FROM customer), 2) AS pct FROM orders
UNION ALL SELECT 'labels', count(DISTINCT doc_id), (SELECT count(*) FROM documents), round(100.0 * count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 2) FROM labels""",
)
def coverage_ratios(spark, d):
    return quality.coverage_ratio(load(spark, d, "orders"), "o_custkey", load(spark, d, "customer"), "orders").unionByName(
        quality.coverage_ratio(load(spark, d, "labels"), "doc_id", load(spark, d, "documents"), "labels")
    )


@query(
    "nonzero_coverage",
    "SELECT 'l_discount' AS feature_name, count(*) FILTER (l_discount > 0) AS non_zero_count, count(*) AS total_rows, round(100.0 * count(*) FILTER (l_discount > 0) / count(*), 6) AS coverage_percent FROM lineitem UNION ALL SELECT 'l_tax', count(*) FILTER (l_tax > 0), count(*), round(100.0 * count(*) FILTER (l_tax > 0) / count(*), 6) FROM lineitem",
)
def nonzero_coverage(spark, d):
    return quality.nonzero_coverage(load(spark, d, "lineitem"), ["l_discount", "l_tax"]).withColumn("coverage_percent", F.round("coverage_percent", 6))


@query("year_distribution", "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS rows, count(DISTINCT l_orderkey) AS races FROM lineitem GROUP BY 1")
def year_distribution(spark, d):
    return quality.year_distribution(load(spark, d, "lineitem"), "l_shipdate", "l_orderkey")


@query(
    "count_deltas",
    "SELECT 'orders' AS \"table\", count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS rows_before, count(*) AS rows_after, count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') AS delta FROM orders UNION ALL SELECT 'lineitem', count(*) FILTER (l_shipdate < TIMESTAMP '2000-01-01'), count(*), count(*) FILTER (l_shipdate >= TIMESTAMP '2000-01-01') FROM lineitem",
)
def count_deltas(spark, d):
    orders, line = load(spark, d, "orders"), load(spark, d, "lineitem")
    cut = F.lit("2000-01-01").cast("timestamp")
    before = {"orders": orders.filter(F.col("o_orderdate") < cut), "lineitem": line.filter(F.col("l_shipdate") < cut)}
    return quality.count_deltas(before, {"orders": orders, "lineitem": line})


@query(
    "status_split",
    "WITH p AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'restricted' WHEN quality = 1 THEN 'public_available' ELSE 'error' END AS status_class FROM labels) SELECT status_class, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT 'unprobed', count(*) FROM documents WHERE lang <> 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)",
)
def status_split(spark, d):
    catalog = load(spark, d, "documents").select("doc_id", (F.col("lang") != "de").cast("int").alias("enabled"))
    status = F.when(F.col("toxic") == 1, "restricted").when(F.col("quality") == 1, "public_available").otherwise("error")
    return quality.status_split(catalog, load(spark, d, "labels").select("doc_id", status.alias("status_class")), "doc_id")


@query("equi_joins", "SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def equi_joins(spark, d):
    nation = load(spark, d, "nation").filter("n_nationkey % 5 <> 0")
    out = load(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(
        load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    )
    return out.select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("nation"), F.col("r_name").alias("region"))


@query("validated_merge", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def validated_merge(spark, d):
    right = quality.require_unique(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"), ["l_orderkey"])
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(right, "l_orderkey", "left")


@query("semi_anti", "SELECT s_suppkey, s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1) AS semi FROM supplier")
def semi_anti(spark, d):
    supplier = load(spark, d, "supplier").select(F.col("s_suppkey"))
    hot = load(spark, d, "lineitem").filter("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_suppkey").alias("s_suppkey"))
    semi = supplier.join(hot, "s_suppkey", "left_semi").withColumn("semi", F.lit(True))
    return semi.unionByName(supplier.join(hot, "s_suppkey", "left_anti").withColumn("semi", F.lit(False)))


@query(
    "default_then_enrich",
    "SELECT o_orderkey AS id, coalesce(x.v, 'not_available_checked') AS weather FROM orders LEFT JOIN (SELECT c_custkey, min(c_mktsegment) AS v FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) x ON x.c_custkey = o_custkey",
)
def default_then_enrich(spark, d):
    rows = features.with_defaults(load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k")))
    lookup = load(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("weather"))
    return features.enrich(rows, lookup, ["k"], ["weather", "humidity"], [F.col("weather").asc()]).select("id", "weather")


@query("stable_sort", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def stable_sort(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@query("ordered_labels", "SELECT o_orderpriority AS label, count(*) AS n, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END AS INTEGER) AS place FROM orders GROUP BY 1")
def ordered_labels(spark, d):
    out = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    place = sets.ordered_label(F.col("label"), ["5-LOW", "1-URGENT"])
    return out.withColumn("place", place).orderBy("place", "label")


@query("latest_one", "SELECT event_id, ts, user_id FROM events ORDER BY ts DESC LIMIT 1")
def latest_one(spark, d):
    return load(spark, d, "events").select("event_id", "ts", "user_id").orderBy(F.col("ts").desc()).limit(1)


@query("union_by_name", "SELECT o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS VARCHAR) AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def union_by_name(spark, d):
    return sets.union_all(
        load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount")),
        load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
    )


@query(
    "distinct_keep_last",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def distinct_keep_last(spark, d):
    rows = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return sets.keep_last(rows, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).drop("o_orderdate")


@query("first_source_wins", "SELECT c_custkey AS id, 'customer' AS src FROM customer UNION ALL SELECT DISTINCT o_orderkey, 'orders' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def first_source_wins(spark, d):
    return sets.first_source_wins(
        ["id"],
        load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("src")),
        load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("src")),
    )


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, d):
    return load(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(load(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("unpivot_scores", "SELECT l_orderkey AS id, l_linenumber AS no, m.model, CASE m.model WHEN 'price' THEN l_extendedprice WHEN 'quantity' THEN l_quantity ELSE l_discount END AS score FROM lineitem CROSS JOIN (VALUES ('price'), ('quantity'), ('discount')) AS m(model)")
def unpivot_scores(spark, d):
    rows = load(spark, d, "lineitem")
    return sets.unpivot_models(
        rows.withColumnsRenamed({"l_orderkey": "id", "l_linenumber": "no"}),
        {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount"}, ["id", "no"], "score",
    )


@query("grouping_sets", "SELECT o_orderpriority AS track, o_orderstatus AS class, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), (o_orderpriority, o_orderstatus))")
def grouping_sets(spark, d):
    rows = load(spark, d, "orders").select(F.col("o_orderpriority").alias("track"), F.col("o_orderstatus").alias("class"), "o_totalprice")
    out = rows.groupingSets([["track"], ["class"], ["track", "class"]], "track", "class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return out
