"""Entity resolution, name matching, links, worklists and the graph search."""

from __future__ import annotations

from pyspark.sql import functions as F

from furlong.catalog import base
from furlong.catalog.history import r6
from furlong.catalog.registry import query
from furlong.functions import dates, jsonx, text
from furlong.operators import filters, graph, quality, resolve, sets
from furlong.plans import coverage
from furlong.session import load


def _customers(spark, d):
    return load(spark, d, "customer")


@query(
    "id_priority_chain",
    """WITH c AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS n FROM customer),
x AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'S' || id END AS s0, CASE WHEN id % 3 = 0 THEN 'P' || (id + 5) END AS s1, CASE WHEN id % 5 = 0 THEN 'L' || id END AS s2, CASE WHEN id % 7 = 0 THEN 'F' || id END AS s3,
  CASE WHEN id % 11 = 0 THEN 'N' || id END AS s4, CASE WHEN id % 13 = 0 THEN 'M' || id END AS s5, id % 17 = 0 AS given FROM c)
SELECT id, CASE WHEN given THEN 'G' || id ELSE coalesce(s0, s1, s2, s3, s4, s5) END AS registry_id,
  CASE WHEN given THEN 'input' WHEN s0 IS NOT NULL OR s1 IS NOT NULL THEN 'program_entries' WHEN s2 IS NOT NULL THEN 'links' WHEN s3 IS NOT NULL OR s4 IS NOT NULL THEN 'profiles' WHEN s5 IS NOT NULL THEN 'mapping' END AS id_source,
  CASE WHEN given OR s0 IS NOT NULL OR s1 IS NOT NULL OR s2 IS NOT NULL OR s3 IS NOT NULL THEN 1.0::DOUBLE WHEN s4 IS NOT NULL THEN 0.8::DOUBLE WHEN s5 IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN given THEN 'GIVEN' WHEN s0 IS NOT NULL THEN 'SAME_DAY' WHEN s1 IS NOT NULL THEN 'LATEST_DAY' WHEN s2 IS NOT NULL THEN 'VERIFIED_LINK' WHEN s3 IS NOT NULL THEN 'PROFILE_ID' WHEN s4 IS NOT NULL THEN 'FOLDED_NAME' WHEN s5 IS NOT NULL THEN 'LEGACY_MAPPING' ELSE 'NOT_FOUND' END AS resolve_reason FROM x""",
)
def id_priority_chain(spark, d):
    c = _customers(spark, d).select(F.col("c_custkey").alias("id"), "c_name")
    day = lambda s: F.lit(s).cast("date")
    every = lambda n: c.filter(F.col("id") % n == 0)
    make = lambda p: F.concat(F.lit(p), F.col("id").cast("string")).alias("registry_id")
    entries = every(2).select(F.col("id").alias("horse_id"), make("S"), day("2026-01-02").alias("program_date")).unionByName(
        every(3).select(F.col("id").alias("horse_id"), F.concat(F.lit("P"), (F.col("id") + 5).cast("string")).alias("registry_id"), day("2025-12-30").alias("program_date"))
    ).unionByName(every(3).select(F.col("id").alias("horse_id"), make("OLD"), day("2025-12-01").alias("program_date")))
    links = every(5).select(F.col("id").alias("horse_id"), make("L"), F.lit(1).alias("verified"))
    profiles = every(7).select(F.col("id").cast("long").alias("horse_id"), make("F"), F.lit(None).cast("string").alias("name")).unionByName(
        every(11).select(F.lit(None).cast("long").alias("horse_id"), make("N"), F.lower("c_name").alias("name"))
    )
    mapping = every(13).select(F.col("id").alias("horse_id"), make("M"), F.lit(1).alias("verified"))
    rows = c.select(
        "id",
        F.when(F.col("id") % 17 == 0, F.concat(F.lit("registry:G"), F.col("id").cast("string")))
        .otherwise(F.concat(F.lit("horse:"), F.col("id").cast("string"))).alias("horse_id"),
        F.col("c_name").alias("horse_name"), day("2026-01-02").alias("program_date"),
    )
    rows = rows.withColumn("horse_id", F.when(F.col("horse_id") == "horse:0", "0").otherwise(F.col("horse_id")))
    out = resolve.standard_chain(rows, entries, links, profiles, mapping)
    return out.select("id", "registry_id", "id_source", "confidence", "resolve_reason")


@query(
    "link_backfill_conflicts",
    """WITH e AS (SELECT c_custkey AS h, CASE WHEN c_custkey % 10 = 0 THEN '0' WHEN c_custkey % 10 = 1 THEN 'T' || (c_custkey - 1) ELSE 'T' || c_custkey END AS t FROM customer UNION ALL SELECT c_custkey, 'X' || c_custkey FROM customer WHERE c_custkey % 10 = 2),
l AS (SELECT c_custkey AS h, 'T' || c_custkey AS t FROM customer WHERE c_custkey % 10 = 3 UNION ALL SELECT c_custkey, 'Q' || c_custkey FROM customer WHERE c_custkey % 10 = 4 UNION ALL SELECT c_custkey + 1000000, 'T' || c_custkey FROM customer WHERE c_custkey % 10 = 5),
p AS (SELECT h, min(t) AS t, count(DISTINCT t) AS n FROM e WHERE t <> '0' GROUP BY h)
SELECT h AS horse_id, t AS registry_id, CASE WHEN n > 1 OR h % 10 IN (4, 5) THEN 'conflict' WHEN h % 10 = 3 THEN 'skipped' ELSE 'inserted' END AS outcome FROM p UNION ALL SELECT h, t, 'missing' FROM e WHERE t = '0'""",
)
def link_backfill_conflicts(spark, d):
    c = _customers(spark, d).select(F.col("c_custkey").alias("id"))
    tag = lambda p, e="id": F.concat(F.lit(p), F.expr(f"cast({e} as string)"))
    digit = F.col("id") % 10
    entries = c.select(
        F.col("id").alias("horse_id"), F.when(digit == 0, "0").when(digit == 1, tag("T", "id - 1")).otherwise(tag("T")).alias("registry_id")
    ).unionByName(c.filter(digit == 2).select(F.col("id").alias("horse_id"), tag("X").alias("registry_id")))
    links = (
        c.filter(digit == 3).select(F.col("id").alias("horse_id"), tag("T").alias("registry_id"))
        .unionByName(c.filter(digit == 4).select(F.col("id").alias("horse_id"), tag("Q").alias("registry_id")))
        .unionByName(c.filter(digit == 5).select((F.col("id") + 1_000_000).alias("horse_id"), tag("T").alias("registry_id")))
        .withColumn("verified", F.lit(1))
    )
    return resolve.backfill_links(entries, links)


@query(
    "unambiguous_match",
    base.SQL + """, p AS (SELECT DISTINCT horse, CAST(race_start_at AS DATE) AS day, race_id FROM snap WHERE track NOT LIKE 'Paris%'), pg AS (SELECT horse, day, count(DISTINCT race_id) AS programs, min(race_id) AS race_id FROM p GROUP BY ALL),
r AS (SELECT horse, CAST(race_start_at AS DATE) AS day, count(*) AS results FROM prog WHERE horse % 4 <> 0 GROUP BY ALL)
SELECT coalesce(pg.horse, r.horse) AS horse, coalesce(pg.day, r.day) AS day, pg.race_id, coalesce(programs, 0) AS programs, coalesce(results, 0) AS results,
  CASE WHEN coalesce(programs, 0) = 0 THEN 'no_program_snapshot' WHEN programs > 1 THEN 'ambiguous_program' WHEN coalesce(results, 0) = 0 THEN 'result_not_published' WHEN results > 1 THEN 'ambiguous_result' ELSE 'ready_to_insert' END AS reason
FROM pg FULL JOIN r ON pg.horse = r.horse AND pg.day = r.day""",
)
def unambiguous_match(spark, d):
    programs = base.snapshots(spark, d).select("horse", F.col("race_start_at").cast("date").alias("day"), "race_id", "track").distinct()
    results = base.program(spark, d).filter("horse % 4 <> 0").select("horse", F.col("race_start_at").cast("date").alias("day"))
    return resolve.unambiguous_match(programs, results, ["horse", "day"])


@query(
    "matched_results",
    base.SQL + """, p AS (SELECT DISTINCT CASE WHEN horse % 4 = 0 OR race_id % 5 = 0 THEN 'name:' || substr(sha256('H' || horse), 1, 20) ELSE 'horse:' || horse END AS hid, CAST(race_start_at AS DATE) AS day, race_id, track FROM snap),
g AS (SELECT hid, day, count(*) AS n, count(*) FILTER (track NOT LIKE 'Paris%') AS ok, min(race_id) AS rid, min(race_id) FILTER (track NOT LIKE 'Paris%') AS okrid FROM p GROUP BY ALL),
r AS (SELECT horse, CAST(race_start_at AS DATE) AS day, count(*) AS n, min(CASE WHEN entrant <> 4 THEN CAST(entrant AS DOUBLE) END) AS fin FROM prog GROUP BY ALL),
c AS (SELECT r.horse, r.day, r.fin, coalesce(CASE WHEN d.n > 1 THEN d.ok ELSE d.n END, 0) AS dn, CASE WHEN d.n > 1 THEN d.okrid ELSE d.rid END AS did, CASE WHEN b.n = 1 THEN b.rid END AS bid
  FROM r LEFT JOIN g d ON d.hid = 'horse:' || r.horse AND d.day = r.day LEFT JOIN g b ON b.hid = 'name:' || substr(sha256('H' || r.horse), 1, 20) AND b.day = r.day WHERE r.n = 1)
SELECT CASE WHEN dn = 1 THEN did ELSE bid END AS race_id, 'horse:' || horse AS horse_id, fin AS finish_position, CASE WHEN fin IS NULL THEN 'unknown' ELSE 'finished' END AS result_status, CASE WHEN dn = 1 THEN 'id' ELSE 'name' END AS matched_by
FROM c WHERE dn = 1 OR (dn = 0 AND bid IS NOT NULL)""",
)
def matched_results(spark, d):
    """Some programmes knew only the name of the horse."""
    rows = base.snapshots(spark, d)
    named = (F.col("horse") % 4 == 0) | (F.col("race_id") % 5 == 0)
    known = F.concat(F.lit("horse:"), F.col("horse").cast("string"))
    programs = rows.select(F.when(named, jsonx.name_digest("horse_name")).otherwise(known).alias("horse_id"), "race_id", "race_start_at", "race_no", "track")
    results = base.program(spark, d).select(
        known.alias("horse_id"), F.col("race_start_at").cast("date").alias("day"), F.when(F.col("entrant") != 4, F.col("entrant").cast("string")).otherwise("").alias("finish"),
        F.lit("1.34.04").alias("race_time"), F.lit(None).cast("string").alias("prize"), F.col("odds").cast("string").alias("odds"),
    )
    profiles = rows.select(known.alias("horse_key"), F.col("horse_name").alias("name")).distinct()
    return resolve.matched_results(programs, profiles, results).select("race_id", "horse_id", "finish_position", "result_status", "matched_by")


@query(
    "prediction_result_match",
    base.SQL + """SELECT p.prediction_id, r.finish_position, CASE WHEN r.finish_position = 1 THEN 1 ELSE 0 END AS winner, r.result_odds AS official_odds, CASE WHEN r.finish_position = 1 THEN coalesce(r.result_odds, 0.0) ELSE 0.0 END AS payout
FROM runs p JOIN res r ON p.race_id = r.race_id AND p.horse_id = r.horse_id AND r.result_status = 'finished' WHERE p.prediction_id NOT IN (SELECT prediction_id FROM official)""",
)
def prediction_result_match(spark, d):
    out = resolve.match_results(base.predictions(spark, d), base.results(spark, d), base.prediction_results(spark, d))
    return out.drop("official_time")


@query(
    "prefix_match",
    """WITH l AS (SELECT p_partkey AS id, p_brand AS brand, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 6) ELSE p_name || ' ii' END AS nm FROM part), r AS (SELECT DISTINCT p_brand AS brand, p_name AS cand FROM part WHERE p_partkey % 2 = 0),
j AS (SELECT l.id, cand, nm = cand AS ex, row_number() OVER (PARTITION BY l.id ORDER BY (nm = cand) DESC, cand) AS rn FROM l JOIN r ON l.brand = r.brand AND (starts_with(cand, nm) OR starts_with(nm, cand)))
SELECT l.id, j.cand AS matched, CASE WHEN j.cand IS NULL THEN 'none' WHEN ex THEN 'exact' ELSE 'prefix' END AS match_kind FROM l LEFT JOIN j ON j.id = l.id AND rn = 1""",
)
def prefix_match(spark, d):
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    third = F.col("p_partkey") % 3
    left = part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"),
        F.when(third == 0, F.col("p_name")).when(third == 1, F.substring("p_name", 1, 6)).otherwise(F.concat("p_name", F.lit(" ii"))).alias("nm"),
    )
    right = part.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("cand"))
    out = resolve.prefix_match(left, right, ["brand"], "nm", "cand", [])
    return out.select("id", F.col("cand").alias("matched"), "match_kind")


def _damaged(name):
    """Every name with its third letter dropped."""
    return F.concat(F.substring(name, 1, 2), F.expr(f"substring({name}, 4)"))


@query("fuzzy_match")
def fuzzy_match(spark, d):
    """Exact, else similar names inside a brand."""
    part = load(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.upper("p_name").alias("name"))
    left = part.select("p_partkey", "brand", F.when(F.col("p_partkey") % 2 == 0, F.col("name")).otherwise(_damaged("name")).alias("name"))
    right = part.select("brand", F.col("name").alias("known")).distinct()
    return resolve.block_match(left, right, ["brand"], "name", "known", 85.0).select("p_partkey", "brand", "name", "matched_name", r6("match_score"))


@query("fuzzy_links")
def fuzzy_links(spark, d):
    """Page records linked by name (address) and both parents (host, last part)."""
    c = load(spark, d, "pages").select(
        F.col("page_id").alias("id"), F.col("url").alias("name"),
        F.regexp_extract("url", r"//([^/]+)/", 1).alias("father_name"), F.substring_index("url", "/", -1).alias("mother_name"),
    )
    damaged = c.withColumn("name", F.when(F.col("id") % 3 == 0, F.regexp_replace("name", "example", "exmple")).otherwise(F.col("name")))
    return resolve.weighted_links(damaged, c)


@query(
    "comparison_rows",
    """WITH a AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS race_date, o_orderpriority AS city, CAST(o_orderkey % 5 AS INTEGER) AS race_no, 'HORSE ' || o_custkey AS nm, CAST(o_orderkey % 4 AS INTEGER) AS fin FROM orders),
p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS race_date, o_orderpriority AS city, CAST(o_orderkey % 5 AS INTEGER) AS race_no, 'HORSE ' || o_custkey AS nm FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, p.nm IS NOT NULL AS matched, CASE WHEN fin = 1 AND p.nm IS NOT NULL THEN 1 ELSE 0 END AS is_top1 FROM a LEFT JOIN p USING (race_date, city, race_no, nm)""",
)
def comparison_rows(spark, d):
    """Names differ in their last letters only, so nothing but exact names may match at 100."""
    o = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("race_date"), F.col("o_orderpriority").alias("city"),
        (F.col("o_orderkey") % 5).cast("int").alias("race_no"), F.concat(F.lit("HORSE "), F.col("o_custkey").cast("string")).alias("horse_name"),
        (F.col("o_orderkey") % 4).cast("int").alias("finish_position"),
    )
    preds = o.filter("id % 2 = 0").select("race_date", "city", "race_no", "horse_name", F.lit(1).alias("predicted_rank"), F.lit(0.5).alias("probability")).distinct()
    out = coverage.comparisons(o, preds, 100.0)
    return out.select("id", F.col("matched_name").isNotNull().alias("matched"), "is_top1")


@query("comparison_summary")
def comparison_summary(spark, d):
    """Race summary of finishers against predictions, similar names accepted from 85 on."""
    o = load(spark, d, "orders").select(
        F.date_trunc("month", "o_orderdate").cast("date").alias("race_date"), F.col("o_orderpriority").alias("city"),
        (F.col("o_orderkey") % 5).cast("int").alias("race_no"), F.concat(F.lit("HORSE "), F.col("o_custkey").cast("string")).alias("horse_name"),
        (F.col("o_orderkey") % 4).cast("int").alias("finish_position"), "o_orderkey",
    )
    preds = o.filter("o_orderkey % 2 = 0").select(
        "race_date", "city", "race_no", "horse_name", (F.col("o_orderkey") % 3 + 1).alias("predicted_rank"), F.lit(0.5).alias("probability")
    )
    return coverage.comparison_summary(coverage.comparisons(o.drop("o_orderkey"), preds))


@query(
    "exact_dictionary_match",
    """WITH n AS (SELECT DISTINCT upper(w) AS name FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ')) AS w FROM benchmark) WHERE length(w) >= 4),
t AS (SELECT doc_id, upper(trim(regexp_replace(regexp_replace(translate(text, 'ÇĞİÖŞÜçğıöşü', 'CGIOSUcgiosu'), '[^A-Za-z ]', '', 'g'), '\\s+', ' ', 'g'))) AS body FROM documents),
m AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS rn FROM t JOIN n ON contains(t.body, n.name)) SELECT doc_id, name FROM m WHERE rn = 1""",
)
def exact_dictionary_match(spark, d):
    words = load(spark, d, "benchmark").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " ")).alias("w"))
    names = words.select(F.upper("w").alias("name")).distinct()
    docs = load(spark, d, "documents").select("doc_id", "text")
    return resolve.dictionary_match(docs, names, "doc_id", "text", "name", clean=text.clean_name).select("doc_id", "name")


_LETTERS = "'0123456789', 'ABCDEFGHIJ'"
_CODED = "'AT' || translate(lpad(CAST(({k} * 7919) % 1000003 AS VARCHAR), 6, '0'), " + _LETTERS + ") || ' ' || translate(lpad(CAST(({k} * 104729) % 1000003 AS VARCHAR), 6, '0'), " + _LETTERS + ")"
NAME_CHAIN_SQL = f"""
WITH n AS (SELECT DISTINCT {_CODED.format(k="c_custkey")} AS name FROM customer),
e AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, {_CODED.format(k="o_custkey")} AS w, {_CODED.format(k="(o_custkey + 1)")} AS w2 FROM orders),
x AS (SELECT id, k, w, CASE k WHEN 0 THEN w WHEN 1 THEN w || ' KG DB' WHEN 2 THEN substr(w, 1, 13) WHEN 3 THEN substr(w, 1, 5) || substr(w, 7) WHEN 4 THEN '' ELSE 'ZZZZ QQQ' END AS nm,
  CASE WHEN k = 4 THEN 'ONCE ' || w || ' AND ' || w2 || ' RAN' ELSE 'NOTHING HERE' END AS body FROM e),
d AS (SELECT DISTINCT nm FROM x WHERE nm <> ''),
c AS (SELECT nm, arg_min(name, (contains(name, nm)::INT, CASE WHEN contains(nm, name) THEN -length(name) ELSE length(name) END, name)) AS name FROM d JOIN n ON contains(nm, name) OR contains(name, nm) GROUP BY nm),
t AS (SELECT id, arg_min(name, (-length(name), name)) AS name FROM (SELECT id, unnest([w, w2]) AS name FROM e WHERE k = 4) JOIN n USING (name) GROUP BY id)
SELECT x.id, CASE WHEN n.name IS NOT NULL THEN n.name WHEN c.name IS NOT NULL THEN c.name WHEN x.k = 3 THEN o.name ELSE t.name END AS matched_name,
  CASE WHEN n.name IS NOT NULL THEN 'exact' WHEN c.name IS NOT NULL THEN 'contained' WHEN x.k = 3 AND o.name IS NOT NULL THEN 'similar' WHEN t.name IS NOT NULL THEN 'in_text' ELSE 'none' END AS match_step,
  round(CASE WHEN n.name IS NOT NULL THEN 1.0 WHEN c.name IS NOT NULL THEN 0.95 WHEN x.k = 3 AND o.name IS NOT NULL THEN 28.0 / 29.0 WHEN t.name IS NOT NULL THEN 0.95 ELSE 0.0 END, 6)::DOUBLE AS match_confidence
FROM x LEFT JOIN n ON n.name = x.nm LEFT JOIN c ON c.nm = x.nm LEFT JOIN n o ON o.name = x.w LEFT JOIN t ON t.id = x.id"""


def _coded(k):
    part = lambda m: F.translate(F.lpad(((k * m) % 1000003).cast("string"), 6, "0"), "0123456789", "ABCDEFGHIJ")
    return F.concat(F.lit("AT"), part(7919), F.lit(" "), part(104729))


@query("name_chain", NAME_CHAIN_SQL)
def name_chain(spark, d):
    """Entrant of each report event: exact, contained, similar, then named in the text."""
    names = _customers(spark, d).select(_coded(F.col("c_custkey")).alias("name"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 6).alias("k"), _coded(F.col("o_custkey")).alias("w"), _coded(F.col("o_custkey") + 1).alias("w2"))
    k, w = F.col("k"), F.col("w")
    said = (
        F.when(k == 0, w).when(k == 1, F.concat(w, F.lit(" KG DB"))).when(k == 2, F.substring(w, 1, 13))
        .when(k == 3, F.concat(F.substring(w, 1, 5), F.expr("substring(w, 7)"))).when(k == 4, "").otherwise("ZZZZ QQQ")
    )
    body = F.when(k == 4, F.concat(F.lit("ONCE "), w, F.lit(" AND "), F.col("w2"), F.lit(" RAN"))).otherwise("NOTHING HERE")
    events = o.select("id", said.alias("nm"), body.alias("body"))
    return resolve.name_chain(events, names, "id", "nm", "body", "name").select("id", "matched_name", "match_step", r6("match_confidence"))


COMPOSITE_SQL = f"""
WITH c AS (SELECT c_custkey AS id, c_custkey % 4 AS k, {_CODED.format(k="c_custkey")} AS w, {_CODED.format(k="(c_custkey % 97)")} AS f, {_CODED.format(k="(c_custkey % 89)")} AS m FROM customer)
SELECT id AS left_id, id AS right_id, CASE k WHEN 0 THEN 'exact_name_parents' ELSE 'fuzzy_name_parents' END AS method,
  round(CASE k WHEN 0 THEN 100.0 WHEN 1 THEN 0.55 * 0.95 * 100 + 45 WHEN 2 THEN 0.55 * 2800.0 / 29 + 45 END, 6)::DOUBLE AS score,
  round(CASE k WHEN 0 THEN 100.0 WHEN 1 THEN 95.0 WHEN 2 THEN 2800.0 / 29 END, 6)::DOUBLE AS name_score FROM c WHERE k < 3"""


@query("composite_links", COMPOSITE_SQL)
def composite_links(spark, d):
    """Customers linked with damaged copies: equal, words swapped, a letter lost, a parent changed."""
    k = F.col("c_custkey")
    c = _customers(spark, d).select(k.alias("id"), (k % 4).alias("k"), _coded(k).alias("name"), _coded(k % 97).alias("father_name"), _coded(k % 89).alias("mother_name"))
    swapped = F.concat(F.substring_index("name", " ", -1), F.lit(" "), F.substring_index("name", " ", 1))
    lost = F.concat(F.substring("name", 1, 5), F.expr("substring(name, 7)"))
    damaged = c.withColumns({
        "name": F.when(F.col("k") == 1, swapped).when(F.col("k") == 2, lost).otherwise(F.col("name")),
        "father_name": F.when(F.col("k") == 3, F.lit("ZZZ QQQ")).otherwise(F.col("father_name")),
    })
    return resolve.composite_links(damaged, c).select("left_id", "right_id", "method", r6("score"), r6("name_score"))


@query(
    "event_to_race_match",
    """WITH e AS (SELECT event_id, CAST(user_id % 20 AS INTEGER) AS grp, CAST(event_id % 9 AS INTEGER) AS no FROM events), n AS (SELECT CAST(o_custkey % 25 AS INTEGER) AS g, CAST(o_orderkey % 7 AS INTEGER) AS k, min(o_orderkey) AS race FROM orders GROUP BY ALL)
SELECT e.event_id, coalesce(a.race, (SELECT min(n.race) FROM n WHERE n.g = e.grp)) AS matched_race,
  CASE WHEN e.grp IN (SELECT g FROM n) THEN CAST(a.race IS NOT NULL AS INTEGER) END AS same_number FROM e LEFT JOIN n a ON a.g = e.grp AND a.k = e.no""",
)
def event_to_race_match(spark, d):
    events = load(spark, d, "events").select("event_id", (F.col("user_id") % 20).cast("int").alias("grp"), (F.col("event_id") % 9).cast("int").alias("no"))
    races = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("race"), (F.col("o_custkey") % 25).cast("int").alias("grp"), (F.col("o_orderkey") % 7).cast("int").alias("rn")
    )
    out = resolve.event_race_match(events, races, "event_id", ["grp"], "no", "rn", "race")
    return out.select("event_id", "matched_race", F.col("same_number").cast("int").alias("same_number"))


@query("slot_lookup", base.SQL + "SELECT r.race_id, r.horse_id, p.horse_name FROM res r JOIN prog p ON p.race_id = r.race_id AND CAST(p.entrant AS VARCHAR) = CAST(r.horse_id AS VARCHAR)")
def slot_lookup(spark, d):
    """Entrant found by race and start number, written as text on one side."""
    slots = base.program(spark, d).select("race_id", F.col("entrant").cast("string").alias("gate"), "horse_name", "captured_at", "race_start_at").filter("captured_at < race_start_at")
    wanted = base.results(spark, d).select("race_id", "horse_id", F.trim(F.col("horse_id").cast("string")).alias("gate"))
    return wanted.join(slots, ["race_id", "gate"]).select("race_id", "horse_id", "horse_name")


@query(
    "id_replacement",
    """WITH s AS (SELECT o_orderkey AS race, CASE WHEN o_orderkey % 2 = 0 THEN 'name:' || o_custkey ELSE 'horse:' || o_custkey END AS horse_id, 'C' || o_custkey AS nm, o_custkey AS c FROM orders),
x AS (SELECT *, CASE WHEN horse_id LIKE 'name:%' AND c % 3 <> 0 THEN CASE WHEN c % 3 = 1 THEN 'horse:' || c ELSE 'registry:R' || c END END AS nw FROM s)
SELECT race, coalesce(nw, horse_id) AS horse_id, nw IS NOT NULL AS replaced FROM x""",
)
def id_replacement(spark, d):
    o = load(spark, d, "orders")
    key = F.col("o_custkey").cast("string")
    snaps = o.select(
        F.col("o_orderkey").alias("race"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("name:"), key)).otherwise(F.concat(F.lit("horse:"), key)).alias("horse_id"),
        F.concat(F.lit("C"), key).alias("horse_name"), F.lit("2026-01-01").cast("date").alias("program_date"),
    )
    c = load(spark, d, "customer").filter("c_custkey % 3 <> 0")
    first = F.col("c_custkey") % 3 == 1
    entries = c.select(
        F.lit("2026-01-01").cast("date").alias("program_date"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("horse_name"),
        F.when(first, F.col("c_custkey")).alias("horse_id"), F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("registry_id"),
    )
    return resolve.replace_name_ids(snaps, entries, ["race"]).select("race", "horse_id", "replaced")


@query("worklists", "SELECT c_custkey, 'no_history' AS kind FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'no_large_order' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def worklists(spark, d):
    customers = load(spark, d, "customer").select("c_custkey")
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    first = resolve.worklist(customers, orders, ["c_custkey"]).withColumn("kind", F.lit("no_history"))
    second = resolve.worklist(customers, orders.filter("o_totalprice > 400000"), ["c_custkey"]).withColumn("kind", F.lit("no_large_order"))
    return first.unionByName(second)


@query(
    "entity_worklist",
    """WITH l AS (SELECT c_custkey AS horse_id, 'R' || c_custkey AS registry_id FROM customer WHERE c_custkey % 4 = 0)
SELECT registry_id, horse_id, 'linked' AS kind FROM l UNION ALL SELECT NULL, c_custkey, 'horse_only' FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT 'R' || c_custkey, NULL, 'registry_only' FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 = 0""",
)
def entity_worklist(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("horse_id"), F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("registry_id"))
    found = c.withColumn("registry_id", F.when(F.col("horse_id") % 3 == 0, F.col("registry_id")))
    return resolve.entity_worklist(c.filter("horse_id % 4 = 0").withColumn("verified", F.lit(1)), found)


@query(
    "existence_flags",
    """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_finished, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS has_large FROM customer""",
)
def existence_flags(spark, d):
    orders = load(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = filters.flag_existing(load(spark, d, "customer").select("c_custkey"), orders.filter("o_orderstatus = 'F'"), ["c_custkey"], "has_finished")
    return filters.flag_existing(rows, orders.filter("o_totalprice > 450000"), ["c_custkey"], "has_large")


@query(
    "final_window_exists",
    base.SQL + "SELECT DISTINCT race_id FROM (SELECT race_id, race_start_at - to_minutes(race_id % 40) AS pt, race_start_at FROM prog) WHERE pt >= race_start_at - INTERVAL 15 MINUTE AND pt < race_start_at",
)
def final_window_exists(spark, d):
    rows = base.program(spark, d).withColumn("pt", F.timestamp_micros(F.unix_micros("race_start_at") - (F.col("race_id") % 40) * 60_000_000))
    return rows.filter(filters.final_window("pt", "race_start_at")).select("race_id").distinct()


@query(
    "fresh_days",
    "SELECT CAST(ts AS DATE) AS day, bool_and(ts > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 720 MINUTE) AS usable, count(*) AS rows FROM events GROUP BY 1",
)
def fresh_days(spark, d):
    rows = load(spark, d, "events").select("ts", F.col("ts").cast("date").alias("day"))
    return filters.fresh_days(rows, "day", "ts", F.lit("2024-01-15 12:00:00").cast("timestamp"), 720)


@query(
    "primary_else_fallback",
    """WITH p AS (SELECT CAST(ts AS DATE) AS day, event_id, value FROM events WHERE event_type = 'purchase' AND day(ts) % 2 = 0), f AS (SELECT CAST(ts AS DATE) AS day, event_id FROM events WHERE event_type = 'view')
SELECT day, event_id, value FROM p UNION ALL SELECT day, event_id, NULL FROM f WHERE day NOT IN (SELECT day FROM p)""",
)
def primary_else_fallback(spark, d):
    rows = load(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    primary = rows.filter("event_type = 'purchase' AND day(ts) % 2 = 0").select("day", "event_id", "value")
    fallback = rows.filter("event_type = 'view'").select("day", "event_id")
    return sets.primary_else_fallback(primary, fallback, ["day"])


@query(
    "day_rollup",
    base.SQL + "SELECT race_id, max(race_start_at) AS race_start_at, max(track) AS track, max(race_no) AS race_no, count(*) AS horse_count FROM allprog GROUP BY race_id",
)
def day_rollup(spark, d):
    return quality.race_rollup(base.programs(spark, d))


@query(
    "supported_cities",
    "SELECT * FROM (VALUES ('ANKARA', 'Ankara'), ('ISTANBUL', 'İstanbul'), ('IZMIR', 'İzmir'), ('SANLIURFA', 'Şanlıurfa')) AS t(city_key, city) WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders) = 5",
)
def supported_cities(spark, d):
    return quality.supported_cities(base.snapshots(spark, d), "track")


@query(
    "bfs_depth",
    """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
b(node, depth) AS (SELECT 'r0', 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node""",
)
def bfs_depth(spark, d):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = (
        load(spark, d, "nation").select(tag("r", "n_regionkey").alias("src"), tag("n", "n_nationkey").alias("dst"))
        .unionByName(load(spark, d, "supplier").select(tag("n", "s_nationkey").alias("src"), tag("s", "s_suppkey").alias("dst")))
        .unionByName(load(spark, d, "lineitem").select(tag("s", "l_suppkey").alias("src"), tag("p", "l_partkey").alias("dst")))
    )
    seeds = load(spark, d, "region").filter("r_regionkey = 0").select(tag("r", "r_regionkey").alias("node"))
    return graph.bfs(edges, seeds, 3)


@query(
    "unmatched_rows",
    base.SQL + "SELECT prediction_id FROM runs WHERE prediction_id NOT IN (SELECT prediction_id FROM official)",
)
def unmatched_rows(spark, d):
    return filters.without(base.predictions(spark, d), base.prediction_results(spark, d), ["prediction_id"]).select("prediction_id")


@query(
    "scope_filter",
    base.SQL + ", t AS (SELECT race_id, max(track) AS track, max(race_start_at) AS s FROM allprog GROUP BY race_id) SELECT race_id, CASE WHEN track LIKE 'Paris%' THEN 'unsupported' WHEN track LIKE 'İstanbul%' OR track = 'Şirinyer' THEN 'mandatory' ELSE 'supported' END AS track_policy FROM t WHERE track NOT LIKE 'Paris%'",
)
def scope_filter(spark, d):
    races = quality.race_rollup(base.programs(spark, d))
    return races.filter(filters.in_country("track", "TR")).select("race_id", text.track_policy("track").alias("track_policy"))


@query(
    "local_day_filter",
    "SELECT event_id, CAST(ts + INTERVAL 3 HOUR AS DATE) AS local_day, strftime(ts + INTERVAL 3 HOUR, '%H:%M') AS local_clock FROM events WHERE CAST(ts + INTERVAL 3 HOUR AS DATE) = DATE '2024-01-10' AND ts > TIMESTAMP '2024-01-10 06:00:00'",
)
def local_day_filter(spark, d):
    rows = load(spark, d, "events")
    kept = rows.filter(filters.upcoming_on("2024-01-10", F.lit("2024-01-10 06:00:00").cast("timestamp"), "ts"))
    return kept.select("event_id", dates.local_day("ts").alias("local_day"), dates.local_clock("ts").alias("local_clock"))
