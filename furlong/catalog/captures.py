"""Sources: nested captures, raw responses, HTML tables, report text, sectioned files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from furlong.catalog import base
from furlong.catalog.registry import query
from furlong.functions import text
from furlong.operators import skew
from furlong.plans import features
from furlong.session import load, shared_dir
from furlong.sources import conditions, entities, html_rows, programme, report_text, result_csv, scans


def _captures(spark, d):
    """One programme payload per order day and priority, built from the order lines."""
    rows = base.program(spark, d).select(
        F.col("race_start_at").cast("date").alias("day"), "priority", "race_id", "race_no", "entrant", "horse", "horse_name", "weight", "odds", "discount", "jockey", "trainer", "surface"
    )
    text_of = lambda c: F.col(c).cast("string")
    entrant = F.struct(
        F.when(F.col("horse") % 2 == 0, text_of("horse")).otherwise("0").alias("REGISTRY_ID"),
        F.concat("horse_name", F.lit("\nnote")).alias("HORSE_NAME"),
        F.struct(F.when(F.col("horse") % 3 == 0, text_of("horse")).alias("HORSE_ID")).alias("HORSE_INFO"),
        text_of("entrant").alias("START"), F.translate(text_of("weight"), ".", ",").alias("WEIGHT"), F.col("jockey").alias("JOCKEY"), F.col("trainer").alias("COACH"),
        F.concat(F.lit("%"), (F.col("discount") * 100).cast("int").cast("string"), F.lit("("), text_of("entrant"), F.lit(")")).alias("AGF"),
        F.translate(text_of("odds"), ".", ",").alias("GNY"),
    )
    tabs = rows.groupBy("day", "priority", "race_id", "race_no").agg(
        F.array_sort(F.collect_list(entrant), lambda a, b: F.when(a["START"] < b["START"], -1).otherwise(1)).alias("PROGRAM_LIST")
    )
    tab = F.struct(
        F.col("race_id").alias("RACE_TAB_ID"), F.concat(text_of("race_no"), F.lit(". Koşu")).alias("RACE_NO"),
        F.when(F.col("race_id") % 5 != 0, "Start 14.30").otherwise("Start ?").alias("RACE_TAB_NAME"),
        F.lit("Maiden, 58 kg,  1400 Kum").alias("TITLE"), "PROGRAM_LIST",
    )
    city = F.struct(F.lit(7).cast("bigint").alias("CITY_ID"), F.col("priority").alias("CITY_NAME"), F.col("_tabs").alias("SUB_TAB"))
    return tabs.groupBy("day", "priority").agg(F.collect_list(tab).alias("_tabs")).select(
        F.to_json(F.array(city)).alias("payload"), F.date_format("day", "dd.MM.yyyy").alias("program_date"),
        F.col("day").cast("timestamp").alias("captured_at"), F.concat_ws("/", F.col("day").cast("string"), "priority").alias("source_request_id"),
    )


ENTRY_SQL = base.SQL + """, e AS (SELECT 'prog_' || CAST(race_start_at AS DATE) || '_7_' || race_id AS race_id, CAST(race_start_at AS DATE) || '/' || priority AS source_request_id, race_id AS rid, entrant, horse, race_no,
  CASE WHEN horse % 3 = 0 AND horse <> 0 THEN 'horse:' || horse WHEN horse % 2 = 0 AND horse <> 0 THEN 'registry:' || horse ELSE 'name:' || substr(sha256('H' || horse || chr(10) || 'NOTE'), 1, 20) END AS horse_id,
  CASE WHEN race_id % 5 <> 0 THEN CAST(race_start_at AS DATE) + INTERVAL 14 HOUR + INTERVAL 30 MINUTE END AS local_start, race_start_at, weight, odds, discount, horse_name, jockey FROM prog)
"""


@query(
    "json_nested_explode",
    ENTRY_SQL + "SELECT race_id, horse_id, CAST(entrant AS DOUBLE) AS draw, weight AS carried_weight, race_no, odds, CAST(CAST(floor(round(discount * 100, 6)) AS INTEGER) AS DOUBLE) AS agf_percent, CAST(entrant AS INTEGER) AS agf_rank, horse_name, jockey, local_start IS NULL AS no_start, 1400.0::DOUBLE AS distance, 'K:' AS surface FROM e",
)
def json_nested_explode(spark, d):
    rows = programme.entries(_captures(spark, d))
    return rows.select(
        "race_id", "horse_id", "draw", "carried_weight", "race_no", "odds", "agf_percent", "agf_rank", "horse_name", "jockey",
        F.col("race_start_at").isNull().alias("no_start"), "distance", "surface",
    )


@query(
    "capture_counts",
    ENTRY_SQL + "SELECT source_request_id, count(local_start) AS program, count(local_start) AS agf, count(*) FILTER (local_start IS NOT NULL AND odds IS NOT NULL) AS odds, count(*) FILTER (local_start IS NULL) AS missing_start FROM e GROUP BY 1",
)
def capture_counts(spark, d):
    return programme.capture_counts(programme.entries(_captures(spark, d)))


@query(
    "raw_responses_replay",
    ENTRY_SQL + "SELECT DISTINCT source_request_id, race_id, horse_id, odds FROM (SELECT *, row_number() OVER (PARTITION BY source_request_id, race_id, horse_id) AS k, count(*) OVER (PARTITION BY source_request_id, race_id, horse_id) AS n FROM e WHERE local_start IS NOT NULL AND odds IS NOT NULL) WHERE n = 1",
)
def raw_responses_replay(spark, d):
    """Stored responses in an envelope give the same odds snapshots as live captures."""
    raw = _captures(spark, d).select(
        F.col("source_request_id").alias("request_key"), "program_date", F.col("captured_at").alias("fetched_at"),
        F.concat(F.lit('{"m_cData":'), "payload", F.lit("}")).alias("response_json"),
    )
    rows = programme.from_raw_responses(raw).filter("race_start_at IS NOT NULL AND odds IS NOT NULL")
    single = skew.group_totals(rows, programme.UNIQUE, {"_n": F.count(F.lit(1))}).filter("_n = 1")
    return programme.odds_snapshots(single.drop("_n")).select("source_request_id", "race_id", "horse_id", "odds")


def _responses(spark, d):
    """Two endpoints per customer, the profile fetched twice."""
    c = load(spark, d, "customer")
    key = F.concat(F.lit("horse:"), F.col("c_custkey").cast("string")).alias("entity_key")
    at = lambda s: F.lit(s).cast("timestamp").alias("fetched_at")
    stale = c.select(key, F.lit("profile").alias("endpoint"), at("2026-01-01"), F.to_json(F.struct(F.lit("old").alias("NAME"))).alias("response_json"))
    profile = c.select(
        key, F.lit("profile").alias("endpoint"), at("2026-01-02"),
        F.concat(F.lit('{"m_cData":['), F.to_json(F.struct(F.when(F.col("c_custkey") % 4 != 0, F.concat("c_name", F.lit("&amp;Co\nx"))).alias("NAME"), F.format_number("c_acctbal", 2).alias("EARN"))), F.lit("]}")).alias("response_json"),
    )
    info = c.filter("c_custkey % 8 <> 0").select(
        key, F.lit("info").alias("endpoint"), at("2026-01-02"),
        F.to_json(F.struct(F.lower("c_name").alias("HORSE_NAME"), F.col("c_nationkey").alias("START_COUNT"), F.concat(F.lit("1.1."), F.col("c_nationkey") + 1990).alias("BIRTH"))).alias("response_json"),
    )
    return stale.unionByName(profile).unionByName(info)


@query(
    "raw_to_relational",
    """SELECT 'horse:' || c_custkey AS entity_key, CASE WHEN c_custkey % 4 <> 0 THEN c_name || '&Co' ELSE lower(c_name) END AS name, CASE WHEN c_custkey % 8 <> 0 THEN CAST(c_nationkey AS BIGINT) END AS starts,
  CASE WHEN c_custkey % 8 <> 0 THEN CAST(c_nationkey + 1990 AS INTEGER) END AS birth_year FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 8 <> 0""",
)
def raw_to_relational(spark, d):
    wide = entities.wide_responses(entities.latest_responses(_responses(spark, d)), ["profile", "info"])
    out = entities.profiles(
        wide, "entity_key",
        {
            "name": ("text", [("profile", "NAME"), ("info", "HORSE_NAME")]),
            "starts": ("int", [("profile", "STARTS"), ("info", "START_COUNT")]),
            "birth": ("raw", [("info", "BIRTH")]),
        },
    )
    return out.select("entity_key", "name", "starts", entities.birth_year(F.col("birth")).alias("birth_year"))


@query(
    "recursive_objects",
    "SELECT c_custkey AS id, 1 AS level, 'A' || c_custkey AS value FROM customer UNION ALL SELECT c_custkey, 3, 'B' || c_nationkey FROM customer",
)
def recursive_objects(spark, d):
    """Objects with a HORSE_NAME anywhere in nested payloads."""
    payload = F.to_json(
        F.struct(
            F.struct(F.concat(F.lit("A"), F.col("c_custkey").cast("string")).alias("HORSE_NAME")).alias("direct"),
            F.struct(F.array(F.struct(F.concat(F.lit("B"), F.col("c_nationkey").cast("string")).alias("HORSE_NAME"))).alias("items")).alias("list"),
        )
    )
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), payload.alias("payload"))
    return entities.nested_objects(rows, "id", "payload", "HORSE_NAME")


@query(
    "nested_matrix",
    "SELECT n_nationkey AS entity, CAST(g AS INTEGER) AS generation, CAST(p AS INTEGER) AS position, n_name || '.' || g || '.' || p AS name FROM nation, range(0, 3) AS a(g), range(0, 8) AS b(p) WHERE p < power(2, g + 1)",
)
def nested_matrix(spark, d):
    cell = lambda g, p: F.struct(F.concat_ws(".", "n_name", F.lit(str(g)), F.lit(str(p))).alias("name"))
    cells = F.array(*[F.array(*[cell(g, p) for p in range(2 ** (g + 1))]) for g in range(3)])
    rows = load(spark, d, "nation").select(F.col("n_nationkey").alias("entity"), cells.alias("cells"), "n_name")
    return entities.pedigree(rows, "entity", "cells")


def _families(spark, d):
    """Suppliers as owners and customers as members of the family of their nation."""
    owners = load(spark, d, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_suppkey").alias("own"), F.col("s_nationkey").alias("k"))
    members = load(spark, d, "customer").select(
        F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("horse_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("earn")
    )
    return owners, members


@query(
    "relation_edges",
    """SELECT s_suppkey AS entity, k.relation, c_custkey AS horse_id, c_name AS name FROM supplier JOIN customer ON s_nationkey = c_nationkey CROSS JOIN (VALUES ('maternal'), ('paternal')) AS k(relation) WHERE c_custkey <> s_suppkey""",
)
def relation_edges(spark, d):
    owners, members = _families(spark, d)
    out = entities.relations(owners, {"maternal": members, "paternal": members}, "k", "entity", "own")
    return out.select("entity", "relation", "horse_id", "name")


@query("progeny_rows", "SELECT s_suppkey AS entity, c_custkey AS horse_id, c_name AS name, CAST(json_extract(to_json({'earn': c_acctbal}), '$.earn') AS DOUBLE) AS earn FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_custkey <> s_suppkey")
def progeny_rows(spark, d):
    owners, members = _families(spark, d)
    offspring = entities.careers(members, ["earn"]).withColumn("earn", F.get_json_object("stats_json", "$.earn").cast("double"))
    return entities.progeny(owners, offspring, "k", "entity", "own").select("entity", "horse_id", "name", "earn")


@query(
    "media_rows",
    """SELECT p_partkey AS entity, 'primary' AS type, p_name AS url FROM part WHERE p_size % 2 = 0 UNION ALL SELECT DISTINCT p_partkey, 'gallery', u FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS u FROM part) UNION ALL SELECT p_partkey, 'father', p_type FROM part""",
)
def media_rows(spark, d):
    rows = load(spark, d, "part").select(
        F.col("p_partkey").alias("entity"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("main"),
        F.array("p_brand", "p_type").alias("gallery"), F.col("p_type").alias("father_image"),
    )
    return entities.media(rows, "entity", "main", "gallery", {"father": "father_image"})


@query(
    "discovery_records",
    "SELECT 'list' AS source, CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_custkey WHEN c_custkey % 3 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE 'R' || c_custkey END AS source_record_id, c_name AS name, CASE WHEN c_custkey % 3 = 1 THEN c_custkey END AS horse_id FROM customer WHERE c_custkey <> 0",
)
def discovery_records(spark, d):
    k = F.col("c_custkey")
    tag = lambda p: F.concat(F.lit(p), k.cast("string"))
    payload = F.to_json(
        F.struct(
            F.when(k % 3 == 0, tag("L")).alias("LIST_ID"), F.when(k % 3 == 1, k).alias("HORSE_ID"), F.when(k % 3 == 2, tag("R")).alias("REGISTRY_ID"),
            F.when(k % 2 == 0, F.col("c_name")).alias("NAME"), F.when(k % 2 == 1, F.col("c_name")).alias("HORSE_NAME"),
        )
    )
    rows = load(spark, d, "customer").filter("c_custkey <> 0").select(payload.alias("payload"))
    return entities.discovery_record(rows, "list").select("source", "source_record_id", "name", "horse_id")


@query("html_rows")
def html_cells(spark, d):
    """Heading, link, list and paragraph cells of every page."""
    cells = html_rows.cells(load(spark, d, "pages"))
    return cells.select("page_id", "cell_no", "tag", "value")


def _result_pages(spark, d):
    """Result pages written as HTML from the given races: one table per race of a day."""
    rows = base.program(spark, d).join(base.results(spark, d).select("race_id", F.col("horse_id").alias("entrant"), "finish_position"), ["race_id", "entrant"])
    cell = lambda c, v: F.concat(F.lit(f'<td class="x-{c}">'), v, F.lit("</td>"))
    tr = F.concat(
        F.lit("<tr>"), cell("SONUCNO", F.coalesce(F.col("finish_position").cast("int").cast("string"), F.lit("Koşmaz"))),
        cell("AtAdi3", F.concat(F.lit("<a>"), F.col("horse_name"), F.lit("<sup>TIP</sup> ("), F.col("entrant").cast("string"), F.lit(")</a>"))),
        cell("Derece", F.lit("1.34.04")), cell("Gny", F.concat(F.lit("<span>"), F.translate(F.coalesce(F.format_string("%.2f", "odds"), F.lit("-")), ".", ","), F.lit("</span>"))),
        cell("AGFORAN", F.concat(F.lit("%"), (F.col("discount") * 100).cast("int").cast("string"), F.lit("(1)"))), F.lit("</tr>"),
    )
    races = rows.groupBy("race_id", "race_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("entrant", tr.alias("h")))).h, "").alias("body"))
    return races.select(
        F.col("race_id").alias("page_id"),
        F.concat(F.lit("<html><h3><a>"), F.col("race_no").cast("string"), F.lit(". Koşu 17.15</a></h3><table><tbody>"), F.col("body"), F.lit("</tbody></table></html>")).alias("html"),
    )


@query(
    "html_result_rows",
    base.SQL + "SELECT r.race_id AS page_id, r.race_no, '17.15' AS race_time, CAST(finish_position AS INTEGER) AS finish_position, 'H' || horse AS horse_name, CAST(entrant AS INTEGER) AS start_no, round(odds, 2) AS odds FROM prog p JOIN res r ON p.race_id = r.race_id AND p.entrant = r.horse_id",
)
def html_result_rows(spark, d):
    out = html_rows.result_rows(html_rows.cells(_result_pages(spark, d)))
    return out.select("page_id", "race_no", "race_time", "finish_position", "horse_name", "start_no", "odds")


@query(
    "html_carry_down",
    """WITH o AS (SELECT o_custkey AS page_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT page_id, CAST(3 AS INTEGER) AS race_no, CAST(rn AS INTEGER) AS horse_no, CAST(rn AS DOUBLE) / 4 AS agf_percent, CAST((rn - 1) // 3 + 1 AS INTEGER) AS agf_rank FROM o""",
)
def html_carry_down(spark, d):
    """Grids whose rank cell spans three rows."""
    o = skew.ranked(load(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], "rn")
    opens = (F.col("rn") - 1) % 3 == 0
    rank = F.floor((F.col("rn") - 1) / 3) + 1
    row = F.concat(
        F.lit("<tr>"), F.when(opens, F.concat(F.lit('<td rowspan="3">'), rank.cast("string"), F.lit("</td>"))).otherwise(""),
        F.lit("<td>"), F.col("rn").cast("string"), F.lit(" (%"), F.translate(F.format_string("%.2f", F.col("rn") / 4), ".", ","), F.lit(")</td></tr>"),
    )
    pages = o.groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rn", row.alias("h")))).h, "").alias("b"))
    html = pages.select("page_id", F.concat(F.lit('<table id="GridView3"><tr><td>AT NO</td></tr>'), "b", F.lit("</table>")).alias("html"))
    return html_rows.grid_rows(html_rows.cells(html)).select("page_id", "race_no", "horse_no", "agf_percent", "agf_rank")


def _reports(spark, d):
    """Conversations read as reports: every turn a section with a heading and its text."""
    turn = F.concat(F.lit("KOŞU NO: "), (F.col("turn") + 1).cast("string"), F.lit("\n    "), F.regexp_replace("text", r"\s+", " "), F.lit(" numara\n\n"))
    rows = load(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("ts"))
    return rows.select(F.col("conv_id").alias("report"), F.array_join(F.col("ts.t"), "").alias("body"))


@query(
    "paragraph_sections",
    "SELECT conv_id AS report, CAST(turn + 1 AS INTEGER) AS section_race_no, md5(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g') || ' numara')) AS digest FROM conversations",
)
def paragraph_sections(spark, d):
    out = report_text.with_section(report_text.paragraphs(_reports(spark, d), "report", "body"), "report")
    return out.select("report", "section_race_no", F.md5("paragraph").alias("digest"))


@query(
    "keyword_flags",
    "WITH t AS (SELECT doc_id, upper(text) AS u FROM documents) SELECT doc_id, contains(u, 'THE') OR contains(u, 'QUE') AS jockey_change_flag, contains(u, 'STRE') AS scratch_flag, CASE WHEN contains(u, 'DER') THEN 'DER' WHEN contains(u, 'AND') THEN 'AND' END AS term FROM t",
)
def keyword_flags(spark, d):
    out = report_text.flags(load(spark, d, "documents").select("doc_id", "text"), "text", {"jockey_change_flag": ["THE", "QUE"], "scratch_flag": ["STRE"]})
    return out.select("doc_id", "jockey_change_flag", "scratch_flag", report_text.first_term(F.upper("text"), ["DER", "AND"]).alias("term"))


INCIDENT_WORDS = ["KOŞMAYACAK", "TOPALLIK", "CEZA", "KULAKLIK", "ANTRENÖR DEĞİŞİKLİĞİ"]


@base.stored
def _incidents(spark, d):
    """Incident paragraphs about entrants of the given races, parsed back from text.

    The equipment code DB also occurs inside names; the flag is a plain substring search.
    """
    words = F.element_at(F.array(*[F.lit(w) for w in INCIDENT_WORDS]), (F.col("entrant") % 5 + 1).cast("int"))
    sentence = F.concat(
        F.col("race_no").cast("string"), F.lit(". koşuda "), F.col("entrant").cast("string"), F.lit(" numarada kayıtlı AT "),
        F.translate(F.col("horse").cast("string"), "0123456789", "ABCDEFGHIJ"), F.lit(" isimli at "), words, F.lit("."),
    )
    rows = base.program(spark, d).filter("horse % 4 = 0").select(
        F.concat_ws("-", F.date_format("race_start_at", "yyyy-MM-dd"), F.col("race_id").cast("string")).alias("file"), "race_id", "entrant",
        F.concat(F.lit("    "), sentence).alias("s"),
    )
    reports = rows.groupBy("file", "race_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("entrant", "s"))).s, "\n").alias("body"))
    events = report_text.incidents(reports.select("file", "body"), "file", "body")
    return events.withColumn("event_day", text.date_from_file_name("file")).withColumnRenamed("horse_name", "name_key")


@query(
    "incident_events",
    base.SQL + """SELECT race_id, CAST(entrant AS INTEGER) AS horse_no, race_no, 'AT ' || translate(CAST(horse AS VARCHAR), '0123456789', 'ABCDEFGHIJ') AS name_key,
  CASE entrant % 5 WHEN 0 THEN 'scratch' WHEN 1 THEN 'medical' WHEN 2 THEN CASE WHEN contains(CAST(horse AS VARCHAR), '31') THEN 'equipment_change' ELSE 'steward_incident' END WHEN 3 THEN 'equipment_change' ELSE 'trainer_change' END AS incident_type FROM prog WHERE horse % 4 = 0""",
)
def incident_events(spark, d):
    return _incidents(spark, d).select(
        F.substring_index("file", "-", -1).cast("bigint").alias("race_id"), "horse_no", "race_no", "name_key", "incident_type"
    )


@query(
    "incident_enrichment",
    base.SQL + """, r AS (SELECT race_id, entrant, horse, CAST(race_start_at AS DATE) AS day FROM prog), e AS (SELECT race_id, horse, day, entrant % 5 AS k FROM r WHERE horse % 4 = 0),
own AS (SELECT race_id, horse, bool_or(k = 4) AS tr, bool_or(k = 3 OR contains(CAST(horse AS VARCHAR), '31')) AS eq, bool_or(k = 1) AS la, bool_or(k = 2) AS st, bool_or(k = 0) AS sc FROM e GROUP BY ALL),
c AS (SELECT r.race_id, r.entrant, count(*) FILTER (e.k = 2 AND e.day >= r.day - 30) AS i30, count(*) FILTER (e.k = 0 AND e.day >= r.day - 30) AS s30, count(*) FILTER (e.k = 1) AS v180, count(*) FILTER (e.k = 2) AS s180
  FROM r LEFT JOIN e ON e.horse = r.horse AND e.day < r.day AND e.day >= r.day - 180 GROUP BY r.race_id, r.entrant)
SELECT r.race_id, r.entrant, CAST(coalesce(tr, false) AS INTEGER) AS had_trainer_change, CAST(coalesce(eq, false) AS INTEGER) AS had_equipment_change, CAST(coalesce(la, false) AS INTEGER) AS had_lameness_issue, CAST(coalesce(st, false) AS INTEGER) AS had_steward_incident,
  CAST(coalesce(sc, false) OR s30 > 0 AS INTEGER) AS had_recent_scratch, i30 AS incident_count_last_30d, v180 AS veterinary_count_last_180d, s180 AS steward_incident_count_last_180d
FROM r JOIN c ON c.race_id = r.race_id AND c.entrant = r.entrant LEFT JOIN own ON own.race_id = r.race_id AND own.horse = r.horse""",
)
def incident_enrichment(spark, d):
    events = _incidents(spark, d).withColumn("matched_race", F.substring_index("file", "-", -1).cast("bigint"))
    rows = base.program(spark, d).select(
        "race_id", "entrant", F.col("race_start_at").cast("date").alias("day"),
        F.concat(F.lit("AT "), F.translate(F.col("horse").cast("string"), "0123456789", "ABCDEFGHIJ")).alias("name_key"),
    )
    out = features.incident_features(rows, events, events)
    return out.select(
        "race_id", "entrant", "had_trainer_change", "had_equipment_change", "had_lameness_issue", "had_steward_incident", "had_recent_scratch",
        "incident_count_last_30d", "veterinary_count_last_180d", "steward_incident_count_last_180d",
    )


@query(
    "condition_text_parse",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'Açık' ELSE 'not_available_checked' END AS weather, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 35 AS VARCHAR) ELSE 'not_available_checked' END AS temperature, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 90 AS VARCHAR) ELSE 'not_available_checked' END AS humidity,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Nemli' ELSE 'Normal' END AS dirt_condition, CASE WHEN o_orderkey % 5 = 0 THEN 'not_available_checked' ELSE 'Ağır' END AS turf_condition, CASE WHEN o_orderkey % 2 = 0 THEN 'Nemli' WHEN o_orderkey % 5 <> 0 THEN 'Ağır' ELSE 'Normal' END AS track_condition FROM orders""",
)
def condition_text_parse(spark, d):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    body = F.concat(
        F.when(k % 3 != 0, F.concat(F.lit("Hava: Açık, "), s(k % 35), F.lit("°C, Nem %"), s(k % 90))).otherwise(""),
        F.when(k % 2 == 0, "| Kum: Nemli").otherwise("| Kum: Normal"), F.when(k % 5 != 0, " | Çim: Ağır").otherwise(""), F.lit("\n"),
    )
    rows = load(spark, d, "orders").select(k.alias("id"), body.alias("body"))
    return conditions.parse(rows, "body").select("id", "weather", "temperature", "humidity", "dirt_condition", "turf_condition", "track_condition")


@query(
    "result_csv_sections",
    base.SQL + "SELECT CAST(p.race_id AS VARCHAR) AS file, p.race_no, '13:30' AS start_hhmm, CAST(entrant AS INTEGER) AS finish_position, 'H' || horse AS horse_name_key, round(odds, 2) AS result_odds FROM prog p WHERE entrant <> 2",
)
def result_csv_sections(spark, d):
    """One sectioned file per race: header, column names, entrant lines, footer."""
    rows = base.program(spark, d)
    line = F.concat_ws(
        ";", F.col("entrant").cast("string"), F.when(F.col("entrant") == 2, F.concat("horse_name", F.lit(" (Koşmaz)"))).otherwise(F.concat("horse_name", F.lit(" KG DB"))),
        *[F.lit("") for _ in range(10)], F.lit("1.34.04"), F.coalesce(F.translate(F.format_string("%.2f", "odds"), ".", ","), F.lit("-")),
    )
    files = rows.groupBy("race_id", "race_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("entrant", line.alias("l")))).l, "\n").alias("b")).select(
        F.col("race_id").cast("string").alias("file"),
        F.concat(F.lit("Ankara;x\n"), F.col("race_no").cast("string"), F.lit(". Kosu :   13.30;a\nAt No;At İsmi;\n"), "b", F.lit("\nGanyan;1;2\n9;After footer\n")).alias("body"),
    )
    return result_csv.parse(files).select("file", "race_no", "start_hhmm", "finish_position", "horse_name_key", "result_odds")


@query(
    "result_csv_encodings",
    base.SQL + """SELECT race_id // 1000 AS file, CASE WHEN race_id // 1000 % 3 = 2 THEN 'cp1254' ELSE 'utf-8' END AS encoding,
3 * dense_rank() OVER (PARTITION BY race_id // 1000 ORDER BY race_id) + row_number() OVER (PARTITION BY race_id // 1000 ORDER BY race_id, entrant) - 1 AS line_no,
CAST(race_id AS INTEGER) AS race_no, '13:30' AS start_hhmm, 'Ankara' AS track_raw, CAST(entrant AS INTEGER) AS finish_position, 'ŞĞİ ' || horse AS horse_name_raw
FROM prog""",
)
def result_csv_encodings(spark, d):
    """Files of up to a thousand races, with and without a byte-order mark and in the Turkish code page."""
    rows = base.program(spark, d).withColumn("file", F.expr("race_id div 1000"))
    line = lambda part, entrant, value: ("file", "race_id", F.lit(part).alias("part"), entrant.alias("entrant"), value.alias("line"))
    none = F.lit(0).cast("long")
    races = rows.select("file", "race_id").distinct()
    text_lines = rows.select(*line(2, F.col("entrant").cast("long"), F.concat_ws(";", "entrant", F.concat(F.lit("ŞĞİ "), "horse")))).unionByName(
        races.select(*line(0, none, F.concat("race_id", F.lit(". Kosu : 13.30;a"))))
    ).unionByName(races.select(*line(1, none, F.lit("At No;At İsmi;")))).unionByName(races.select(*line(3, none, F.lit("Ganyan;1;2"))))
    mark = F.when(F.col("file") % 3 == 0, "\ufeff").otherwise("")
    heads = rows.select("file").distinct().withColumn("race_id", F.lit(-1).cast("long")).select(*line(0, none, F.concat(mark, F.lit("Ankara;x"))))
    stored = F.when(F.col("file") % 3 == 2, text.encode_cp1254("line").cast("string")).otherwise(F.col("line"))
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/result-lines-{uuid.uuid4().hex}"
    ordered = text_lines.unionByName(heads).repartition("file").sortWithinPartitions("file", "race_id", "part", "entrant")
    ordered.select("file", stored.alias("value")).write.partitionBy("file").text(path)
    out = result_csv.read(spark, path)
    return out.select(
        F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file"), "encoding", "line_no", "race_no", "start_hhmm",
        "track_raw", "finish_position", "horse_name_raw",
    )


@query(
    "cell_typing",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 3 END AS race_no, CAST(p_size AS VARCHAR) AS horse_no, p_name AS horse_name, p_brand AS old_name, p_type AS reason, 'JOCKEY_CHANGE' AS kind FROM part",
)
def cell_typing(spark, d):
    cells = F.array(F.when(F.col("p_partkey") % 2 == 0, "3"), F.col("p_size").cast("string"), F.lit(""), F.col("p_name"), F.col("p_brand"), F.concat(F.lit("  "), "p_type"))
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("id"), cells.alias("cells"))
    typed = report_text.type_cells(rows, "cells")
    return typed.select(
        "id", "race_no", "horse_no", "horse_name", "old_name", "reason", report_text.table_type(F.concat(F.lit("jokey "), F.array_join("words", " "))).alias("kind")
    )


@query(
    "cell_lookup",
    "SELECT o_custkey AS id, CAST(o_orderkey % 50 AS VARCHAR) AS horse_no, 'NAME' AS prefix, max(CAST(o_orderkey % 9 AS INTEGER)) AS race_no FROM orders GROUP BY ALL",
)
def cell_lookup(spark, d):
    line = F.concat_ws(" ", (F.col("o_orderkey") % 9).cast("string"), (F.col("o_orderkey") % 50).cast("string"), F.lit("Name"))
    merged = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.concat(F.lit("title\n"), F.array_join(F.collect_list(line), "\n")).alias("cell"))
    return report_text.race_numbers_from_merged(merged, "id", "cell")


@query("scan_csv_optional", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS comment FROM nation")
def scan_csv_optional(spark, d):
    path = f"{shared_dir(spark)}/csv-{spark.sparkContext.applicationId}/{abs(hash(d))}"
    load(spark, d, "nation").write.mode("overwrite").option("header", True).csv(path)
    rows = scans.read_csv(spark, path, columns=["n_nationkey", "n_name", "comment"])
    return rows.withColumn("n_nationkey", F.col("n_nationkey").cast("int"))


@query("scan_new_files_only", "SELECT count(*) AS n FROM supplier")
def scan_new_files_only(spark, d):
    path = f"{shared_dir(spark)}/files-{spark.sparkContext.applicationId}/{abs(hash(d))}"
    load(spark, d, "customer").coalesce(1).write.mode("overwrite").parquet(path)
    done = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file_name")).distinct().collect()  # one name per file
    load(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")).write.mode("append").parquet(path)
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    processed = spark.createDataFrame([(r.file_name,) for r in done], "file_name string")
    return scans.new_files(rows, processed).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rejected_rows",
    "SELECT 'orders' AS script, CAST(o_orderkey AS VARCHAR) AS entity, 'price_too_low' AS error_type FROM orders WHERE NOT o_totalprice > 5000 UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), 'open' FROM orders WHERE o_orderstatus = 'P'",
)
def rejected_rows(spark, d):
    _, bad = scans.rejects(
        load(spark, d, "orders"), {"price_too_low": F.col("o_totalprice") > 5000, "open": F.col("o_orderstatus") != "P"}, "orders", "o_orderkey"
    )
    return bad
