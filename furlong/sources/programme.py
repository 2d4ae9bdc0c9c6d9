"""Nested programme captures (city -> race tab -> entrants) to snapshot rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.functions import dates, jsonx, numbers, text

PROGRAMME_JSON = (
    "array<struct<CITY_ID:bigint,CITY_NAME:string,SUB_TAB:array<struct<"
    "RACE_TAB_ID:bigint,RACE_NO:string,RACE_TAB_NAME:string,TITLE:string,PROGRAM_LIST:array<struct<"
    "REGISTRY_ID:string,HORSE_NAME:string,HORSE_INFO:struct<HORSE_ID:string>,START:string,WEIGHT:string,"
    "JOCKEY:string,COACH:string,HANDICAP:string,AGF:string,GNY:string>>>>>>"
)


def entries(
    captures: DataFrame, payload: str = "payload", day: str = "program_date",
    captured: str = "captured_at", request: str = "source_request_id", schema: str = PROGRAMME_JSON,
) -> DataFrame:
    """One row per entrant of every capture, with derived race and entrant keys.

    Entrants of tabs without a clock time have a NULL start; they are kept here so that they
    can be counted, and dropped by :func:`program_snapshots`.
    """
    cities = captures.select(
        F.col(captured).alias("captured_at"), F.col(request).alias("source_request_id"),
        dates.parse_date(F.col(day).cast("string")).alias("_day"),
        F.explode(F.from_json(payload, schema)).alias("c"),
    )
    tabs = cities.select("captured_at", "source_request_id", "_day", "c.CITY_ID", "c.CITY_NAME", F.explode("c.SUB_TAB").alias("t"))
    rows = tabs.select("*", F.explode("t.PROGRAM_LIST").alias("e"))
    label = F.concat_ws(" ", "t.RACE_NO", "t.RACE_TAB_NAME")
    title = F.nullif(text.squeeze(F.col("t.TITLE")), F.lit(""))
    folded = text.fold(title)
    surface = (
        F.when(folded.contains("SENTETIK"), "S:").when(folded.contains("CIM"), "Ç:").when(folded.contains("KUM"), "K:")
    )
    return rows.select(
        F.concat_ws(
            "_", F.lit("prog"), F.date_format("_day", "yyyy-MM-dd"), F.col("CITY_ID").cast("string"),
            F.col("t.RACE_TAB_ID").cast("string"),
        ).alias("race_id"),
        jsonx.entity_key(F.col("e.HORSE_INFO.HORSE_ID"), F.col("e.REGISTRY_ID"), F.col("e.HORSE_NAME")).alias("horse_id"),
        dates.start_from_label(F.col("_day"), label).alias("race_start_at"),
        F.coalesce(
            numbers.race_number(F.nullif(F.col("t.RACE_NO"), F.lit(""))),
            F.when(F.coalesce(F.col("t.RACE_NO"), F.lit("")) == "", numbers.race_number(F.col("t.RACE_TAB_NAME"))),
        ).alias("race_no"),
        "captured_at", "source_request_id",
        numbers.leading_number("e.START").alias("draw"),
        numbers.leading_number("e.WEIGHT").alias("carried_weight"),
        F.col("e.JOCKEY").alias("jockey"), F.col("e.COACH").alias("trainer"),
        numbers.leading_number("e.HANDICAP").alias("handicap_rating"),
        title.alias("race_class"), F.col("CITY_NAME").alias("track"), surface.alias("surface"),
        numbers.title_distance(title).alias("distance"),
        F.nullif(F.trim(F.regexp_extract("e.HORSE_NAME", r"^([^\r\n]*)", 1)), F.lit("")).alias("horse_name"),
        numbers.crowd_percent("e.AGF").alias("agf_percent"), numbers.crowd_rank("e.AGF").alias("agf_rank"),
        numbers.leading_number("e.GNY").alias("odds"),
    )


UNIQUE = ["source_request_id", "race_id", "horse_id"]


def program_snapshots(rows: DataFrame) -> DataFrame:
    return rows.filter("race_start_at IS NOT NULL").drop("agf_percent", "agf_rank", "odds").dropDuplicates(UNIQUE)


def agf_snapshots(rows: DataFrame) -> DataFrame:
    known = rows.filter("race_start_at IS NOT NULL AND (agf_percent IS NOT NULL OR agf_rank IS NOT NULL)")
    return known.select(*UNIQUE, "captured_at", "agf_percent", "agf_rank").dropDuplicates(UNIQUE)


def odds_snapshots(rows: DataFrame) -> DataFrame:
    return rows.filter("race_start_at IS NOT NULL AND odds IS NOT NULL").select(
        *UNIQUE, "captured_at", "odds"
    ).dropDuplicates(UNIQUE)


def capture_counts(rows: DataFrame) -> DataFrame:
    """Rows per table and entrants without a start, per capture, in one pass."""
    started = F.col("race_start_at").isNotNull()
    return rows.groupBy("source_request_id").agg(
        F.count_if(started).alias("program"),
        F.count_if(started & (F.col("agf_percent").isNotNull() | F.col("agf_rank").isNotNull())).alias("agf"),
        F.count_if(started & F.col("odds").isNotNull()).alias("odds"),
        F.count_if(~started).alias("missing_start"),
    )


def from_raw_responses(raw: DataFrame) -> DataFrame:
    """Rebuild entries from stored responses, using only the real fetch time.

    ``raw``: request_key, program_date, fetched_at, response_json; the payload may sit in an
    envelope.
    """
    enveloped = F.get_json_object("response_json", "$.m_cData")
    body = F.when(F.trim("response_json").startswith("{"), enveloped).otherwise(F.col("response_json"))
    usable = raw.withColumn("payload", body).filter(
        F.col("program_date").isNotNull() & F.col("fetched_at").isNotNull() & F.trim("payload").startswith("[")
    )
    return entries(usable, captured="fetched_at", request="request_key")
