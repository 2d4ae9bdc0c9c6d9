"""Sectioned result files: race headers, column headers, entrant rows, footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions import numbers, text
from furlong.operators import skew
from furlong.sources import lines

HEADER = r"(?iu)^(\d+)\.\s*Kosu\s*:\s*(?:[A-ZÇŞĞÜÖİa-zçşğüöı\s]+\s+)?(\d{1,2})[.:h](\d{2})"
COLUMNS = r"At No.*At İsmi"
NOT_RUN = r"(?iu)koşmaz|kosmaz"


def read(spark: SparkSession, path: str) -> DataFrame:
    """Finishers of all files under ``path``, each file in the encoding that fits it."""
    return parse_lines(lines.read_lines(spark, path), "path", ["encoding"])


def parse(files: DataFrame, file: str = "file", body: str = "body") -> DataFrame:
    """One row per finisher of every race of every stored body."""
    split = files.select(file, F.posexplode(F.split(body, r"\r?\n")).alias("line_no", "line"))
    return parse_lines(split, file)


def parse_lines(split: DataFrame, file: str, also: list[str] | None = None) -> DataFrame:
    """One row per finisher from numbered lines, with the columns ``also`` of its line.

    A line's state is carried, not looped: the latest race header gives the race, and an
    entrant row counts only while every line since the column header is an entrant row.
    """
    split = split.withColumn("line", F.trim("line"))
    part = lambda i: F.nullif(F.regexp_extract("line", HEADER, i), F.lit(""))
    cells = F.transform(F.split("line", ";"), lambda c: F.trim(c))
    is_header = F.col("line").rlike(HEADER)
    is_columns = F.col("line").rlike(COLUMNS)
    is_entrant = F.element_at(cells, 1).rlike(r"^\d{1,2}$")
    typed = split.withColumns(
        {
            "_race": F.when(
                is_header,
                F.struct(
                    part(1).cast("int").alias("race_no"),
                    F.concat(F.lpad(part(2), 2, "0"), F.lit(":"), part(3)).alias("start_hhmm"),
                ),
            ),
            "_open": F.when(is_columns & ~is_header, True).when(is_header | ~is_entrant, False),
            "_track": F.when(F.col("line_no") == 0, F.trim(F.split("line", ";")[0])),
            "_cells": F.when(is_entrant & ~is_header & ~is_columns, cells),
        }
    )
    carried = skew.running(
        typed, [file], ["line_no"],
        {
            "_r": ("last", F.col("_race")), "_in": ("last", F.col("_open")), "_t": ("last", F.col("_track")),
        },
    )
    at = lambda i: F.try_element_at("_cells", F.lit(i))
    rows = carried.filter("_cells IS NOT NULL AND _in AND _r IS NOT NULL")
    out = rows.select(
        file, *(also or []), "line_no", F.col("_r.race_no").alias("race_no"), F.col("_r.start_hhmm").alias("start_hhmm"),
        F.col("_t").alias("track_raw"), at(1).cast("int").alias("finish_position"),
        F.coalesce(at(2), F.lit("")).alias("horse_name_raw"), at(13).alias("race_time"),
        numbers.odds_in_text(at(14)).alias("result_odds"),
    )
    return out.filter(~F.col("horse_name_raw").rlike(NOT_RUN)).withColumn(
        "horse_name_key", text.name_key("horse_name_raw")
    )
