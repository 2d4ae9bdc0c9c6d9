"""Lines of text files as bytes, decoded by the first encoding that fits the whole file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.functions import text


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``file``, ``block``, ``place`` and the bytes of each line as ``raw``.

    The text source hands bytes through unchanged and cuts large files into blocks, so a file is
    never in one row or one task. Lines end with CR, LF or both, whatever the encoding. ``place``
    grows inside a block; equal reads of the same files give equal places.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("raw"),
    )


def file_facts(lines: DataFrame) -> DataFrame:
    """One row per block: where its line numbers start, and the encoding of its whole file.

    A file is ``utf-8`` when all its lines are, else ``cp1254`` when no byte of it is undefined
    there, else ``latin-1``, which takes every byte. Blocks are counted with map-side combine;
    the windows see one row per block.
    """
    blocks = lines.groupBy("path", "block").agg(
        F.count(F.lit(1)).alias("_n"), F.min("place").alias("_first"),
        F.bool_and(F.is_valid_utf8(F.col("raw").cast("string"))).alias("_utf8"),
        F.bool_and(text.is_cp1254("raw")).alias("_turkish"),
    )
    whole = Window.partitionBy("path")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        "path", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.when(F.bool_and("_utf8").over(whole), "utf-8").when(F.bool_and("_turkish").over(whole), "cp1254").otherwise("latin-1").alias("encoding"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``file``, ``encoding``, ``line_no`` (from 0 in each file) and ``line`` of every line.

    A byte-order mark at the start of a UTF-8 file is dropped. An empty file has no lines.
    """
    lines = raw_lines(spark, path)
    facts = file_facts(lines.select("path", "block", "place", "raw"))
    numbered = lines.join(facts, ["path", "block"]).withColumn("line_no", F.col("_before") + F.col("place") - F.col("_first"))
    line = text.decode_as("raw", "encoding")
    first = (F.col("line_no") == 0) & (F.col("encoding") == "utf-8")
    return numbered.select(
        "path", "file", "encoding", "line_no", F.when(first, F.regexp_replace(line, "^\ufeff", "")).otherwise(line).alias("line")
    )
