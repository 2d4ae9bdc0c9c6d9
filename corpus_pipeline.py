"""The corpus pipeline: documents in, packed training sequences out. Part of subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import decontamination, jaccard, langid, packing, repeats
from furlong.llm.storage import ship, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter go."""
    ship(spark)
    return langid.predict(docs, langid.fit(docs)).where(F.col("lang_pred") != "und").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    ship(spark)
    return jaccard.keep_first(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes and more that also stand elsewhere. A document
    of which nothing is left stays, with an empty text."""
    ship(spark)
    found = repeats.find_repeats(docs.select(*COLUMNS), characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    changed = F.size("removed") > 0
    return found.withColumn("n_chars", F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))).withColumn("text", text).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; without any
    benchmark item all stay."""
    ship(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(docs.select(*COLUMNS), items)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents, cut and packed into sequences; nothing is dropped. A null text
    is empty and gives its end id; a table without rows gives none."""
    import public_tokenizers

    ship(spark)
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    return packing.pack_with_ids(pieces).select("doc_id", "piece", "start", "length", "sequence_id", "offset", "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]
#: SQL can express none of the stages but the near duplicates; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two of them the rows are a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
