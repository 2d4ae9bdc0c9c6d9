"""Operator 5, sharding: rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.storage import stored


def _draw(key: Sequence[str | Column], shard: int) -> Column:
    """A number in (0, 1) that key and shard decide."""
    return (F.pmod(F.xxhash64(*key, F.lit(shard)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def rendezvous(key: Sequence[str | Column], weights: Sequence[float]) -> Column:
    """The shard 0 .. len(weights)-1 of each key: the shard with the least -ln(draw) / weight.

    A shard of twice the weight gets twice the keys. A shard that is added, or whose weight
    grows, only takes keys into itself; one that is removed only gives its own keys away.
    Weights are positive, or 0 for a shard that takes none. A null in a key hashes like any
    value: rows with equal keys, nulls included, share a shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    scores = [
        F.struct((-F.ln(_draw(key, i)) / float(w)).alias("s"), F.lit(i).alias("i"))
        for i, w in enumerate(weights)
        if w > 0
    ]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["i"]


def number_within(df: DataFrame, group: str, slot: str) -> DataFrame:
    """Add gapless numbers from 0 within each group, however large the group.

    Rows are stored with the number of the task that wrote them; counts per (group, task) give
    each task its offset, so no group is sorted or gathered in one place. The numbers follow the
    stored order; they are not a function of the row."""
    base = stored(df.withColumn("_at", F.monotonically_increasing_id()), "slots")
    base = base.withColumn("_task", F.shiftright("_at", 33))
    counts = base.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(group).alias("_g"), F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(group, "_task").orderBy("_at"))
    numbered = base.withColumn("_rank", rank)
    joined = numbered.join(offsets, numbered[group].eqNullSafe(offsets["_g"]) & (numbered["_task"] == offsets["_t"]))
    return joined.withColumn(slot, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_at", "_task", "_n", "_g", "_t", "_before", "_rank")


def shard(df: DataFrame, key: Sequence[str], weights: Sequence[float], name: str = "shard", slot: str = "slot") -> DataFrame:
    """Deal rows to weighted shards by their key, and number them in each shard.

    Rows with the same key stay together, also a hot key that holds much of the table; nothing
    but the key and the weights decides the shard. An empty table gives an empty table. Columns
    named like the new ones are replaced."""
    return number_within(df.withColumn(name, rendezvous(key, weights)), name, slot)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards by doc_id; and where each goes with a 25th shard."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"), rendezvous(["doc_id"], [1.0] * 25).alias("grown_shard"),
    )
    return shard(docs, ["doc_id"], [1.0] * 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op5_sharding": op5_sharding}
