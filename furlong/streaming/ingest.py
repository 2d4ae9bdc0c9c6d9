"""Streaming forms of snapshot ingest, live state, matching, windows and materialisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.sinks import tables

# Watermark lengths are our choice: longer than the longest capture-to-start gap.
CAPTURE_DELAY = "3 days"


def read_table(spark: SparkSession, directory: str, table: str, files_per_trigger: int = 1) -> DataFrame:
    """A table folder (or one file of it) as a stream; zone-less timestamps become instants."""
    schema = spark.read.parquet(f"{directory}/{table}.parquet").schema
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", f"{table}.parquet").parquet(directory)
    )
    casts = {
        f.name: F.col(f.name).cast("timestamp") for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)
    }
    return stream.withColumns(casts) if casts else stream


def deduplicated(stream: DataFrame, keys: list[str], captured: str, delay: str = CAPTURE_DELAY) -> DataFrame:
    """First arrival per natural key within the watermark."""
    return stream.withWatermark(captured, delay).dropDuplicatesWithinWatermark(keys)


def with_late_flag(stream: DataFrame, captured: str, start: str) -> DataFrame:
    """Captures at or after the start are kept but flagged, never used for features."""
    return stream.withColumn("late", F.col(captured) >= F.col(start))


def latest_state(
    stream: DataFrame, keys: list[str], captured: str, values: list[str], eligible: str = "NOT late",
    span: str = "1 day", delay: str = CAPTURE_DELAY,
) -> DataFrame:
    """Latest eligible value per key and span of event time, as changes (update mode).

    A span's state is dropped once the watermark has passed its end, so state follows the open
    spans, not the keys ever seen. Rows behind the watermark are not taken; see too_late()."""
    window = F.window(captured, span)
    return stream.withWatermark(captured, delay).groupBy(*keys, window.alias("w")).agg(
        F.max_by(F.struct(captured, *values), F.when(F.expr(eligible), F.struct(captured, *values))).alias("latest"),
        F.count_if(~F.expr(eligible)).alias("late_rows"),
    ).select(*keys, F.col("w.start").alias("span_start"), "latest.*", "late_rows")


def matched(
    predictions: DataFrame, results: DataFrame, key: str, predicted_at: str, result_at: str,
    delay: str = CAPTURE_DELAY, within: str = "2 days",
) -> DataFrame:
    """Predictions with the result that follows them: an interval join with watermarks on
    both sides, so state of old predictions is dropped."""
    left = predictions.withWatermark(predicted_at, delay)
    right = results.withColumnRenamed(key, "_key").withWatermark(result_at, delay)
    condition = (
        (F.col(key) == F.col("_key"))
        & (F.col(result_at) > F.col(predicted_at))
        & (F.col(result_at) <= F.col(predicted_at) + F.expr(f"INTERVAL {within}"))
    )
    return left.join(right, condition, "inner").drop("_key")


def windowed_accuracy(stream: DataFrame, time: str, hit: str, size: str, slide: str | None = None, delay: str = CAPTURE_DELAY) -> DataFrame:
    """Counts, hits and accuracy per tumbling or sliding event-time window."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("hits")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "hits", (F.col("hits") / F.col("n")).alias("accuracy"))


def too_late(batch: DataFrame, time: str, newest: Column, delay: str = CAPTURE_DELAY) -> DataFrame:
    """Rows of a batch that state no longer takes: older than the delay before ``newest``, the newest
    time of the batches before. They go to a side table instead of vanishing."""
    return batch.filter(F.col(time) <= newest - F.expr(f"INTERVAL {delay}"))


def with_side_table(
    stream: DataFrame, time: str, path: str, checkpoint: str, delay: str = CAPTURE_DELAY,
) -> DataFrame:
    """Drain what is there and return the rows that a watermark of ``delay`` over the batches so far
    leaves behind. The newest time is one row a batch, kept beside the side table, so a restart goes on."""
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = tables.read_or_none(spark, f"{path}/seen")
        before = None if seen is None else seen.filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        if before is not None:
            late = too_late(batch, time, F.lit(before), delay).withColumn("batch", F.lit(number))
            tables.replace_partitions(late, f"{path}/late", "batch")
        now = batch.agg(F.max(time).alias("newest")).withColumn("batch", F.lit(number))
        tables.replace_partitions(now, f"{path}/seen", "batch")

    run(stream, write, checkpoint)
    spark = stream.sparkSession
    late = tables.read_or_none(spark, f"{path}/late")
    return spark.createDataFrame([], stream.schema) if late is None else late.drop("batch")


def append_batches(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> None:
    """Drain what is there, appending only unseen keys. A replayed batch adds nothing."""
    def write(batch: DataFrame, _: int) -> None:
        tables.insert_ignore(batch, path, keys)

    run(stream, write, checkpoint)


def rebuild_batches(stream: DataFrame, path: str, build: Callable[[DataFrame], DataFrame], keys: list[str], checkpoint: str, part: Column | None = None) -> None:
    """Drain what is there; every batch replaces the rows of the keys it touches, and rewrites only
    the parts of the table they fall into."""
    def write(batch: DataFrame, _: int) -> None:
        tables.upsert(build(batch), path, keys, part)

    run(stream, write, checkpoint)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drain(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None, part: Column | None = None,
) -> DataFrame:
    """Process everything available and return what was written.

    Append mode writes files directly. Update mode hands over the rows that changed, which replace
    those of the same ``keys``; only the parts of the table that hold them are rewritten."""
    spark = stream.sparkSession
    if mode == "append":
        query = (
            stream.writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    if not keys:
        raise ValueError("update mode needs the keys of the result")
    run(stream, lambda batch, _: tables.upsert(batch, path, keys, part), checkpoint, mode)
    return tables.read(spark, path)
