"""Session settings and table loading shared by the operators and the queries."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Session-level settings only: they can be changed on a running session.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "false",
    # Rows laid out by race also meet in joins on (race, entrant) without a shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A bucketed table written from another one gets one file a bucket.
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


# Schemas already read from file footers in this process.
_SCHEMAS: dict[str, T.StructType] = {}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """Read one table; zone-less timestamps become UTC instants.

    The cast sits on top of the scan, so column pruning still reaches Parquet; filters on
    the cast column are rewritten by Catalyst only for literals, hence callers filter early.
    """
    configure(spark)
    path = f"{directory.rstrip('/')}/{table}.parquet"
    if path in _SCHEMAS:
        df = spark.read.schema(_SCHEMAS[path]).parquet(path)
    else:
        df = spark.read.parquet(path)
        _SCHEMAS[path] = df.schema
    casts = {
        f.name: F.col(f.name).cast("timestamp")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def naive(df: DataFrame) -> DataFrame:
    """Turn UTC instants back into zone-less timestamps at the edge of a query."""
    casts = {
        f.name: F.col(f.name).cast("timestamp_ntz")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampType)
    }
    return df.withColumns(casts) if casts else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by the cluster in spark.checkpoint.dir.

    A machine-local folder is used only where the session names none (local tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="furlong-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_WRITTEN: set[str] = set()


def written(spark: SparkSession, name: str, build, bucket: str | None = None, buckets: int = 0) -> DataFrame:
    """A derived table, written once per application into the shared folder and then read.

    Queries that start from the same derived table share it instead of recomputing it, and a
    lost executor costs a file read, not the lineage. With ``buckets`` the files are bucketed by
    the column ``bucket``: joins, windows and groups on it (and on keys that contain it) read them
    without a shuffle.
    """
    from furlong.sinks.tables import exists

    application = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/{application}/{name}"
    table = re.sub(r"\W", "_", f"furlong_{application}_{name}").lower()
    if path not in _WRITTEN or not exists(spark, f"{path}/_SUCCESS"):
        df = build()
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if buckets and bucket in df.columns:
            writer.bucketBy(buckets, bucket).option("path", path).saveAsTable(table)
        else:
            writer.parquet(path)
        _SCHEMAS[path] = df.schema
        _WRITTEN.add(path)
    return spark.table(table) if buckets and bucket in _SCHEMAS[path].names else spark.read.schema(_SCHEMAS[path]).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder, so a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
