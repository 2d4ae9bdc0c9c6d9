"""Tables that an operator writes into the shared folder of the cluster and reads again."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster in spark.checkpoint.dir.
    A local session that names none (tests) gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-", dir="/tmp"))
    return spark.conf.get("spark.checkpoint.dir")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table into the shared folder and read it back: a cut in the lineage that
    survives lost executors."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return memory that this Python process no longer uses to the system. Workers live on from
    stage to stage, and what they keep counts against their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Prepare a session: make this package importable in the Python workers, once per application,
    also where it is not installed on them, and bound their batches."""
    # Texts are long: a batch of this many rows keeps workers and their channels small.
    if spark.conf.get(BATCH_ROWS[0]) == "10000":
        spark.conf.set(*BATCH_ROWS)
    context = spark.sparkContext
    if _shipped.get("to") == context.applicationId:
        return
    top = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="llm-ship-")) / f"{top.name}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, f"{top.name}/{source.relative_to(top)}")
    context.addPyFile(str(archive))
    _shipped["to"] = context.applicationId


_shipped: dict[str, str] = {}
#: Set where the session has Spark's own default.
BATCH_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
