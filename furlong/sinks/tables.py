"""Writes onto Parquet tables: append-ignore, upserts, partition replace, rebuild, sync.

A table path has one writer at a time. Full rewrites go to a new folder beside the table and are
swapped in by rename, so a failed write never leaves a half table behind. Tables with keys are
laid out in parts, each a folder, by the key alone; a batch reads and replaces only the parts
that its keys fall into.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import latest


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, Path = _fs(spark, path)
    return fs.exists(Path(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table without the column that names the part of a keyed one."""
    return spark.read.parquet(path).drop(PART)


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    return read(spark, path) if exists(spark, path) else None


def swap_in(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write to a sibling folder, then rename it over the table."""
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh)
    fs, Path = _fs(spark, path)
    had = fs.exists(Path(path))
    if had:
        fs.rename(Path(path), Path(old))
    fs.rename(Path(fresh), Path(path))
    if had:
        fs.delete(Path(old), True)


def new_rows(new: DataFrame, existing: DataFrame | None, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows whose key is in neither the table nor an earlier row of the batch."""
    first = latest.latest_by(new, keys, order) if order else new.dropDuplicates(keys)
    return first if existing is None else first.join(existing.select(*keys), keys, "left_anti")


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of the same key; other rows stay."""
    kept = existing.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def coalesced(
    existing: DataFrame, new: DataFrame, keys: list[str],
    keep_new: list[str] | None = None, keep_first: list[str] | None = None,
) -> DataFrame:
    """Upsert with a rule per column: ``keep_new`` takes the new value unless it is NULL,
    ``keep_first`` never replaces a known value, all others take the new value as it is."""
    keep_new, keep_first = keep_new or [], keep_first or []
    columns = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*columns).alias("_old"))
    fresh = new.select(*keys, F.struct(*columns).alias("_new"))
    both = old.join(fresh, keys, "full")

    def value(c: str) -> Column:
        o, n = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        if c in keep_new:
            return F.coalesce(n, o)
        if c in keep_first:
            return F.coalesce(o, n)
        return F.when(F.col("_new").isNotNull(), n).otherwise(o)

    return both.select(*keys, *[value(c).alias(c) for c in columns])


def replaced(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Latest row per key over both sides, by ``order``."""
    return latest.latest_by(existing.unionByName(new, allowMissingColumns=True), keys, order)


#: Parts of a table whose caller names none. A table keeps the number it was made with.
PARTS = 16
PART = "_part_of_key"


class KeyedTable:
    """A table of rows with a key, laid out in parts by the key.

    ``part`` is an expression of key columns only, such as the day in the key, so that a batch of one
    day touches one part; without it the key is hashed into ``parts`` parts. Writes touch no
    file of another part, and rows of a part never meet rows of another one in a join.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], part: Column | None = None, parts: int = PARTS):
        self.spark, self.path, self.keys = spark, path, keys
        self.part = (F.pmod(F.xxhash64(*keys), F.lit(parts)) if part is None else part).cast("string")

    def _stored(self) -> DataFrame | None:
        return self.spark.read.parquet(self.path).withColumn(PART, F.col(PART).cast("string")) if exists(self.spark, self.path) else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(PART)

    def touched(self, new: DataFrame) -> list[str | None]:
        """The parts a batch falls into: one value a part, never one a row."""
        return [r[0] for r in new.select(self.part.alias(PART)).distinct().collect()]

    def rows_of(self, parts: list[str | None]) -> DataFrame | None:
        """The stored rows of some parts; other folders are not listed as inputs of the scan."""
        table = self._stored()
        if table is None:
            return None
        known = [p for p in parts if p is not None]
        inside = F.col(PART).isin(known)
        return table.where(inside | F.col(PART).isNull() if None in parts else inside).drop(PART)

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows = rows.withColumn(PART, self.part)
        # One task a part and writer of the shuffle: few files a part, and a large part is still
        # split by rows if AQE finds it large.
        rows = rows.hint("rebalance", PART)
        writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        writer.partitionBy(PART).parquet(self.path)

    def insert_ignore(self, new: DataFrame, order: list[Column] | None = None) -> None:
        """Append rows with unseen keys; rows already present win. No stored file changes."""
        self._write(new_rows(new, self.rows_of(self.touched(new)), self.keys, order), "append")

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched parts by ``how(stored rows of them, new)``."""
        existing = self.rows_of(self.touched(new))
        self._write(new if existing is None else how(existing, new), "overwrite")


def insert_ignore(new: DataFrame, path: str, keys: list[str], order: list[Column] | None = None, part: Column | None = None) -> None:
    """Append rows with unseen keys; rows already present win."""
    KeyedTable(new.sparkSession, path, keys, part).insert_ignore(new, order)


def upsert(new: DataFrame, path: str, keys: list[str], part: Column | None = None) -> None:
    """New rows replace old rows of the same key; other parts of the table are not read."""
    KeyedTable(new.sparkSession, path, keys, part).merge(new, lambda old, fresh: upserted(old, fresh, keys))


def coalesce_upsert(new: DataFrame, path: str, keys: list[str], keep_new: list[str], keep_first: list[str], part: Column | None = None) -> None:
    KeyedTable(new.sparkSession, path, keys, part).merge(new, lambda old, fresh: coalesced(old, fresh, keys, keep_new, keep_first))


def replace_by_key(new: DataFrame, path: str, keys: list[str], order: list[Column], part: Column | None = None) -> None:
    """Keep one row a key, the first by ``order`` among the stored and the new ones."""
    table = KeyedTable(new.sparkSession, path, keys, part)
    table.merge(latest.latest_by(new, keys, order), lambda old, fresh: replaced(old, fresh, keys, order))


def replace_partitions(new: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions the batch holds (delete the day, then insert)."""
    (
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd").partitionBy(partition).parquet(path)
    )


def rebuild(df: DataFrame, path: str) -> dict[str, int]:
    """Full rebuild of a materialised table; returns row counts before and after."""
    spark = df.sparkSession
    before = read_or_none(spark, path)
    rows_before = before.count() if before is not None else 0
    swap_in(df, path)
    return {"rows_before": rows_before, "rows_after": spark.read.parquet(path).count()}


def sync_missing(source: dict[str, DataFrame], target: dict[str, DataFrame], keys: dict[str, list[str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows each target table lacks, and a count per table."""
    missing = {n: new_rows(source[n], target[n], keys[n]) for n in source}
    counts = None
    for name, df in missing.items():
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("inserted"))
        counts = row if counts is None else counts.unionByName(row)
    return missing, counts


def export(df: DataFrame, path: str) -> None:
    """The same rows as CSV (with header) and as zstd Parquet."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(f"{path}/csv")
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/parquet")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def check_export(spark: SparkSession, path: str, keys: list[str], day: str | None = None, years: list[int] | None = None) -> DataFrame:
    """Compare both copies: rows, columns, unique keys, required years. Raises on a difference."""
    csv = spark.read.option("header", True).csv(f"{path}/csv")
    parquet = spark.read.parquet(f"{path}/parquet")
    if csv.columns != parquet.columns:
        raise ValueError("CSV and Parquet columns differ")
    stats = None
    for kind, df in (("csv", csv), ("parquet", parquet)):
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        row = per_key.agg(
            F.lit(kind).alias("copy"), F.sum("_n").alias("rows"), F.count_if(F.col("_n") > 1).alias("duplicate_keys")
        ).withColumn("columns", F.lit(len(df.columns)))
        stats = row if stats is None else stats.unionByName(row)
    found = {r["copy"]: r for r in stats.collect()}  # two rows
    if found["csv"]["rows"] != found["parquet"]["rows"]:
        raise ValueError("CSV and Parquet row counts differ")
    if found["csv"]["duplicate_keys"]:
        raise ValueError("exported table has duplicate keys")
    if day and years:
        present = {r[0] for r in parquet.select(F.year(day)).distinct().collect()}  # one row per year
        lacking = sorted(set(years) - present)
        if lacking:
            raise ValueError(f"exported table is missing years {lacking}")
    return stats


def write_daily_and_latest(df: DataFrame, path: str, day: str) -> None:
    """A report partition per day and one copy of the newest report."""
    replace_partitions(df, f"{path}/daily", day)
    swap_in(df, f"{path}/latest")
