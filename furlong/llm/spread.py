"""Numbers and aggregates for the rows of a key, without bringing a key's rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm.storage import stored

#: Tasks over which the rows of one key are dealt when an aggregate is put beside them.
SALTS = 32
#: Numbered rows that look something up together.
BLOCK = 1024
_INDEX = (1 << 33) - 1


def salt(*by: str | Column) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts_in(*by: str | Column) -> Column:
    """An aggregate: which salts the rows of a key have, as a bit mask."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt(*by)))


def salted(per_key: DataFrame, mask: str = "_salts", name: str = "_salt") -> DataFrame:
    """One row for each key and each of its salts."""
    each = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("shiftright", F.col(mask), s).bitwiseAND(F.lit(1)) == 1)
    return per_key.withColumn(name, F.explode(each)).drop(mask)


def attach(rows: DataFrame, keys: list[str], by: list[str], having: Column | None = None, how: str = "inner", **aggregates: Column) -> DataFrame:
    """Rows with aggregates of their key beside them; `by` are the columns that tell the rows of a
    key apart. having: a condition on the aggregates; keys without it are dropped, or get null
    aggregates (how="left"). Aggregates are combined before the shuffle, and a key's rows are dealt
    over SALTS tasks, so a key that most rows have is nobody's burden. Keys are never null."""
    per_key = rows.groupBy(*keys).agg(salts_in(*by).alias("_salts"), *[c.alias(n) for n, c in aggregates.items()])
    per_key = salted(per_key if having is None else per_key.where(having))
    return rows.withColumn("_salt", salt(*by)).join(per_key, [*keys, "_salt"], how).drop("_salt")


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Rows joined with a table of one row for each key, dealt like in attach(): only entries that are
    asked for are repeated, once for each salt that asks."""
    asked = rows.groupBy(*keys).agg(salts_in(*by).alias("_salts")).join(table, keys)
    return rows.withColumn("_salt", salt(*by)).join(salted(asked), [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, order: list[str], number: str = "g", name: str = "numbered") -> DataFrame:
    """Rows, stored in order, with gapless numbers from 0. Nulls come first; ties in all of `order`
    take any order. Rows are dealt by range over all columns of the order and then by their place in
    the input, so neither a hot key nor a third of equal rows lands in one task."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    base = df.withColumn("_place", F.monotonically_increasing_id())
    base = base.repartitionByRange(*keys, F.col("_place")).sortWithinPartitions(*keys, F.col("_place")).drop("_place")
    base = stored(base.withColumn("_at", F.monotonically_increasing_id()), name)
    task = F.shiftright("_at", 33)
    # One row for each task of the sort, not for each key.
    counts = base.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_task", before.alias("_before")))
    placed = base.withColumn("_task", task).join(offsets, "_task")
    return placed.withColumn(number, (F.col("_before") + F.col("_at").bitwiseAND(F.lit(_INDEX))).cast("long")).drop("_task", "_before", "_at")


def blocks(low: str | Column, high: str | Column) -> Column:
    """Explodes a range of numbers, both ends included, into the blocks that it meets."""
    return F.explode(F.sequence(block(low), block(high)))


def block(number: str | Column) -> Column:
    number = F.col(number) if isinstance(number, str) else number
    return F.floor(number / BLOCK).cast("long")
