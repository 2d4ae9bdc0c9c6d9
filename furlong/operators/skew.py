"""Ordered and grouped windows that survive a key holding a large share of all rows.

A plain window sends every row of a key to one task. Here a key with more than
``spark.furlong.hotKeyRows`` rows is cut into slices along the window order, each slice is
an own window partition, and what a slice needs from the slices before it is carried over
as a small table. Keys below the limit keep the plain window, and nothing extra is planned
when no key is above it. Results are the same either way.

Sizes: at most MAX_HOT_KEYS keys are cut (the largest ones; every other key then holds less
than 1/MAX_HOT_KEYS of the rows), each into at most SLICES slices, so the tables joined back
have at most MAX_HOT_KEYS rows (broadcast) or MAX_HOT_KEYS * SLICES rows (never hinted).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_HOT_KEYS = 10_000
SLICES = 128
BUCKETS = 65_536
HOT_ROWS_CONF = "spark.furlong.hotKeyRows"
HOT_ROWS_DEFAULT = 2_000_000
CHECK_BYTES_CONF = "spark.furlong.hotKeyCheckBytes"
CHECK_BYTES_DEFAULT = 1 << 30

#: Sets of keys of which the windows being planned are known to have no hot one.
_COLD: ContextVar[tuple[frozenset[str], ...]] = ContextVar("cold", default=())

Order = list[str]  # column names; a leading "-" means descending


def _conf(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def _input_bytes(df: DataFrame) -> int | None:
    """Size of all inputs of the plan (files, cached data), or None if it cannot be told.

    The inputs are summed because a join's own estimate is the product of its sides.
    """
    try:
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except Exception:  # remote sessions expose no plan statistics
        return None


def find_hot(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with too many rows for one task, or None.

    Keys are first counted by BUCKETS hashes, so a task sends that many rows at most: a key has no
    more rows than its hash, and where no hash is above the limit nothing else is counted. Skipped
    when the inputs are so small that a task could hold all of them, or inside of :func:`checked`;
    this decides speed only, never the result.
    """
    if any(known <= set(keys) for known in _COLD.get()):
        return None
    size = _input_bytes(df)
    if size is not None and size < _conf(df, CHECK_BYTES_CONF, CHECK_BYTES_DEFAULT):
        return None
    limit = _conf(df, HOT_ROWS_CONF, HOT_ROWS_DEFAULT)
    by_hash = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_hash")).agg(F.count(F.lit(1)).alias("_rows"))
    most = by_hash.agg(F.max("_rows")).head()[0]
    if most is None or most <= limit:
        return None
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
        .orderBy(F.col("_rows").desc())
        .limit(MAX_HOT_KEYS)
        .drop("_rows")
    )
    return hot if hot.head(1) else None


@contextmanager
def checked(df: DataFrame, keys: list[str]) -> Iterator[None]:
    """Look for hot keys of ``df`` once for all windows inside whose keys contain ``keys``.

    A finer key has no more rows than the key it refines, so a chain of windows over the same rows
    needs one look at its coarsest key instead of one for each window, which would each compute the
    rows again. Where a key is hot, every window looks for itself."""
    cold = find_hot(df, keys) is None
    token = _COLD.set((*_COLD.get(), frozenset(keys)) if cold else _COLD.get())
    try:
        yield
    finally:
        _COLD.reset(token)


def gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows put together by ``keys`` at once, if none is hot: windows of finer keys, and then of
    ``keys`` themselves, would shuffle them twice."""
    return df.repartition(*keys) if find_hot(df, keys) is None else df


@contextmanager
def cold(keys: list[str]) -> Iterator[None]:
    """For windows inside whose keys contain ``keys``, which are known to have no hot one."""
    token = _COLD.set((*_COLD.get(), frozenset(keys)))
    try:
        yield
    finally:
        _COLD.reset(token)


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(renamed[f"_r_{k}"])
    return left.join(renamed, condition, "left").drop(*[f"_r_{k}" for k in keys])


def order_columns(order: Order, reverse: bool = False) -> list[Column]:
    """Ascending puts NULL first, descending puts NULL last."""
    columns = []
    for name in order:
        descending = name.startswith("-")
        column = F.col(name.lstrip("-"))
        columns.append(column.desc() if descending != reverse else column.asc())
    return columns


def _order_number(df: DataFrame, order: Order) -> Column | None:
    """The leading order column as an ascending double, used only to place slice bounds."""
    name = order[0].lstrip("-")
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(name).cast("double")
    elif isinstance(kind, T.DateType):
        value = F.unix_date(name).cast("double")
    elif isinstance(kind, T.NumericType):
        value = F.col(name).cast("double")
    else:
        return None
    if order[0].startswith("-"):
        # NULL sorts last when descending
        return F.coalesce(-value, F.lit(float("inf")))
    return F.coalesce(value, F.lit(float("-inf")))


@dataclass
class Split:
    df: DataFrame
    keys: list[str]
    hot: bool


def split(df: DataFrame, keys: list[str], order: Order) -> Split:
    """Add ``_slice``: -1 for ordinary keys, 0..SLICES-1 along the order for hot ones."""
    hot = find_hot(df, keys)
    number = _order_number(df, order) if hot is not None else None
    if hot is None or number is None:
        return Split(df, keys, False)
    flagged = left_join_null_safe(
        df, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys
    )
    marks = [i / SLICES for i in range(1, SLICES)]
    bounds = (
        flagged.filter("_hot")
        .groupBy(*keys)
        .agg(F.percentile_approx(number, marks, 10_000).alias("_bounds"))
    )
    placed = left_join_null_safe(df, F.broadcast(bounds), keys)
    slice_no = F.when(
        F.col("_bounds").isNotNull(),
        F.size(F.filter("_bounds", lambda b: b < number)),
    ).otherwise(F.lit(-1))
    return Split(placed.withColumn("_slice", slice_no).drop("_bounds"), [*keys, "_slice"], True)


def _with_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str], bool]:
    if keys:
        return df, keys, False
    return df.withColumn("_all", F.lit(0)), ["_all"], True


_LOCAL: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
}


def running(
    df: DataFrame,
    keys: list[str],
    order: Order,
    values: dict[str, tuple[str, Column]],
    include_current: bool = False,
) -> DataFrame:
    """Running aggregates over all earlier rows of the key.

    ``values`` maps an output name to (kind, column), kind being sum, count, max, min or
    last (last non-NULL value). Sums and counts over no row are 0. ``last`` needs an
    ascending order.
    """
    df, keys, added = _with_key(df, keys)
    cut = split(df, keys, order)
    frame = (
        Window.partitionBy(*cut.keys)
        .orderBy(*order_columns(order))
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )

    def local(kind: str, column: Column) -> Column:
        if kind == "last":
            return F.last(column, ignorenulls=True).over(frame)
        result = _LOCAL[kind](column).over(frame)
        return F.coalesce(result, F.lit(0)) if kind in ("sum", "count") else result

    if not cut.hot:
        out = df.withColumns({n: local(k, c) for n, (k, c) in values.items()})
        return out.drop("_all") if added else out

    rows = cut.df.withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    totals = []
    for n, (kind, _) in values.items():
        v = F.col(f"_v_{n}")
        if kind == "last":
            position = F.when(v.isNotNull(), F.struct(*[o.lstrip("-") for o in order]))
            totals.append(F.max_by(v, position).alias(f"_t_{n}"))
        else:
            totals.append(_LOCAL[kind](v).alias(f"_t_{n}"))
    per_slice = rows.filter("_slice >= 0").groupBy(*cut.keys).agg(*totals)
    before = (
        Window.partitionBy(*keys)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry_kind = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    carried = per_slice.select(
        *cut.keys,
        *[
            (
                F.last(f"_t_{n}", ignorenulls=True) if kind == "last"
                else carry_kind[kind](f"_t_{n}")
            ).over(before).alias(f"_c_{n}")
            for n, (kind, _) in values.items()
        ],
    )
    out = rows.withColumns({f"_l_{n}": local(k, F.col(f"_v_{n}")) for n, (k, _) in values.items()})
    out = left_join_null_safe(out, carried, cut.keys)

    def combined(n: str, kind: str) -> Column:
        mine, earlier = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        if kind in ("sum", "count"):
            return mine + F.coalesce(earlier, F.lit(0))
        if kind == "max":
            return F.greatest(mine, earlier)
        if kind == "min":
            return F.least(mine, earlier)
        return F.coalesce(mine, earlier)

    out = out.withColumns({n: combined(n, k) for n, (k, _) in values.items()})
    scratch = [f"_{p}_{n}" for n in values for p in "vlc"]
    return out.drop(*scratch, "_slice", *(["_all"] if added else []))


def bounded(
    df: DataFrame,
    keys: list[str],
    order: Order,
    depth: int,
    exprs: Callable[[WindowSpec], dict[str, Column]],
) -> DataFrame:
    """Window expressions that look back at most ``depth`` rows (lag, last-N means).

    A slice of a hot key borrows the last ``depth`` rows before it, so any ROWS frame
    within that depth sees what it would see in the unsplit window.
    """
    df, keys, added = _with_key(df, keys)
    cut = split(df, keys, order)
    window = Window.partitionBy(*cut.keys).orderBy(*order_columns(order))
    if not cut.hot:
        out = df.withColumns(exprs(window))
        return out.drop("_all") if added else out
    columns = df.columns
    backwards = Window.partitionBy(*cut.keys).orderBy(*order_columns(order, reverse=True))
    tails = (
        cut.df.filter("_slice >= 0")
        .withColumn("_r", F.row_number().over(backwards))
        .filter(F.col("_r") <= depth)
        .groupBy(*cut.keys)
        .agg(
            F.array_sort(
                F.collect_list(F.struct((-F.col("_r")).alias("p"), F.struct(*columns).alias("row")))
            ).alias("_tail")
        )
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-depth, -1)
    joined = F.flatten(F.collect_list("_tail").over(earlier))
    borrowed = (
        tails.withColumn("_joined", joined)
        .withColumn(
            "_joined",
            F.when(F.size("_joined") > depth, F.slice("_joined", -depth, depth)).otherwise(
                F.col("_joined")
            ),
        )
        .select("_slice", F.explode("_joined").alias("_b"))
        .select("_b.row.*", "_slice", F.lit(True).alias("_borrowed"))
    )
    rows = cut.df.select(*columns, "_slice", F.lit(False).alias("_borrowed"))
    out = rows.unionByName(borrowed).withColumns(exprs(window)).filter(~F.col("_borrowed"))
    return out.drop("_slice", "_borrowed", *(["_all"] if added else []))


def ranked(df: DataFrame, keys: list[str], order: Order, name: str = "rank") -> DataFrame:
    """1-based position of each row within its key; ``order`` must end in a tie-break."""
    df, keys, added = _with_key(df, keys)
    if find_hot(df, keys) is None:
        window = Window.partitionBy(*keys).orderBy(*order_columns(order))
        out = df.withColumn(name, F.row_number().over(window))
    else:
        out = running(df, keys, order, {name: ("count", F.lit(1))}, include_current=True)
    return out.drop("_all") if added else out


def group_totals(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Attach per-key aggregates to every row.

    Ordinary keys use one window; hot keys are aggregated with map-side combine and their
    totals (at most MAX_HOT_KEYS rows) are broadcast back, so their rows never move.
    """
    hot = find_hot(df, keys)
    window = Window.partitionBy(*keys)
    if hot is None:
        return df.withColumns({n: c.over(window) for n, c in totals.items()})
    flagged = left_join_null_safe(
        df, F.broadcast(hot.withColumn("_hot", F.lit(True))), keys
    ).withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    cold = flagged.filter(~F.col("_hot")).withColumns(
        {n: c.over(window) for n, c in totals.items()}
    )
    hot_rows = flagged.filter("_hot")
    summed = hot_rows.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
    joined = left_join_null_safe(hot_rows, F.broadcast(summed), keys)
    return cold.unionByName(joined).drop("_hot")
