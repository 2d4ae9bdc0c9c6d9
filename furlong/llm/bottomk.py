"""Operator 11, near duplicates by bottom-k sketches.

One hash function orders all shingles; the KEPT least of a set are its sketch. Linked sets share most
of their sketches, but with chance MISS (1e-12 a pair), so a document probes only as many of its
rarest values as leave no room for the overlap it needs, and a value that few need stays out of the
lists although most documents have it. The sketch of a union is the least values of both sketches;
the share of it that both hold estimates the Jaccard similarity, and a pair is dropped where the
estimate is out of reach of a linked pair but with chance MISS. What is left is counted exactly on the
full sets.

Only components are wanted. So members of a list are first compared with one document of it, the one
they share most values with, in two rounds; lists that then still join several components make up
families, whose sketches and then sets are compared in blocks, as matrices. A pair never becomes a row
there unless it is linked.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm import exchange
from furlong.llm.components import components
from furlong.llm.exchange import Block
from furlong.llm.jaccard import shingle_sets
from furlong.llm.sidetable import SideTable, side_table
from furlong.llm.spans import column_bytes, mix
from furlong.llm.spread import attach, look_up
from furlong.llm.storage import stored

SHINGLE, NUMERATOR, DENOMINATOR = 4, 80, 100
#: Values of a sketch, and the chance of losing a linked pair.
KEPT, MISS = 64, 1e-12
#: Text of a block of a scan in bytes.
BLOCK_BYTES = 4 << 20
#: Rounds of comparing with one document of a list.
ROUNDS = 2
#: Sets and bytes of a block, and tokens of a matrix, when what is left is compared.
BLOCK_SETS, SET_BYTES, COLUMNS = 512, 4 << 20, 4096
#: Pairs of sketches that are compared at once.
PAIRS = 4096


@lru_cache(1024)
def least_shared(draws: int, numerator: int, denominator: int, miss: float = MISS) -> int:
    """The most values that linked sets share of so many of their union's, but with chance `miss`."""
    p, below = numerator / denominator, 0.0
    for m in range(draws + 1):
        below += math.comb(draws, m) * p**m * (1 - p) ** (draws - m)
        if below > miss:
            return m
    return draws


def needed(kept: int, numerator: int, denominator: int, size: int = KEPT) -> int:
    """Values that a sketch of `kept` shares with that of any linked set: exactly where both sketches
    are the sets themselves, else but with chance MISS."""
    if kept * denominator <= size * numerator:
        return -(-kept * numerator // denominator)
    return least_shared(-(-size * numerator // denominator), numerator, denominator)


def may_link(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int, size: int = KEPT) -> bool:
    """Whether the sketch of the union leaves room for a link. x, y: sorted sets."""
    union = np.union1d(x[:size], y[:size])[:size]
    both = int((np.isin(union, x[:size], assume_unique=True) & np.isin(union, y[:size], assume_unique=True)).sum())
    if len(x) <= size and len(y) <= size and len(union) < size:
        return denominator * both >= numerator * len(union)
    return both >= least_shared(len(union), numerator, denominator)


def may_link_pairs(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray, numerator: int, denominator: int, size: int = KEPT) -> np.ndarray:
    """may_link() of the sketches left[i] and right[j], many pairs at once."""
    sets = left + right
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    lengths = np.array([len(s) for s in sets])
    codes = np.full((len(sets), size), len(tokens), np.int32)  # in the order of the values; what is left of a row is none
    codes[np.arange(size) < lengths[:, None]] = place
    out = np.zeros(len(i), bool)
    for low in range(0, len(i), PAIRS):
        some = slice(low, low + PAIRS)
        both = np.concatenate([codes[i[some]], codes[len(left) + j[some]]], axis=1)
        both.sort(axis=1)
        again = np.zeros(both.shape, bool)
        again[:, 1:] = both[:, 1:] == both[:, :-1]
        real = both < len(tokens)
        rank = np.cumsum(real & ~again, axis=1)
        shared = (real & again & (rank <= size)).sum(axis=1)
        union = np.minimum(rank[:, -1], size)
        out[some] = np.where(union < size, denominator * shared >= numerator * union, shared >= least_shared(size, numerator, denominator))
    return out


def linked(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return denominator * common >= numerator * (len(x) + len(y) - common)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of the left has in common with each of the right."""
    sets = left + right
    tokens, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = np.flatnonzero(count > 1)
    number = np.full(len(tokens), -1)
    number[common] = np.arange(len(common))
    column = number[place]
    of, column = of[column >= 0], column[column >= 0]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(common), COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        matrix = np.zeros((len(sets), min(COLUMNS, len(common) - low)), np.float32)
        matrix[of[here], column[here] - low] = 1
        out += matrix[: len(left)] @ matrix[len(left) :].T
    return out


SKETCH = "row long, key long, size long, check long, s1 long, s2 long, sketch array<long>"


def _checks(block: Block) -> list[int]:
    return [zlib.crc32(x.as_buffer()) if x.is_valid else -1 for x in block.rows.column(0).cast(pa.large_binary())]


def sketches(df: DataFrame, shingle: int, kept: int) -> DataFrame:
    """One row for each of (text, key): its number, set size, a name of the set, and its sketch."""

    def work(block: Block) -> Iterator[pa.RecordBatch]:
        sets = shingle_sets(*column_bytes(block.rows.column(0)), shingle)
        rows = (block.number << 20) + np.arange(len(sets))
        names = [np.array([np.add.reduce(mix(s ^ np.uint64(seed))) for s in sets], np.uint64).view(np.int64) for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
        sizes = np.array([len(s) for s in sets], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), block.rows.column(1).combine_chunks(), pa.array(sizes), pa.array(_checks(block), pa.int64()), *map(pa.array, names), pa.array([s[:kept].view(np.int64) for s in sets], pa.list_(pa.int64()))],
            names=[x.split()[0] for x in SKETCH.split(", ")],
        )

    return exchange.scan(df, SKETCH, work, BLOCK_BYTES)


def full_sets(df: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(row, tokens) of the wanted rows (row, check), from another scan of the same table."""
    table: SideTable = side_table(wanted.select("row", "check"), "row", "wanted")

    def work(block: Block) -> Iterator[pa.RecordBatch]:
        low = block.number << 20
        rows = table.between(low, low + block.rows.num_rows - 1)
        if not rows.num_rows:
            return
        at = rows["row"].to_numpy() - low
        texts = block.rows.column(0).take(pa.array(at))
        found = [zlib.crc32(x.as_buffer()) if x.is_valid else -1 for x in texts.cast(pa.large_binary())]
        if found != rows["check"].to_pylist():
            raise RuntimeError("the table was cut into other blocks than before; read it from files that do not change")
        sets = shingle_sets(*column_bytes(texts), shingle)
        yield pa.RecordBatch.from_arrays([pa.array(at + low), pa.array([s.tobytes() for s in sets], pa.binary())], names=["row", "tokens"])

    return stored(exchange.scan(df, "row long, tokens binary", work, BLOCK_BYTES), "sets")


def inverted_lists(sets: DataFrame, numerator: int, denominator: int, kept: int) -> DataFrame:
    """(value, row, size, alone): the rarest values of each sketch that a linked set must meet; alone:
    how many values of the sketch no other set has."""
    room = F.array(*[F.lit(n - needed(n, numerator, denominator, kept) + 1) for n in range(1, kept + 1)])
    each = sets.select("row", "size", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    shared = attach(each, ["value"], ["row"], F.col("often") > 1, often=F.count(F.lit(1)))
    mine = Window.partitionBy("row")
    rank = F.row_number().over(mine.orderBy("often", "value"))
    shared = shared.withColumns({"alone": F.col("kept") - F.count(F.lit(1)).over(mine), "rank": rank})
    return stored(shared.where(F.col("alone") + F.col("rank") <= F.element_at(room, F.col("kept"))).select("value", "row", "size", "alone"), "lists")


def verify(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int, kept: int) -> DataFrame:
    """The linked ones of pairs (a, b) of rows; many may have the same b."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(may_link(x, y, numerator, denominator, kept) and linked(x, y, numerator, denominator))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("row").alias("a"), F.col("tokens").alias("ta")), "a")
    both = look_up(one, sets.select(F.col("row").alias("b"), F.col("tokens").alias("tb")), ["b"], ["a"])
    return both.select("a", "b", "ta", "tb").mapInArrow(task, "a long, b long")


def _in_blocks(residue: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Rows (row, c, size, family) dealt into blocks of like size, repeated for each pair of blocks in
    which linked sets can lie: (family, band, step, i, j, side, row, c)."""
    band = F.floor(F.ln("size") / math.log(denominator / numerator)).cast("long")
    rows = residue.withColumn("band", band)
    count = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("size") * 8 / SET_BYTES)).cast("int")
    rows = attach(rows, ["family", "band"], ["row"], n=count)
    counts = residue.withColumn("band", band).groupBy("family", "band").agg(count.alias("n"))
    for step, name in ((1, "up"), (-1, "down")):
        near = counts.select("family", (F.col("band") - step).alias("band"), F.col("n").alias(name))
        rows = look_up(rows, near, ["family", "band"], ["row"], "left")
    rows = rows.withColumn("at", F.pmod(F.xxhash64("row"), F.col("n")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda low, step, i, j, side: F.struct(low.alias("band"), F.lit(step).alias("step"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    b, at, n = F.col("band"), F.col("at"), F.col("n")
    none = F.lit(0)
    places = F.concat(
        F.transform(F.sequence(at, n - 1), lambda j: place(b, 0, at, j, 0)),
        F.transform(upto(at), lambda i: place(b, 0, i, at, 1)),
        F.transform(upto(F.coalesce("up", none)), lambda j: place(b, 1, at, j, 0)),
        F.transform(upto(F.coalesce("down", none)), lambda i: place(b - 1, 1, i, at, 1)),
    )
    return rows.select("row", "c", "family", F.explode(places).alias("p")).select("row", "c", "family", "p.*")


PLACE = ["family", "band", "step", "i", "j"]


def _sides(group: pa.Table, column: str, of) -> tuple[np.ndarray, np.ndarray, list, list]:
    side = group["side"].to_numpy()
    values = [of(x) for x in group[column]]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if group["step"][0].as_py() or group["i"][0].as_py() != group["j"][0].as_py() else left
    return left, right, [values[k] for k in left], [values[k] for k in right]


def compare_residue(residue: DataFrame, sketched: DataFrame, sets: DataFrame, numerator: int, denominator: int, kept: int) -> DataFrame:
    """Linked pairs (a, b) of different components within families, by matrices of sketches and then,
    for the rows that the estimate leaves, of full sets."""

    def estimate(group: pa.Table) -> pa.Table:
        left, right, x, y = _sides(group, "sketch", lambda v: np.sort(v.values.to_numpy().view(np.uint64)))
        if not x or not y:
            return group.slice(0, 0).drop_columns(["sketch"])
        named = group["c"].to_numpy()
        need_x, need_y = (np.array([needed(len(s), numerator, denominator, kept) for s in side]) for side in (x, y))
        near = (overlaps(x, y) >= np.minimum(need_x[:, None], need_y[None, :])) & (named[left][:, None] != named[right][None, :])
        stay = np.zeros(group.num_rows, bool)
        i, j = np.nonzero(near)
        if len(i):
            hit = may_link_pairs(x, y, i, j, numerator, denominator, kept)
            stay[left[i[hit]]] = stay[right[j[hit]]] = True
        return group.drop_columns(["sketch"]).filter(pa.array(stay))

    def exact(group: pa.Table) -> pa.Table:
        left, right, x, y = _sides(group, "tokens", lambda v: np.frombuffer(v.as_buffer(), np.uint64))
        if not x or not y:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        rows, named = group["row"].to_numpy(), group["c"].to_numpy()
        both = overlaps(x, y).astype(np.float64)
        size = [np.array([len(s) for s in side], np.float64) for side in (x, y)]
        hit = (denominator * both >= numerator * (size[0][:, None] + size[1][None, :] - both)) & (named[left][:, None] != named[right][None, :])
        i, j = np.nonzero(hit)
        return pa.table({"a": rows[left[i]], "b": rows[right[j]]})

    dealt = _in_blocks(residue, numerator, denominator)
    like = "row long, c long, family long, band long, step int, i int, j int, side int"
    near = dealt.join(sketched, "row").select("row", "c", "family", "band", "step", "i", "j", "side", "sketch").groupBy(*PLACE).applyInArrow(estimate, like)
    return stored(near, "near").join(sets, "row").groupBy(*PLACE).applyInArrow(exact, "a long, b long")


def link_components(lists: DataFrame, sketched: DataFrame, sets: DataFrame, numerator: int, denominator: int, kept: int) -> DataFrame:
    """(node, component) of the rows that are linked with any other."""
    links = labels = None
    fits = lambda x, y: denominator * F.least(x, y) >= numerator * F.greatest(x, y)

    def still_open(turn: int) -> DataFrame:
        """Rows of lists that join several components, each with a document of the list."""
        named = lists.withColumn("c", F.col("row")) if labels is None else lists.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("c", F.coalesce("component", "row")).drop("component")
        # Few values of its own: the document is near the middle of its copies. Later rounds draw others.
        hub = F.struct(F.col("alone") if turn == 0 else F.lit(0), F.xxhash64("row", F.lit(turn)).alias("h"), F.col("row").alias("hub"), F.col("size").alias("hub_size"), F.col("c").alias("hub_c"))
        return attach(named, ["value"], ["row"], F.col("c1") != F.col("c2"), c1=F.min("c"), c2=F.max("c"), first=F.min(hub))

    for turn in range(ROUNDS):
        met = still_open(turn).select("row", "size", "c", "first.hub", "first.hub_size", "first.hub_c").where(F.col("c") != F.col("hub_c")).where(fits("size", "hub_size"))
        often = met.groupBy("row", "hub").agg(F.count(F.lit(1)).alias("n"))
        pairs = stored(often.groupBy("row").agg(F.max_by("hub", F.struct("n", "hub")).alias("b")).withColumnRenamed("row", "a"), "pairs")
        found = stored(verify(pairs, sets, numerator, denominator, kept), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    left = stored(still_open(ROUNDS).select("row", "size", "c", "first.hub"), "open")
    families = components(left.select(F.col("hub").alias("a"), F.col("row").alias("b")))
    residue = left.select("row", "size", "c").distinct().join(families.select(F.col("node").alias("row"), F.col("component").alias("family")), "row")
    found = stored(compare_residue(stored(residue, "residue"), sketched, sets, numerator, denominator, kept), "links")
    return components(found if links is None else links.unionByName(found))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, numerator: int = NUMERATOR, denominator: int = DENOMINATOR, kept: int = KEPT) -> DataFrame:
    """(row, key, size, component_id) for every row: its number in the scan, its set size, and the least
    key of its component.

    Linked: denominator * common >= numerator * union of the shingle sets. Null and empty texts have
    no shingle and are alone. A null key is no least key; a component of null keys only is named null.
    df must be read from files; other columns are not looked at."""
    df = df.select(F.col(text).alias("t"), F.col(key).cast("long").alias("k"))
    scanned = stored(sketches(df, shingle, kept), "sketches")
    some = attach(scanned.where("size > 0"), ["s1", "s2", "size"], ["row"], owner=F.min("row"))
    own = F.col("row") == F.col("owner")
    some = stored(some.select("row", "key", "size", "owner", F.when(own, F.col("check")).alias("check"), F.when(own, F.col("sketch")).alias("sketch")), "owners")
    sketched = some.where("sketch is not null").select("row", "size", "check", "sketch")
    lists = inverted_lists(sketched, numerator, denominator, kept)
    wanted = lists.select("row").distinct().join(sketched.select("row", "check"), "row")
    sets = full_sets(df, wanted, shingle)
    labels = link_components(lists, sketched.select("row", "sketch"), sets, numerator, denominator, kept)
    named = look_up(some.select("row", "key", "size", "owner"), labels.withColumnRenamed("node", "owner"), ["owner"], ["row"], "left")
    named = named.select("row", "key", "size", F.coalesce("component", "owner").alias("c"))
    named = stored(named.unionByName(scanned.where("size = 0").select("row", "key", "size", F.col("row").alias("c"))), "members")
    return attach(named, ["c"], ["row"], component_id=F.min("key")).select("row", "key", "size", "component_id")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents; kept is true where both ids are null, too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select(F.col("key").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op11_minhash": op11_minhash}
