"""Operator 7, n-gram Jaccard join by universe partition and pigeonhole.

Sets fall into bands of size so that linked sets lie in one band or in neighbouring ones. For a band
the token universe is hashed into segments. Two linked sets differ in few tokens, so if a set may
differ from any partner in H tokens, then among segments that count together H + 1 units one is
equal (a segment probed as it is counts one unit) or differs by one token (a segment probed with
its one-deletion neighbourhood counts two). Each set probes the cheapest allocation for its own
band, where it is the larger of a pair, and is indexed with all segments in its own and the next
band. Keys that no other set shares are found by a compact exchange and never become rows.

What shares a key is verified exactly on the full sets. Only components are wanted, so pairs inside
one component are not looked at again: in rounds, every set with a key that is shared with another
component is compared with one set of that key; what then still shares keys across components is
compared in blocks, as matrices, so that only linked pairs become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm import exchange
from furlong.llm.components import components
from furlong.llm.exchange import Block
from furlong.llm.spans import LOWER_VALUE, chain, column_bytes, hash_spans, mix, words
from furlong.llm.storage import give_back, new_path, stored

SHINGLE, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Sets up to this size are indexed with one-deletion neighbourhoods; larger ones get some spare
#: segments instead, so that the least selective need not be probed.
DELETION_SIZE, SPARE = 64, 1.12
#: Text of a block in bytes.
BLOCK_BYTES = 4 << 20
#: Rounds of comparing with one set of a shared key.
ROUNDS = 2
#: Sets of a block and columns of a matrix when what is left is compared.
BLOCK_SETS, COLUMNS = 512, 8192


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word shingles; of the whole row if it has fewer words."""
    starts, ends, before = words(buf, offsets)
    word = hash_spans(buf, starts, ends, LOWER_VALUE)
    runs = chain(word, size)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(chain(word[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def differ_most(larger: int, numerator: int, denominator: int) -> int:
    """Tokens in which linked sets can differ, the larger one having `larger`."""
    return 2 * larger * (denominator - numerator) // (denominator + numerator)


@lru_cache(4)
def band_edges(numerator: int, denominator: int) -> np.ndarray:
    """The least size of each band; a set's partner lies in its own band or a neighbouring one."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * denominator // numerator + 1)
    return np.array(edges)


def segments_of(band: int, numerator: int, denominator: int) -> tuple[int, bool]:
    """How many segments a band has, and whether it is indexed with one-deletion neighbourhoods."""
    most = differ_most(int(band_edges(numerator, denominator)[band + 1]) - 1, numerator, denominator)
    if band_edges(numerator, denominator)[band + 1] - 1 <= DELETION_SIZE:
        return most // 2 + 1, True
    return int(np.ceil(SPARE * (most + 1))), False


def _layout(tokens: np.ndarray, band: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment of each token, tokens in each segment, and an order-free sum of each segment."""
    segment = ((tokens >> np.uint64(20)) % np.uint64(count)).astype(np.int64)
    total = np.zeros(count, np.uint64)
    np.add.at(total, segment, mix(tokens))
    return segment, np.bincount(segment, minlength=count), total


def _key(total: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    return mix(total + (segment.astype(np.uint64) + np.uint64(band << 32)) * np.uint64(0xD1342543DE82EF95) + np.uint64(1))


def allocate(sizes: np.ndarray, need: int, deletions: bool) -> np.ndarray:
    """For each segment 0 (not probed), 1 (as it is) or 2 (with its one-deletion neighbourhood), so
    that the units sum to `need` at the least cost: a key costs a look-up and the sets it may meet
    by chance, which are fewer the more tokens it stands for."""
    chance = lambda n: 1 + 1000.0 * 0.02 ** np.maximum(n, 0)
    one = chance(sizes)
    two = one + sizes * chance(sizes - 1) if deletions else np.full(len(sizes), np.inf)
    # Greedy by the cost of the next unit: the second unit of a segment costs no less than the first.
    steps = np.concatenate([one, np.maximum(two - one, one)])
    chosen = np.argsort(steps, kind="stable")[:need]
    return np.bincount(chosen % len(sizes), minlength=len(sizes))


def keys_of(tokens: np.ndarray, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and whether the set probes with each (else it is only indexed)."""
    edges = band_edges(numerator, denominator)
    own = int(np.searchsorted(edges, len(tokens), side="right")) - 1
    keys, probes = [], []
    for band in (own, own + 1):
        count, deletions = segments_of(band, numerator, denominator)
        segment, sizes, total = _layout(tokens, band, count)
        units = allocate(sizes, differ_most(len(tokens), numerator, denominator) + 1, deletions) if band == own else np.zeros(count, np.int64)
        keys.append(_key(total, np.arange(count), band))
        probes.append(units > 0)
        if deletions:
            keys.append(_key(total[segment] - mix(tokens), segment, band))
            probes.append(units[segment] > 1)
    return np.concatenate(keys), np.concatenate(probes)


def _set_key(tokens: np.ndarray) -> np.uint64:
    return mix(np.array([np.add.reduce(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)))], np.uint64) + np.uint64(len(tokens)))[0]


class _Sets:
    """The shingle sets of a block, and which row is the first of all with the same set."""

    def __init__(self, block: Block):
        self.sets = shingle_sets(*column_bytes(block.rows.column(0)))
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.rows = (block.number << 20) + np.arange(len(self.sets))
        self.some = np.flatnonzero(self.sizes)
        self.keys, self.place, _ = exchange.distinct(np.array([_set_key(self.sets[i]) for i in self.some], np.uint64))
        self.first = np.full(len(self.keys), np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.place, self.rows[self.some])

    def owners(self, path: str, block: Block, check: int) -> np.ndarray:
        out = self.rows.copy()
        out[self.some] = exchange.answers(path, block, check, np.int64)[self.place]
        return out


NODE = "row long, key long, size long, owner long, keys array<long>, tokens binary"


def shared_keys(df: DataFrame, key: str, text: str, numerator: int, denominator: int) -> DataFrame:
    """One row for each document: its number `row`, its key, set size, and the row that stands for
    its set; rows that stand for a set and share keys with others also have those and their tokens."""
    df = df.select(F.col(text).alias("t"), F.col(key).cast("long").alias("k"))
    parts = exchange.parts_of(df.agg(F.sum(F.octet_length("t"))).first()[0] or 0)

    def first(block: Block) -> Iterator[pa.RecordBatch]:
        sets = _Sets(block)
        yield exchange.questions(block, block.check(0), sets.keys, parts, sets.first)

    def least(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        unique, place = np.unique(keys, return_inverse=True)
        out = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(out, place, rows)
        return out[place]

    owned = exchange.answer(exchange.scan(df, exchange.ROW, first, BLOCK_BYTES), least, "i8")

    def signed(block: Block, check: int):
        sets = _Sets(block)
        owners = sets.owners(owned, block, check)
        mine = [i for i in sets.some if owners[i] == sets.rows[i]]
        each = [keys_of(sets.sets[i], numerator, denominator) for i in mine]
        flat = np.concatenate([k for k, _ in each] or [np.zeros(0, np.uint64)])
        probe = np.concatenate([p for _, p in each] or [np.zeros(0, bool)])
        return sets, owners, mine, [len(k) for k, _ in each], probe, exchange.distinct(flat)

    def second(block: Block) -> Iterator[pa.RecordBatch]:
        check = block.check(0)
        _, _, _, _, probe, (keys, place, count) = signed(block, check)
        flag = (count > 1).astype(np.uint8)
        np.bitwise_or.at(flag, place[probe], 2)
        yield exchange.questions(block, check, keys, parts, flag)

    def meet(keys: np.ndarray, flag: np.ndarray) -> np.ndarray:
        unique, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        all_flags = np.zeros(len(unique), np.uint8)
        np.bitwise_or.at(all_flags, place, flag)
        return (((count > 1) | (all_flags & 1 > 0)) & (all_flags & 2 > 0)).astype(np.uint8)[place]

    met = exchange.answer(exchange.scan(df, exchange.ROW, second, BLOCK_BYTES), meet, "u1")

    def third(block: Block) -> Iterator[pa.RecordBatch]:
        check = block.check(0)
        sets, owners, mine, sizes, _, (keys, place, _) = signed(block, check)
        shared = exchange.answers(met, block, check, np.uint8)[place].astype(bool)
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        out_keys, tokens = ([None] * len(sets.sets) for _ in range(2))
        flat = keys[place].astype(np.int64)
        for j, i in enumerate(mine):
            has = shared[at[j] : at[j + 1]]
            if has.any():
                out_keys[i] = flat[at[j] : at[j + 1]][has]
                tokens[i] = sets.sets[i].tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(sets.rows), block.rows.column(1).combine_chunks(), pa.array(sets.sizes), pa.array(owners), pa.array(out_keys, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
            names=["row", "key", "size", "owner", "keys", "tokens"],
        )

    return stored(exchange.scan(df, NODE, third, BLOCK_BYTES), "sets")


def verify(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of rows whose sets are linked, counted on the full sets."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * common >= numerator * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("row").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    met = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return met.mapInArrow(linked, "a long, b long")


def _linked_across(group: pa.Table, numerator: int, denominator: int) -> pa.Table:
    """Linked pairs of different components between the two sides of a group, by the product of
    their incidence matrices over the tokens that more than one set has."""
    side = group["side"].to_numpy()
    rows, named = group["row"].to_numpy(), group["c"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["tokens"]]
    size = np.array([len(x) for x in sets])
    tokens, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    number = np.full(len(tokens), -1)
    number[common] = np.arange(len(common))
    of = np.repeat(np.arange(len(sets)), size)
    column = number[place]
    of, column = of[column >= 0], column[column >= 0]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if (side == 1).any() else 0))
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, len(common), COLUMNS):
        here = (column >= low) & (column < low + COLUMNS)
        matrix = np.zeros((len(sets), min(COLUMNS, len(common) - low)), np.float32)
        matrix[of[here], column[here] - low] = 1
        shared += matrix[left] @ matrix[right].T
    union = size[left][:, None] + size[right][None, :] - shared
    linked = (denominator * shared >= numerator * union) & (named[left][:, None] != named[right][None, :])
    x, y = np.nonzero(linked)
    return pa.table({"a": rows[left[x]], "b": rows[right[y]]})


def compare_residue(residue: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Linked pairs (a, b) of different components among rows (row, size, c, family) of one family.

    A family is dealt into blocks by size; two blocks meet in one task if their sizes allow a link,
    and are compared there as matrices. A pair never becomes a row unless it is linked, and a set
    is a row of two shuffles and a file, whatever number of blocks it meets."""
    order = Window.partitionBy("family").orderBy("size", "row")
    dealt = residue.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK_SETS))
    dealt = stored(dealt, "residue")
    spans = dealt.groupBy("family", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"))
    other = spans.select("family", F.col("block").alias("block2"), F.col("low").alias("low2"))
    meets = spans.join(other, "family").where((F.col("block") <= F.col("block2")) & (F.col("high") * denominator >= F.col("low2") * numerator)).select("family", "block", "block2")
    full = dealt.join(sets.select("row", "tokens"), "row").select("family", "block", "row", "c", "tokens")
    within = full.withColumns({"block2": F.col("block"), "side": F.lit(0)}).groupBy("family", "block", "block2").applyInArrow(lambda group: _linked_across(group, numerator, denominator), "a long, b long")
    across = meets.where("block < block2")
    several = full.join(spans.where("block = 1").select("family"), "family", "left_semi")
    # Tokens are stored once, a folder for each block; beside every block that it meets they would be shuffled as often.
    path = new_path(residue.sparkSession, "blocks")
    of = lambda block: F.concat_ws("_", "family", block)
    several.select("row", "c", "tokens", of("block").alias("of")).repartition("of").write.partitionBy("of").option("compression", "zstd").parquet(path)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")

        @lru_cache(1)
        def block(name: str) -> pa.Table:
            files = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/of={name}")) if f.path.endswith(".parquet")]
            return pa.concat_tables([pq.ParquetFile(f, filesystem=fs).read(columns=["row", "c", "tokens"]) for f in files])

        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left = block(one)
                right = block.__wrapped__(two)
                sides = [t.append_column("side", pa.array(np.full(t.num_rows, i))) for i, t in enumerate((left, right))]
                yield from _linked_across(pa.concat_tables(sides).combine_chunks(), numerator, denominator).to_batches()
                give_back()

    pairs = across.select(of("block").alias("one"), of("block2").alias("two"))
    tasks = int(residue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.repartition(tasks, "one", "two").sortWithinPartitions("one")
    return within.unionByName(pairs.mapInArrow(compared, "a long, b long"))


def link_components(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(node, component) of the rows that are linked with any other."""
    some = sets.where("keys is not null")
    rows = some.select("row", "size", F.size("keys").alias("weight"), F.explode("keys").alias("k"))
    rows = stored(rows, "keys")
    links = labels = tried = None
    fits = denominator * F.least("size", "size2") >= numerator * F.greatest("size", "size2")

    def unresolved(turn: int) -> tuple[DataFrame, DataFrame]:
        """Rows with their component, and the keys that still join several, each with a hub."""
        named = rows.withColumn("c", F.col("row"))
        if labels is not None:
            named = rows.join(labels.withColumnRenamed("node", "row"), "row", "left").withColumn("c", F.coalesce("component", "row")).drop("component")
        # A set of many shared keys is near the middle of its copies; later rounds draw another.
        draw = F.xxhash64("row", F.lit(turn))
        first = F.struct((-F.col("weight") if turn == 0 else F.lit(0)).alias("w"), draw.alias("h"), F.col("row").alias("row2"), F.col("size").alias("size2"), F.col("c").alias("other"))
        per_key = named.groupBy("k").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min(first).alias("hub"))
        return named, per_key.where("c1 <> c2").select("k", "hub.*")

    for turn in range(ROUNDS):
        named, hubs = unresolved(turn)
        met = named.join(hubs, "k").where(fits & (F.col("c") != F.col("other")))
        pairs = met.select("row", "w", "h", F.least("row", "row2").alias("a"), F.greatest("row", "row2").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs.groupBy("row").agg(F.min(F.struct("w", "h", "a", "b")).alias("x")).select("x.a", "x.b").distinct(), "pairs")
        found = stored(verify(pairs, some, numerator, denominator), "links")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = components(links)
    named, hubs = unresolved(ROUNDS)
    left = stored(named.join(hubs.select("k", "row2"), "k").select("k", "row", "size", "c", "row2"), "open")
    families = components(left.select(F.col("row2").alias("a"), F.col("row").alias("b")))
    residue = left.select("row", "size", "c").distinct().join(families.select(F.col("node").alias("row"), F.col("component").alias("family")), "row")
    found = stored(compare_residue(residue, some, numerator, denominator), "links")
    return components(found if links is None else links.unionByName(found))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """(row, key, size, component_id, first) for every row: its number in the scan, its set size,
    the least key of its component, and whether it is the row of the component to keep.

    Linked: denominator * common >= numerator * union of the shingle sets. Null and empty texts
    have no shingle and are alone. Of rows with the least key the first is kept; a null key comes
    last, and a component of null keys only is named null. df must be read from files."""
    sets = shared_keys(df, key, text, numerator, denominator)
    labels = link_components(sets, numerator, denominator)
    named = sets.select("row", "key", "size", "owner").join(labels.withColumnRenamed("node", "owner"), "owner", "left")
    named = stored(named.select("row", "key", "size", F.coalesce("component", "owner").alias("c")), "members")
    heads = named.groupBy("c").agg(F.min("key").alias("component_id"), F.min(F.struct(F.col("key").isNull().alias("n"), "key", "row"))["row"].alias("head"))
    return named.join(heads, "c").select("row", "key", "size", "component_id", (F.col("row") == F.col("head")).alias("first"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df without near duplicates: of each component the row that near_duplicates calls first, with
    all its columns. df must be read from files."""
    columns = df.columns
    gone = near_duplicates(df, key, text, **options).where(~F.col("first")).select("row")

    def number(block: Block) -> Iterator[pa.Table]:
        yield block.rows.append_column("_row", pa.array((block.number << 20) + np.arange(block.rows.num_rows)))

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [text, *[c for c in columns if c != text]])
    numbered = exchange.scan(df.select(text, *[c for c in columns if c != text]), f"{fields}, _row long", number, BLOCK_BYTES)
    return numbered.join(stored(gone, "gone").withColumnRenamed("row", "_row"), "_row", "left_anti").select(*columns)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(F.col("key").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


QUERIES = {"op7_jaccard": op7_jaccard}
