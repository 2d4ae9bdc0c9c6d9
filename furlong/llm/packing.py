"""Operator 1, best-fit packing: a grouping genetic algorithm over islands with elite migration.

A document's ids are cut into pieces of at most `capacity`; a full piece is a sequence of its own
and every other piece is an item. Items are dealt into regions of bounded size by a hash. Each
region evolves on several islands: an island holds a few packings, one from best-fit decreasing,
the others from best fit in random order. Crossover puts well-filled whole bins of one parent into
the other, drops the bins that hold an item twice, and best-fits the displaced items, longest
first. After each epoch every island passes its elite on to the next island of the region. Bins of
the best packing that are not nearly full are dissolved and packed again in fewer, new regions.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.sidetable import side_table
from furlong.llm.storage import give_back, stored
from furlong.llm.tokens import encode_column, forget

CAPACITY = 4096
#: Items of a region, islands of a region, epochs with a migration after each but the last,
#: crossovers of an island in an epoch, and packings an island holds.
REGION_ITEMS, ISLANDS, EPOCHS, CROSSOVERS, POPULATION = 4000, 3, 2, 6, 3
#: A bin filled to this share is kept when others are packed anew; how often that is done.
NEARLY_FULL, ROUNDS = 0.998, 3
PIECES = "piece int, start long, length long, ids binary"


def token_pieces(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, piece, start, length, ids) of the token ids of each text and the id after it.

    ids: little-endian unsigned 32-bit. A null text is empty and gives the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, starts = encode_column(batch.column(1), path, end_id)
            pieces = (np.diff(starts) + capacity - 1) // capacity
            row = np.repeat(np.arange(batch.num_rows), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at = starts[row] + piece * capacity
            length = np.minimum(starts[row + 1] - at, capacity)
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.append(at, len(ids)) * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), raw.cast(pa.binary())],
                names=[key, "piece", "start", "length", "ids"],
            )
            give_back()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(cut, f"`{key}` {kind}, {PIECES}")


def best_fit(bins: list[list[int]], items: list[int], lengths: list[int], capacity: int) -> None:
    """Put each item where the least room is left, in a new bin where none has room."""
    rooms = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(rooms, (lengths[i], -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if room > lengths[i]:
            bisect.insort(rooms, (room - lengths[i], k))


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones, whose room is of use."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, draw: random.Random) -> list[list[int]]:
    """Whole well-filled bins of `a`, then the bins of `b` that repeat none of their items, then
    the displaced items by best fit, longest first."""
    filled = [x for x in a if sum(lengths[i] for i in x) >= 0.98 * capacity]
    share = draw.uniform(0.4, 0.9)
    child = [list(x) for x in filled if draw.random() < share]
    inside = {i for x in child for i in x}
    displaced = []
    for x in b:
        if inside.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in inside]
    best_fit(child, sorted(displaced, key=lambda i: -lengths[i]), lengths, capacity)
    return child


def evolve(population: list[list[list[int]]], lengths: list[int], capacity: int, draw: random.Random, crossovers: int, size: int) -> list[list[list[int]]]:
    """Fill the population up to its size, cross, and keep the best, best first."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    while len(population) < size:
        bins: list[list[int]] = []
        items = list(order)
        if population:  # nearly decreasing: the longest stay in front
            items.sort(key=lambda i: -lengths[i] * draw.uniform(0.7, 1.0))
        best_fit(bins, items, lengths, capacity)
        population.append(bins)
    scored = sorted(((fitness(p, lengths, capacity), p) for p in population), key=lambda x: x[0], reverse=True)
    bound = -(-sum(lengths) // capacity)
    for _ in range(crossovers):
        if len(scored[0][1]) <= bound:  # no packing has fewer
            break
        a, b = draw.sample(range(len(scored)), 2) if len(scored) > 1 else (0, 0)
        child = crossover(scored[a][1], scored[b][1], lengths, capacity, draw)
        scored.append((fitness(child, lengths, capacity), child))
        scored.sort(key=lambda x: x[0], reverse=True)
        scored = scored[:size]
    return [p for _, p in scored]


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _groups(numbers: np.ndarray) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(numbers.tolist()):
        bins.setdefault(k, []).append(i)
    return list(bins.values())


def _epoch(items: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """One epoch on every island: items (region, island, item, length, bin, migrant) come back with
    bin set to the island's elite. bin and migrant are the packing kept and the one that came in."""

    def island(group: pd.DataFrame) -> pd.DataFrame:
        forget()
        group = group.sort_values("item", ignore_index=True)
        lengths = group["length"].tolist()
        draw = random.Random(zlib.crc32(repr((int(group["region"][0]), int(group["island"][0]), epoch)).encode()))
        known = [_groups(group[c].to_numpy()) for c in ("bin", "migrant") if group[c].iloc[0] >= 0]
        best = evolve(known, lengths, capacity, draw, CROSSOVERS, POPULATION)[0]
        return group.assign(bin=_numbers(best, len(lengths)), bins=len(best))

    columns = "region long, island int, item long, length long, bin long, migrant long, bins int"
    return items.groupBy("region", "island").applyInPandas(island, columns)


def _pack_round(items: DataFrame, regions: int, capacity: int, salt: int) -> DataFrame:
    """Items (item, length) with their region, bin and how full it is, by the best island."""
    state = (
        items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(regions)).alias("region"))
        .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        .select("region", F.col("island").cast("int"), "item", "length", F.lit(-1).cast("long").alias("bin"), F.lit(-1).cast("long").alias("migrant"))
    )
    for epoch in range(EPOCHS):
        state = stored(_epoch(state, epoch, capacity), "islands")
        if epoch + 1 < EPOCHS:  # each elite also goes to the next island of its region
            elites = state.select("region", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "item", F.col("bin").alias("migrant"))
            state = state.drop("migrant", "bins").join(elites, ["region", "island", "item"])
            state = state.select("region", "island", "item", "length", "bin", "migrant")
    best = state.groupBy("region").agg(F.min(F.struct("bins", "island"))["island"].alias("island"))
    kept = state.join(best, ["region", "island"]).select("region", "item", "length", "bin")
    return kept.withColumn("filled", F.sum("length").over(Window.partitionBy("region", "bin")))


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Items (item: distinct long, length: 1 .. capacity) with a sequence number `bin` each (any
    distinct long numbers for distinct sequences). An empty table gives an empty table."""
    done, left = [], items
    rounds = 0
    while True:
        size = left.count()
        regions = max(1, -(-size // REGION_ITEMS))
        packed = stored(_pack_round(left, regions, capacity, rounds), "packed")
        last = rounds + 1 == ROUNDS or regions == 1
        named = packed.withColumn("bin", (F.col("region") * F.lit(1 << 20) + F.col("bin")) * F.lit(2 * ROUNDS) + 2 * rounds)
        full = F.col("filled") >= NEARLY_FULL * capacity
        done.append((named if last else named.where(full)).select("item", "length", "bin"))
        if last:
            break
        left, rounds = packed.where(~full).select("item", "length"), rounds + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Pieces (key, piece, length, ...) with sequence_id and their offset in that sequence.

    Pieces of length `capacity` stay alone. Repeated keys are distinct pieces. Offsets follow
    the order of the items and are gapless. Columns named like the new ones are replaced. `pieces` is read several times: give a stored table."""
    numbered = stored(pieces.drop("item", "sequence_id", "offset").withColumn("item", F.monotonically_increasing_id()), "pieces")
    alone = F.col("length") >= capacity
    bins = pack_items(numbered.where(~alone).select("item", "length"), capacity)
    whole = numbered.where(alone).withColumns({"sequence_id": F.col("item") * 2 + 1, "offset": F.lit(0).cast("long")})
    before = Window.partitionBy("bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.select("item", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return numbered.where(~alone).join(placed, "item").unionByName(whole).drop("item")


def pack_with_ids(pieces: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Like pack(), for pieces that carry `ids`: the ids are written once and never shuffled; the task
    that reads them finds their places in a table of its own range of pieces."""
    numbered = stored(pieces.drop("at", "sequence_id", "offset").withColumn("at", F.monotonically_increasing_id()), "ids")
    table = side_table(pack(numbered.select(key, "at", "length"), capacity, key).select("at", "sequence_id", "offset"), "at", "places")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            if not batch.num_rows:
                continue
            # A task reads files of several writers in any order, and a batch may hold the end of one and the start of another.
            at = batch.column("at").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
            found = pa.concat_tables([table.between(int(at[low]), int(at[high - 1])) for low, high in zip(cuts, cuts[1:], strict=False)])
            if not np.array_equal(found["at"].to_numpy(), at):
                raise RuntimeError("pieces are not read in the order in which they were numbered")
            for name in ("sequence_id", "offset"):
                batch = batch.append_column(name, found[name].combine_chunks())
            yield batch

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema)
    return numbered.mapInArrow(place, f"{columns}, sequence_id long, offset long").drop("at")


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves: (sequence_id, length, ids), pieces in order of offset.
    `packed` carries ids; a sequence holds at most `capacity` of them."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.expr("aggregate(parts, cast('' as binary), (a, p) -> a || p.ids)").alias("ids"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op1_packing": op1_packing}
