"""Operator 12, conversation prefix trie with subtree totals by time-forward processing.

A prefix of a sequence is named by its length and by two 64-bit sums (exclusive or) of the hashes of
its turns with their places; sums are taken over chunks of a sequence and carried from chunk to chunk,
so a conversation of any length is dealt over tasks. A node is then named by its depth and its
smallest member, which is unique among the nodes of a depth.

Totals of subtrees pass from children to parents. Nodes are dealt into shards: those of a band of
depths whose smallest members start within one block of turns. Spark sorts each shard in reverse
level order, externally; a task walks it once and passes messages to parents through a priority
queue that spills. Messages for parents in other shards are added up by parent and delivered in the
next pass, to the shards that have any, until there are none: the passes climb over shard roots.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.spread import block, blocks, numbered
from furlong.llm.storage import stored

#: Turns of a sequence whose hashes are summed together.
CHUNK = 1024
#: Depths of a shard.
BAND = 4096
#: Messages that a queue keeps in memory.
QUEUE = 1 << 17


class Queue:
    """A priority queue of tuples. What exceeds `room` goes, sorted, into files of the task itself,
    which vanish with it and are made again when the task is repeated."""

    def __init__(self, room: int = QUEUE):
        self.room, self.heap, self.runs = room, [], []

    def push(self, item: tuple) -> None:
        if len(self.heap) >= self.room:
            self._spill()
        heapq.heappush(self.heap, item)

    def _spill(self) -> None:
        """The later half leaves memory; the sooner half is asked for next."""
        self.heap.sort()
        keep = len(self.heap) // 2
        run = tempfile.TemporaryFile()
        for low in range(keep, len(self.heap), 4096):
            pickle.dump(self.heap[low : min(low + 4096, len(self.heap))], run, pickle.HIGHEST_PROTOCOL)
        run.seek(0)
        self.heap = self.heap[:keep]
        entry = [None, run, []]
        self._advance(entry)
        self.runs.append(entry)

    @staticmethod
    def _advance(entry: list) -> None:
        if not entry[2]:
            try:
                entry[2] = pickle.load(entry[1])[::-1]
            except EOFError:
                entry[1].close()
        entry[0] = entry[2].pop() if entry[2] else None

    def _least(self) -> tuple[tuple | None, list | None]:
        best, of = (self.heap[0] if self.heap else None), None
        for entry in self.runs:
            if best is None or entry[0] < best:
                best, of = entry[0], entry
        return best, of

    def take(self, key: tuple) -> Iterator[tuple]:
        """Remove and yield every item that begins with `key`; earlier items were taken before."""
        while True:
            item, run = self._least()
            if item is None or item[: len(key)] != key:
                return
            if run is None:
                heapq.heappop(self.heap)
            else:
                self._advance(run)
                self.runs = [x for x in self.runs if x[0] is not None]
            yield item


PASSED = "kind int, depth long, conv long, shard long, band long, leaves long, saved long"


def _forward(batches: Iterator[pa.RecordBatch], room: int, band_depths: int) -> Iterator[pa.RecordBatch]:
    """Walk shards in reverse level order. Rows: shard, band, depth (negative), conv, kind (0: a message
    from another shard, 1: the node), leaves, saved, parent (smallest member) and the parent's shard.
    Yields what each node received or has of its own (kind 1), and messages to other shards (kind 0)."""
    here, queue = None, Queue(room)
    came = (0, 0)
    for batch in batches:
        out = []
        for shard, band, depth, conv, kind, leaves, saved, parent, parent_shard in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (shard, band) != here:
                here, queue, came = (shard, band), Queue(room), (0, 0)
            if kind == 0:
                came = (came[0] + leaves, came[1] + saved)
                continue
            leaves, saved, came = leaves + came[0], saved + came[1], (0, 0)
            for _, _, more, bytes_ in queue.take((depth, conv)):
                leaves, saved = leaves + more, saved + bytes_
            if not leaves and not saved:
                continue
            out.append((1, -depth, conv, shard, band, leaves, saved))
            if parent is None:
                continue
            over = -depth - 1
            if parent_shard == shard and over // band_depths == band:
                queue.push((depth + 1, parent, leaves, saved))
            else:
                out.append((0, over, parent, parent_shard, over // band_depths, leaves, saved))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.int64()] * 6], strict=True)], names=[x.split()[0] for x in PASSED.split(", ")])


def subtree_totals(nodes: DataFrame, room: int = QUEUE, band_depths: int | None = None) -> DataFrame:
    """(depth, conv, leaves, saved) summed over the subtree of every node.

    nodes: depth, conv (together the name), shard, leaves and saved of the node itself, and parent
    (the conv of its parent, one level higher; null for the root) with parent_shard. Parts of one
    total may come in several rows; the caller adds them up."""
    band_depths = band_depths or BAND
    order = ["shard", "band", "level", "conv", "kind"]
    own = nodes.select("shard", F.floor(F.col("depth") / band_depths).alias("band"), (-F.col("depth")).alias("level"), "conv", F.lit(1).alias("kind"), "leaves", "saved", "parent", "parent_shard")
    waiting, passed = None, []
    while True:
        todo = own
        if waiting is not None:
            none = F.lit(None).cast("long")
            shards = waiting.select("shard", "band").distinct()
            later = own.join(shards, ["shard", "band"], "left_semi").withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
            todo = later.unionByName(waiting.select("shard", "band", (-F.col("depth")).alias("level"), "conv", F.lit(0).alias("kind"), "leaves", "saved", none.alias("parent"), none.alias("parent_shard")))
        walk = todo.repartition("shard", "band").sortWithinPartitions(*order).select(*order, "leaves", "saved", "parent", "parent_shard")
        out = stored(walk.mapInArrow(lambda batches: _forward(batches, room, band_depths), PASSED), "passed")
        passed.append(out.where("kind = 1").select("depth", "conv", "leaves", "saved"))
        waiting = stored(out.where("kind = 0").groupBy("shard", "band", "depth", "conv").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "waiting")
        if not waiting.head(1):
            break
    total = passed[0]
    for more in passed[1:]:
        total = total.unionByName(more)
    return total


def _joined_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each (depth, conv), which come in order, joined by commas; a text at a time."""
    names = ["depth", "conv", "ends_sha256"]
    kind = [pa.int64(), pa.int64(), pa.string()]
    of, sha = None, None
    for batch in batches:
        done = []
        for depth, conv, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if (depth, conv) == of:
                sha.update(b"," + text.encode())
                continue
            if of is not None:
                done.append((*of, sha.hexdigest()))
            of, sha = (depth, conv), hashlib.sha256(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kind, strict=True)], names=names)
    if of is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*of, sha.hexdigest()), kind, strict=True)], names=names)


def rebuilt(turns: DataFrame, every: int = 5, cycle: int = 9) -> tuple[DataFrame, DataFrame]:
    """Sequences made of the first turns of another one and the rest of their own.

    turns: conv, turn, digest, bytes. Returns (conv, shard, length, depth, digest, bytes), depths from
    1, and (conv, shard, length) with the empty ones too. Turns with equal numbers follow by digest."""
    rows = numbered(turns, ["conv", "turn", "digest"], name="turns")
    convs = rows.groupBy("conv").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(cycle))
    convs = stored(convs.select("conv", "first", "n", block("first").alias("shard"), (F.col("conv") - F.col("conv") % every).alias("base"), head.alias("h")), "convs")
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    spans = convs.select("conv", "shard", "first", "h", "taken", "length", blocks("first", F.col("first") + F.col("n") - 1).alias("b"))
    placed = rows.withColumn("b", block("g")).join(spans, ["conv", "b"]).withColumn("p", F.col("g") - F.col("first"))
    tail = placed.where("p >= h").select("conv", "shard", "length", (F.col("taken") + F.col("p") - F.col("h") + 1).alias("depth"), "digest", "bytes")
    given = placed.where((F.col("p") < cycle - 1) & (F.col("conv") % every == 0)).select(F.col("conv").alias("base"), "p", "digest", "bytes")
    heads = given.join(convs.select("base", "conv", "shard", "length", "h"), "base").where("p < h").select("conv", "shard", "length", (F.col("p") + 1).alias("depth"), "digest", "bytes")
    return tail.unionByName(heads), convs.select("conv", "shard", "length")


def _prefixes(rows: DataFrame) -> DataFrame:
    """Rows (conv, depth, digest, ..) with the name of their prefix (k1, k2) and of the one before (p1, p2)."""
    rows = rows.withColumns({"x1": F.xxhash64("depth", "digest"), "x2": F.xxhash64("digest", "depth", F.lit("second")), "chunk": F.floor((F.col("depth") - 1) / CHUNK)})
    inside = Window.partitionBy("conv", "chunk").orderBy("depth")
    rows = rows.withColumns({f"k{i}": F.bit_xor(f"x{i}").over(inside) for i in (1, 2)})
    whole = rows.groupBy("conv", "chunk").agg(*[F.bit_xor(f"x{i}").alias(f"w{i}") for i in (1, 2)])
    # One row for each chunk of a sequence.
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("conv", "chunk", *[F.bit_xor(f"w{i}").over(before).alias(f"c{i}") for i in (1, 2)]).where("chunk > 0")
    rows = rows.join(carried, ["conv", "chunk"], "left")
    rows = rows.withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)})
    return rows.withColumns({f"p{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)})


def trie(sequences: DataFrame, lengths: DataFrame, room: int = QUEUE) -> DataFrame:
    """The nodes of the trie of sequences (conv, shard, length, depth, digest, bytes), and of all (conv,
    shard, length): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256."""
    named = _prefixes(sequences).select("conv", "shard", "length", "depth", "bytes", "k1", "k2", "p1", "p2")
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    top = lengths.select("conv", "shard", "length", zero.alias("depth"), zero.alias("bytes"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"))
    members = named.unionByName(top)
    # The members of a node that start in one block of turns; a shard is such a block.
    ends = F.transform(F.sort_array(F.collect_list(F.when(F.col("depth") == F.col("length"), F.col("conv")))), lambda x: x.cast("string"))
    some = members.groupBy("depth", "k1", "k2", "shard").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.array_join(ends, ",").alias("ends")
    )
    node = Window.partitionBy("depth", "k1", "k2")
    first = F.min(F.struct("conv", "shard")).over(node)
    some = stored(some.withColumns({"first": first, "n_convs": F.sum("n").over(node)}), "members")
    nodes = some.where(F.col("first.conv") == F.col("conv")).select("depth", "conv", "shard", "n_convs", "bytes", "p1", "p2")
    # The parent of a node has the node's smallest member too, among those of its shard.
    above = some.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "shard", F.col("first.conv").alias("parent"), F.col("first.shard").alias("parent_shard"))
    nodes = stored(nodes.join(above, ["depth", "p1", "p2", "shard"], "left").select("depth", "conv", "shard", "n_convs", "bytes", "parent", "parent_shard"), "nodes")
    born = nodes.where("parent is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(born, ["depth", "conv"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    own = nodes.select("depth", "conv", "shard", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), "parent", "parent_shard")
    totals = subtree_totals(own, room).groupBy("depth", "conv").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    listed = some.where("ends <> ''").select("depth", F.col("first.conv").alias("conv"), "ends", "shard")
    listed = listed.repartition("depth", "conv").sortWithinPartitions("depth", "conv", "shard").select("depth", "conv", "ends")
    ended = listed.mapInArrow(_joined_hash, "depth long, conv long, ends_sha256 string")
    out = nodes.join(totals, ["depth", "conv"]).join(ended, ["depth", "conv"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )


def turn_digest(role: str | Column, text: str | Column) -> Column:
    """Tells turns apart by role and text; null is empty."""
    role, text = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations. Rows without conv_id belong to no conversation; turns
    with equal numbers follow by the digest of role and text; an empty table has no node."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id is not null")
    turns = table.select(F.col("conv_id").alias("conv"), "turn", turn_digest("role", "text").alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return trie(*rebuilt(turns))


QUERIES = {"op12_prefixes": op12_prefixes}
