"""Operator 4, suffix-array deduplication: difference-cover construction, block by block.

Every byte position of a long enough document is a suffix. The positions of a difference cover
modulo V are named first: a cover sample's name stands for the next L - V + 1 bytes, and two
samples have one name if those bytes are equal. Any two suffixes have, less than V bytes on, a
pair of samples at the same distance; so if two suffixes agree in L bytes, a sample in the first V
bytes of each has a name that occurs again. That resolves the long ties: only suffixes with such a
sample are compared to depth L. Suffixes are compared one bucket of keys at a
time, each bucket in a task of its own, so memory is bounded by the bucket. Equality to depth L is
all that deduplication asks of the order, hence buckets are ranges of 64-bit hashes of the L bytes
rather than of the bytes themselves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import exchange
from furlong.llm.exchange import Block
from furlong.llm.spans import column_bytes, hash_spans

LENGTH = 200
#: Text of a block, and text behind one part of the keys, in bytes: a part can get a key a byte.
BLOCK_BYTES, PART_BYTES = 4 << 20, 4 << 20


@functools.lru_cache(8)
def difference_cover(length: int) -> tuple[int, np.ndarray]:
    """V and a set D modulo V such that every difference modulo V is one of two members of D, with
    V at most two thirds of the length. For a prime q the zeros of a linear recurrence of order 3
    modulo q give q + 1 members for V = q*q + q + 1."""
    for q in (11, 7, 5, 3, 2):
        v = q * q + q + 1
        if 3 * v > 2 * length:
            continue
        for a, b, c in np.ndindex(q, q, q):
            state, zeros = (0, 0, 1), set()
            for i in range(v):
                if state[0] == 0:
                    zeros.add(i)
                state = (state[1], state[2], (a * state[2] + b * state[1] + c * state[0]) % q)
            if len({(x - y) % v for x in zeros for y in zeros}) == v and len(zeros) <= q + 1:
                return v, np.array(sorted(zeros))
    return 1, np.array([0])


class Suffixes:
    """The suffixes of a block's documents, numbered by their byte in the block."""

    def __init__(self, column: pa.ChunkedArray, length: int):
        self.buf, self.offsets = column_bytes(column)
        self.length, (self.modulus, self.cover) = length, difference_cover(length)
        self.gram = length - self.modulus + 1

    def samples(self) -> np.ndarray:
        """Cover positions of all documents that hold a string of the length, in order."""
        out = []
        for low, high in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            if high - low >= self.length:
                rounds = (high - low - self.gram) // self.modulus + 1
                at = (np.arange(rounds)[:, None] * self.modulus + self.cover).ravel()
                out.append(low + at[at <= high - low - self.gram])
        return np.concatenate(out or [np.zeros(0, np.int64)])

    def names(self, at: np.ndarray, size: int) -> np.ndarray:
        return hash_spans(self.buf, at, at + size)

    def candidates(self, samples: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Suffixes of at least `length` bytes with a repeated sample in their first V bytes."""
        known = np.zeros(len(self.buf) + 1, np.int32)
        known[samples[repeated] + 1] = 1
        np.cumsum(known, out=known)
        fits = np.zeros(len(self.buf) + 1, np.int8)  # 1 where suffixes of a document begin to be long enough, -1 where they end
        sizes = np.diff(self.offsets)
        long = sizes >= self.length
        np.add.at(fits, self.offsets[:-1][long], 1)
        np.add.at(fits, self.offsets[1:][long] - self.length + 1, -1)
        inside = np.cumsum(fits[:-1], dtype=np.int8) > 0
        ahead = np.concatenate([known[self.modulus :], np.full(min(self.modulus, len(known)), known[-1])])[: len(self.buf)]
        return np.flatnonzero(inside & (ahead > known[:-1]))


def _ask(block: Block, names: np.ndarray, parts: int, check: int) -> pa.RecordBatch:
    keys, _, count = exchange.distinct(names)
    return exchange.questions(block, check, keys, parts, (count > 1).astype(np.uint8))


def _told(path: str, block: Block, names: np.ndarray, check: int) -> np.ndarray:
    keys, place, _ = exchange.distinct(names)
    found = exchange.answers(path, block, check, np.uint8)
    if len(found) != len(keys):
        raise RuntimeError(f"{len(found)} answers for {len(keys)} keys")
    return found[place].astype(bool)


def find_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, characters: bool = False) -> DataFrame:
    """Add `kept` (binary: the bytes that stay) and `removed` (array of start and end of each
    maximal removed run, in bytes of the text) to every row.

    A byte goes if a string of `length` bytes that covers it also starts at any other place, in
    the same row or another; rows end strings. Null is empty; equal rows are each other's repeats.
    characters: characters of which any byte goes are removed whole, so `kept` is UTF-8.
    Columns named like the new ones are replaced. df is scanned three times and must be read from files."""
    columns = [text, *[c for c in df.columns if c not in (text, "kept", "removed")]]
    df = df.select(columns)
    texts = df.select(text)
    parts = exchange.parts_of(df.agg(F.sum(F.octet_length(text))).first()[0] or 0, PART_BYTES)

    def first(block: Block) -> Iterator[pa.RecordBatch]:
        s = Suffixes(block.rows.column(0), length)
        yield _ask(block, s.names(s.samples(), s.gram), parts, block.check(0))

    def elsewhere(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
        return exchange.elsewhere(keys, several).astype(np.uint8)

    covers = exchange.answer(exchange.scan(texts, exchange.ROW, first, BLOCK_BYTES), elsewhere, "u1")

    def open_suffixes(block: Block, check: int) -> tuple[Suffixes, np.ndarray]:
        s = Suffixes(block.rows.column(0), length)
        at = s.samples()
        return s, s.candidates(at, _told(covers, block, s.names(at, s.gram), check))

    def second(block: Block) -> Iterator[pa.RecordBatch]:
        check = block.check(0)
        s, at = open_suffixes(block, check)
        yield _ask(block, s.names(at, length), parts, check)

    full = exchange.answer(exchange.scan(texts, exchange.ROW, second, BLOCK_BYTES), elsewhere, "u1")

    def third(block: Block) -> Iterator[pa.Table]:
        check = block.check(0)
        s, at = open_suffixes(block, check)
        at = at[_told(full, block, s.names(at, length), check)]
        cover = np.zeros(len(s.buf) + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        if characters and len(gone):
            lead = (s.buf & 0xC0) != 0x80
            gone = np.logical_or.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]
        edge = np.zeros(len(s.buf) + 1, bool)
        edge[s.offsets] = True
        starts, ends = gone.copy(), gone.copy()
        starts[1:] &= ~gone[:-1] | edge[1:-1]
        ends[:-1] &= ~gone[1:] | edge[1:-1]
        low, high = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        row = np.searchsorted(s.offsets, low, side="right") - 1
        runs = pa.StructArray.from_arrays([pa.array(low - s.offsets[row]), pa.array(high - s.offsets[row])], names=["start", "end"])
        runs = pa.ListArray.from_arrays(np.searchsorted(low, s.offsets).astype(np.int32), runs)
        before = np.concatenate([[0], np.cumsum(~gone)])[s.offsets]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(before) - 1, [None, pa.py_buffer(before.astype(np.int64)), pa.py_buffer(s.buf[~gone])])
        yield block.rows.append_column("kept", kept.cast(pa.binary())).append_column("removed", runs)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return exchange.scan(df, f"{fields}, kept binary, removed array<struct<start: bigint, end: bigint>>", third, BLOCK_BYTES)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_repeats(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
