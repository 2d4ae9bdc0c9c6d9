"""Asking all blocks of a corpus about 64-bit keys, without a row for each key.

A task of a scan handles its rows in blocks of bounded size. For each part of the key space a block
sends one compact row with its distinct keys, sorted, and some bytes about each. One task for each
part sees every block's row and answers with some bytes for each key, in the same order. The
answers are stored by block in the shared folder, and the next scan of the same table reads those
of its own blocks. A key that is everywhere comes once from each block, so no part outgrows a task.

Both scans must cut the table into the same blocks. The table must be read from files, and
spark.sql.files.minPartitionNum is pinned, since the number of executors would else change the
cut. A check value travels with each question; an answer that meets another block is an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.storage import give_back, new_path

#: Text of a block, and text behind one part of the keys, in bytes.
BLOCK_BYTES, PART_BYTES = 12 << 20, 32 << 20
#: Rows of a block; row numbers leave room for 1 << 20.
BLOCK_ROWS = 1 << 18
#: A block ends after a multiple of so many rows of its task.
STEP_ROWS = 256
#: Stands for a block in the row of a part's own numbers.
TALLY = -1
ROW = "block long, part int, check long, keys binary, extra binary"


class Block:
    """Consecutive rows of one task."""

    def __init__(self, number: int, rows: pa.Table):
        self.number, self.rows = number, rows.combine_chunks()

    def check(self, column: int) -> int:
        from furlong.llm.spans import column_bytes

        buf, offsets = column_bytes(self.rows.column(column))
        return zlib.crc32(offsets.tobytes(), zlib.crc32(buf[:: max(1, len(buf) // 4096)].tobytes()))


def scan(df: DataFrame, schema: str, work: Callable[[Block], Iterator[pa.RecordBatch | pa.Table]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Run `work` on every block of rows. The first column is the text; it alone, not the other
    columns or the batches Spark makes, decides where blocks end."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for out in work(Block(first + number, pa.Table.from_batches(held))):
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
            give_back()

        seen = rows = 0
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                piece = batch.slice(low, STEP_ROWS - seen % STEP_ROWS)
                low, seen = low + piece.num_rows, seen + piece.num_rows
                held.append(piece)
                size += pc.sum(pc.binary_length(piece.column(0))).as_py() or 0
                rows += piece.num_rows
                if (size >= block_bytes or rows >= BLOCK_ROWS) and seen % STEP_ROWS == 0:
                    yield from flush()
                    number, held, size, rows = number + 1, [], 0, 0
        if held:
            yield from flush()

    return df.mapInArrow(task, schema)


def parts_of(total_bytes: int, part_bytes: int = PART_BYTES) -> int:
    return max(12, -(-int(total_bytes) // part_bytes))


def part_bounds(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where in sorted keys each part starts (parts + 1): parts are equal ranges of the keys."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def thin(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, all first bytes, all second bytes and so on: the high bytes are
    mostly zero and vanish in the compression of a shuffle."""
    return np.diff(keys, prepend=np.zeros(1, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def thick(raw: pa.Buffer) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def questions(block: Block, check: int, keys: np.ndarray, parts: int, extra: np.ndarray | None = None) -> pa.RecordBatch:
    """The rows for sorted distinct keys; extra: one fixed-width record for each key."""
    bounds = part_bounds(keys, parts)
    some = np.flatnonzero(np.diff(bounds))
    raw = [thin(keys[bounds[p] : bounds[p + 1]]) for p in some]
    more = [extra[bounds[p] : bounds[p + 1]].tobytes() if extra is not None else b"" for p in some]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(some), block.number)), pa.array(some, pa.int32()), pa.array(np.full(len(some), check, np.int64)), pa.array(raw, pa.binary()), pa.array(more, pa.binary())],
        names=["block", "part", "check", "keys", "extra"],
    )


def answer(asked: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray], extra: str | None = None) -> str:
    """Answer every part and store the answers; returns their path.

    work(keys, extra) gets the keys of all blocks end to end and their records of dtype `extra`,
    and returns one record for each; or a pair, with a list of numbers that tallies() adds up."""

    def part(rows: pa.Table) -> pa.Table:
        keys = [thick(x.as_buffer()) for x in rows["keys"]]
        more = [np.frombuffer(x.as_buffer(), extra) for x in rows["extra"]] if extra else []
        got = work(np.concatenate(keys), np.concatenate(more) if extra else None)
        got, tally = got if isinstance(got, tuple) else (got, [])
        ends = np.cumsum([len(k) for k in keys])
        give_back()
        out = [got[e - len(k) : e].tobytes() for k, e in zip(keys, ends, strict=True)]
        blocks, parts, checks = (rows[c].to_pylist() for c in ("block", "part", "check"))
        return pa.table(
            {
                "block": pa.array([*blocks, TALLY], pa.int64()), "part": pa.array([*parts, parts[0]], pa.int32()), "check": pa.array([*checks, 0], pa.int64()),
                "values": pa.array([*out, b""], pa.binary()), "tally": pa.array([*([None] * len(out)), [float(x) for x in tally]], pa.list_(pa.float64())),
            }
        )

    path = new_path(asked.sparkSession, "answers")
    replies = asked.groupBy("part").applyInArrow(part, "block long, part int, check long, values binary, tally array<double>")
    # One directory for each block; rows of one block come together first, so it has one file.
    replies.withColumn("of", F.col("block")).repartition("of").write.partitionBy("of").option("compression", "zstd").parquet(path)
    return path


def tallies(spark: SparkSession, path: str, n: int) -> list[float]:
    """The n numbers of all parts, added up."""
    rows = spark.read.schema("tally array<double>, of long").parquet(path).where(F.col("of") == TALLY)
    return [x or 0.0 for x in rows.agg(*[F.sum(F.col("tally")[k]).alias(f"t{k}") for k in range(n)]).first()]


def answers(path: str, block: Block, check: int, dtype) -> np.ndarray:
    """The records for a block's sorted distinct keys, in their order."""
    fs, base = pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    folder = pyarrow.fs.FileSelector(f"{base}/of={block.number}", allow_not_found=True)
    tables = [pq.ParquetFile(f.path, filesystem=fs).read(columns=["part", "check", "values"]) for f in fs.get_file_info(folder) if f.path.endswith(".parquet")]
    if not tables:
        return np.zeros(0, dtype)
    rows = pa.concat_tables(tables).sort_by("part")
    if set(rows["check"].to_pylist()) != {check}:
        raise RuntimeError("the table was cut into other blocks than before; read it from files that do not change")
    return np.frombuffer(b"".join(x.as_py() for x in rows["values"]), dtype)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the place of each key among them, and how often each occurs."""
    return np.unique(keys, return_inverse=True, return_counts=True)


def elsewhere(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For the keys of all blocks (each once a block): whether another block has it, or its own
    block has it several times."""
    unique, place, count = np.unique(keys, return_inverse=True, return_counts=True)
    many = count > 1
    np.logical_or.at(many, place[several.astype(bool)], True)
    return many[place]
