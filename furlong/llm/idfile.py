"""Operator 6, token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0 is the most frequent), so most take one byte.
Four ranks share a control byte with two bits each, the number of data bytes less one; control
bytes and data bytes are kept apart. A file holds documents in key order:

    magic "FRQ1", uint64 documents, uint64 ids, uint64 data bytes,
    int64 key of each document, int64 ids of each document, control bytes, data bytes

A document's values start at a control byte of their own, which its end may leave part empty.

All numbers are little-endian. The table rank -> id is written beside the files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.storage import new_path, stored
from furlong.llm.tokens import encode_column

MAGIC = b"FRQ1"
#: Ids of a file, about; a file is written and read by one task.
FILE_IDS = 4_000_000
#: For each control byte: the bytes of each of its four values.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
MANIFEST = "path string, bucket long, hot long, n_documents long, n_ids long, n_bytes long"
CODED = ["bucket", "hot", "key", "tie", "n", "coded"]
#: Stands for a null key in a file.
NULL_KEY = -(1 << 63)


def pack_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.asarray(values, "<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    kept = np.arange(4) < size[:, None]
    return control.astype(np.uint8), values.view(np.uint8).reshape(-1, 4)[kept]


def unpack_bytes(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of rows of so many values again: lengths come from a table by control byte, then
    each of the four bytes is taken for all values that have it."""
    n, quads = int(counts.sum()), -(-counts // 4)
    spare = np.repeat(4 * (np.cumsum(quads) - quads) - (np.cumsum(counts) - counts), counts)
    size = LENGTHS[control].reshape(-1)[np.arange(n) + spare]
    at = np.cumsum(size) - size
    out = np.zeros(n, np.uint32)
    for k in range(4):
        has = np.flatnonzero(size > k) if k else slice(None)
        out[has] |= data[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def frequencies(df: DataFrame, path: str, end_id: int, text: str = "text") -> DataFrame:
    """(id, n) over the ids of all texts and the end id after each; a task sends one row for each
    distinct id it has seen. Null is empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(encode_column(batch.column(0), path, end_id)[0], minlength=len(total))
            seen[: len(total)] += total
            total = seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return df.select(text).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, in ascending key order over all files; returns the manifest, one row a file.

    Texts are encoded twice, once to count ids and once to write them, so that only coded bytes are
    shuffled and nothing is kept in between. The rank table has a row for each id of the vocabulary,
    a bound that does not grow with the corpus, so it goes through the driver. Files are ranges of
    the key between quantiles; a key that spans several quantiles gets as many files, dealt by a
    hash of the ids. Rows of one key are ordered by that hash, a null key comes first. Every attempt
    of a task writes files of its own and only files named by the manifest count, so a lost or
    repeated task does no harm. An empty table gives no file."""
    spark = df.sparkSession
    counts = frequencies(df, path, end_id, text).orderBy(F.desc("n"), "id").toPandas()
    ranked = counts["id"].to_numpy(np.uint32)
    rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    n = max(12, -(-int(counts["n"].sum()) // FILE_IDS))
    df = df.select(F.col(key).cast("long").alias("key"), text)
    quantiles = df.stat.approxQuantile("key", [k / n for k in range(1, n)], 0.25 / n)
    bounds, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
    fs, base = _filesystem(folder)
    fs.create_dir(base)
    with fs.open_output_stream(f"{base}/ranks.bin") as f:
        f.write(ranked.astype("<u4").tobytes())
    shared = spark.sparkContext.broadcast((rank, bounds, times))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bounds, times = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, starts = encode_column(batch.column(1), path, end_id)
            ranks = rank[ids]
            keys = batch.column(0).fill_null(NULL_KEY).to_numpy()
            rows, ties = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                control, data = pack_bytes(ranks[a:b])
                rows.append(control.tobytes() + data.tobytes())
                ties.append(zlib.crc32(rows[-1]))
            bucket = np.searchsorted(bounds, keys)  # the bound itself belongs to the bucket below it
            hot = np.zeros(len(keys), np.int64)
            if len(bounds):
                at = np.minimum(bucket, len(bounds) - 1)
                hot = np.where(bounds[at] == keys, np.array(ties) % times[at], 0)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(hot), pa.array(keys), pa.array(ties, pa.int64()), pa.array(np.diff(starts)), pa.array(rows, pa.binary())], names=CODED)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            place = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                piece = batch.slice(low, high - low)
                if held and [held[-1].column(k)[0] for k in (0, 1)] != [piece.column(k)[0] for k in (0, 1)]:
                    yield _save(held, folder)
                    held = []
                if piece.num_rows:
                    held.append(piece)
        if held:
            yield _save(held, folder)

    coded = df.mapInArrow(encode, "bucket long, hot long, key long, tie long, n long, coded binary")
    ordered = coded.repartition(n, "bucket", "hot").sortWithinPartitions("bucket", "hot", "key", "tie")
    return stored(ordered.mapInArrow(save, MANIFEST), "manifest")


def _save(batches: list[pa.RecordBatch], folder: str) -> pa.RecordBatch:
    """One file of rows that come in order; returns its line of the manifest."""
    rows = pa.Table.from_batches(batches)
    keys, counts = rows["key"].to_numpy(), rows["n"].to_numpy()
    coded, quads = [x.as_buffer() for x in rows["coded"]], (-(-counts // 4)).tolist()
    control = b"".join(memoryview(c)[:q] for c, q in zip(coded, quads, strict=True))
    data = b"".join(memoryview(c)[q:] for c, q in zip(coded, quads, strict=True))
    path = f"{folder}/ids-{rows['bucket'][0]}-{rows['hot'][0]}-{uuid.uuid4().hex}.bin"
    where, name = _filesystem(path)
    with where.open_output_stream(name) as f:
        f.write(MAGIC + np.array([len(keys), counts.sum(), len(data)], "<u8").tobytes())
        for x in (keys.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), control, data):
            f.write(x)
    return pa.RecordBatch.from_pylist([{"path": path, "bucket": rows["bucket"][0].as_py(), "hot": rows["hot"][0].as_py(), "n_documents": len(keys), "n_ids": int(counts.sum()), "n_bytes": len(control) + len(data)}])


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids) of every document from the files: start counts the ids of all
    documents before it."""
    spark = manifest.sparkSession
    before = Window.orderBy("bucket", "hot").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    fs, base = _filesystem(folder)
    with fs.open_input_stream(f"{base}/ranks.bin") as f:
        table = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = _filesystem(path)
                with where.open_input_stream(name) as f:
                    raw = f.read()
                if raw[:4] != MAGIC:
                    raise ValueError(f"{path} is not a file of token ids")
                n, _, size = (int(x) for x in np.frombuffer(raw, "<u8", 3, 4))
                keys, counts = np.frombuffer(raw, "<i8", n, 28), np.frombuffer(raw, "<i8", n, 28 + 8 * n)
                at, quads = 28 + 16 * n, int((-(-counts // 4)).sum())
                ids = table.value[unpack_bytes(np.frombuffer(raw, np.uint8, quads, at), np.frombuffer(raw, np.uint8, size, at + quads), counts)]
                ends = np.cumsum(counts)
                for i in range(0, n, 2000):
                    j = min(n, i + 2000)
                    first = int(ends[i] - counts[i])
                    offsets = np.append(ends[i:j] - counts[i:j], ends[j - 1]) - first
                    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids[first : ends[j - 1]].astype("<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], mask=keys[i:j] == NULL_KEY), pa.array(ends[i:j] - counts[i:j] + start), pa.array(counts[i:j]), body.cast(pa.binary())], names=["key", "start", "n_tokens", "ids"])

    # A task for each file: their number is asked for, since tasks would else be merged by the size of their paths.
    spread = files.select("path", "start").repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(load, "key long, start long, n_tokens long, ids binary")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the files and back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_path(spark, "ids")
    back = read(write(docs, folder, public_tokenizers.path("byte_bpe_50k.json"), 2), folder)
    return back.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op6_token_ids": op6_token_ids}
