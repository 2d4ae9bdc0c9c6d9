"""Operator 2, language identification by prediction by partial matching.

For each language a context tree over bytes counts which byte followed each context of up to
ORDER bytes. A byte is coded in the longest context that knows it; every longer context that has
been seen is left by an escape (method C: a context with n followers, d of them distinct, escapes
with probability d / (n + d)), and below order 0 all 256 bytes are equally likely. With frozen
statistics the exact code length of a byte depends on the last ORDER bytes only, so the code
lengths of all languages are laid out in tables, and a whole text is a sum of looked-up rows.

The coded stream is the lower-cased text in UTF-8 with every run of bytes other than letters (and
bytes outside ASCII) written as one blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm.spans import Index, column_bytes
from furlong.llm.storage import give_back

ORDER = 3
#: The trees are grown from this many whole labelled texts of each language at most.
SAMPLE_TEXTS = 400
#: Bytes scored at a time.
STEP = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def stream(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of all rows, ORDER blanks before each, and where each row's own bytes and
    the next row's blanks start (2 n numbers)."""
    buf, offsets = column_bytes(pc.utf8_lower(column))
    letter = _LETTER[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offsets[:-1][offsets[:-1] < len(buf)]] = True
    before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    bounds = before[offsets]
    n = len(offsets) - 1
    out = np.full(int(bounds[-1]) + ORDER * n, 32, np.uint8)
    own = np.ones(len(out), bool)
    starts = bounds[:-1] + ORDER * np.arange(1, n + 1)
    for k in range(1, ORDER + 1):
        own[starts - k] = False
    out[own] = np.where(letter, buf, 32)[keep]
    return out, np.column_stack([starts, starts + np.diff(bounds)]).ravel()


def grams(coded: np.ndarray, positions: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes that end at each position, as one number."""
    out = np.zeros(len(positions), np.uint64)
    for k in range(size - 1, -1, -1):
        out = out << np.uint64(8) | coded[positions - k]
    return out


def tree(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For sizes 1 .. ORDER + 1 the strings of that many bytes and how often they occur."""
    coded, bounds = stream(column)
    positions = np.flatnonzero(np.bincount(bounds, np.tile([1, -1], len(bounds) // 2), len(coded) + 1).cumsum()[:-1] > 0.5)
    return [np.unique(grams(coded, positions, size), return_counts=True) for size in range(1, ORDER + 2)]


class Model:
    """Code lengths in bits of every language, from the trees of all of them."""

    def __init__(self, trees: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.languages = sorted(trees)
        width = len(self.languages)
        # Order 0 over the uniform order -1, one row for each byte.
        self.bits = [np.full((256, width), 8.0)]
        self.escape: list[np.ndarray] = []
        self.strings: list[np.ndarray] = [np.arange(256, dtype=np.uint64)]
        self.index: list[Index] = []
        for size in range(1, ORDER + 2):
            strings = np.unique(np.concatenate([trees[x][size - 1][0] for x in self.languages] or [np.zeros(0, np.uint64)]))
            if size == 1:
                strings = np.arange(256, dtype=np.uint64)
            count = np.zeros((len(strings), width))
            for k, x in enumerate(self.languages):
                count[np.searchsorted(strings, trees[x][size - 1][0]), k] = trees[x][size - 1][1]
            context, of = np.unique(strings >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(context), width)), np.zeros((len(context), width))
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                known = -np.log2(count / (total + kinds)[of])
            if size == 1:
                self.bits[0] = np.where(count > 0, known, leave[of] + 8.0)
                self.strings[0], lower = strings, self.bits[0]
                continue
            lower = self.lookup(size - 1, strings & np.uint64((1 << 8 * (size - 1)) - 1))
            self.bits.append(np.where(count > 0, known, leave[of] + lower))
            self.escape.append((context, leave))
            index = Index()
            index.add(strings)
            contexts = Index()
            contexts.add(context)
            self.index.append((index, contexts))
        self.bits = [x.astype(np.float32) for x in self.bits]
        self.escape = [np.vstack([x[1], np.zeros((1, width))]).astype(np.float32) for x in self.escape]

    def lookup(self, size: int, strings: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string of `size` bytes given those before it."""
        if size == 1:
            return self.bits[0][strings.astype(np.int64)]
        index, contexts = self.index[size - 2]
        row = index.find(strings)
        out = self.bits[size - 1][row]
        if (miss := np.flatnonzero(row < 0)).size:
            rest = strings[miss]
            escape = self.escape[size - 2]
            table = np.vstack([escape[1], np.zeros((1, len(self.languages)))]) if isinstance(escape, tuple) else escape
            out[miss] = table[contexts.find(rest >> np.uint64(8))] + self.lookup(size - 1, rest & np.uint64((1 << 8 * (size - 1)) - 1))
        return out

    def code_lengths(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each row in each language, and coded bytes of each row."""
        coded, bounds = stream(column)
        bits = np.zeros((len(bounds) // 2, len(self.languages)))
        for low in range(0, len(coded), STEP):
            at = np.arange(low, min(low + STEP, len(coded)))
            row = np.searchsorted(bounds, at, side="right")
            own = row % 2 == 1
            at, row = at[own], row[own] // 2
            if len(at):
                cost = self.lookup(ORDER + 1, grams(coded, at, ORDER + 1))
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                bits[row[first]] += np.add.reduceat(cost, first, axis=0, dtype=np.float64)
        return bits, bounds[1::2] - bounds[::2]


def fit(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", sample: int = SAMPLE_TEXTS) -> Model:
    """Grow the trees from at most `sample` whole texts of each language, those whose key has the
    least hash; each language's tree is counted in a task of its own. Rows without text or
    language are passed over. Without any usable row the model has no language."""
    usable = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(language).alias("l")).where(F.col("l").isNotNull())
    first = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    chosen = usable.select("l", "k").withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("l", "k").distinct()
    # A repeated key brings all its rows; the second limit keeps the sample bounded.
    texts = usable.where(F.col("t").isNotNull()).join(F.broadcast(chosen), ["l", "k"])
    texts = texts.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))).where(F.col("n") <= sample)

    def grow(group: pa.Table) -> pa.Table:
        parts = [
            pa.table({"l": [group["l"][0].as_py()] * len(strings), "size": [size] * len(strings), "string": strings.astype(np.int64), "n": counts})
            for size, (strings, counts) in enumerate(tree(group["t"].combine_chunks()), 1)
        ]
        return pa.concat_tables(parts)

    found = texts.select("l", "t").groupBy("l").applyInArrow(grow, "l string, size long, string long, n long").toPandas()
    trees = {}
    for name, rows in found.groupby("l"):
        sizes = [rows[rows["size"] == k] for k in range(1, ORDER + 2)]
        trees[name] = [(x["string"].to_numpy(np.uint64), x["n"].to_numpy()) for x in (y.sort_values("string") for y in sizes)]
    return Model(trees)


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and bits_per_byte to every row.

    score: the probability of the best language if all are equally likely beforehand. Null or
    letterless text, or a model without languages: `und`, 0. Ties go to the first name. Columns
    with these names are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    df = df.drop("lang_pred", "score", "bits_per_byte")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = np.array([*known.languages, "und"], object)
        for batch in batches:
            size = np.asarray(pc.fill_null(pc.binary_length(batch.column("_text")), 0))
            part = np.cumsum(size) // (4 * STEP)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                piece = batch.slice(rows[0], len(rows))
                letters = np.asarray(piece.column("_letters").fill_null(False).to_numpy(zero_copy_only=False), bool)
                if known.languages:
                    bits, n = known.code_lengths(piece.column("_text"))
                    best = bits.argmin(axis=1)
                    chance = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                    rate = bits.min(axis=1) / np.maximum(n, 1)
                else:
                    best, chance, rate, letters = np.zeros(len(rows), int), np.zeros(len(rows)), np.zeros(len(rows)), letters & False
                out = piece.drop_columns(["_text", "_letters"])
                for name, values in (("lang_pred", pa.array(names[np.where(letters, best, -1)], pa.string())), ("score", pa.array(np.where(letters, chance, 0.0))), ("bits_per_byte", pa.array(rate))):
                    out = out.append_column(name, values)
                yield out
        give_back()

    kept = df.withColumns({"_text": F.coalesce(F.col(text), F.lit("")), "_letters": F.col(text).rlike(r"\p{L}")})
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return kept.mapInArrow(judge, f"{columns}, lang_pred string, score double, bits_per_byte double")


def held_out(key: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


QUERIES = {"op2_language": op2_language}
