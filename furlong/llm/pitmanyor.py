"""Operator 3, language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Each word is the context restaurant of the words that follow it; all context restaurants share one
parent, the restaurant of words without context, whose parent is uniform. Words are customers. A
customer of a context restaurant sits at a table of its dish, or opens one, which sends a customer
to the parent. Each Gibbs sweep seats every dish of every restaurant anew, given the tables of the
last sweep: a customer opens a table in proportion to (strength + discount * tables) * (parent's
probability), and joins one in proportion to (customers - discount * tables) of the dish. Every
sweep's predictive probability is averaged, and a text's score is the log of the averages.

All counts are of all training rows. They live in parts of the key space (see exchange): one key
for each word and for each pair. A seating is drawn from hashes of the pair and the sweep, so every
block that holds a pair finds the same tables; the first block that has it reports them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm import exchange
from furlong.llm.exchange import Block
from furlong.llm.spans import LOWER_VALUE, column_bytes, hash_spans, mix, words

SWEEPS, STRENGTH = 2, 1.0
#: Text of a block in bytes.
BLOCK_BYTES = 16 << 20
_END, _BEGIN = mix(np.array([11, 13], np.uint64))


def uniform(keys: np.ndarray, step: int, sweep: int) -> np.ndarray:
    """Numbers in [0, 1) that key, step and sweep decide."""
    salt = np.uint64((step * 0xD1342543DE82EF95 + (sweep + 1) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    return (mix(keys + salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, keys: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after its customers have come one by one; opening: the weight of a new
    table. Beyond 16, customers come in groups of a sixteenth of those seated, and the tables that
    a group opens are what is expected at its middle, rounded up or down at random."""
    tables = (customers > 0).astype(np.float64)
    left = np.flatnonzero(customers > 1)
    seated, step = np.ones(len(left)), 0
    while len(left):
        group = np.minimum(np.maximum(1, np.floor(seated / 16)), customers[left] - seated)
        new = opening[left] / (opening[left] + seated + (group - 1) / 2 - discount * tables[left])
        tables[left] += np.floor(group * new + uniform(keys[left], step, sweep))
        seated, step = seated + group, step + 1
        more = seated < customers[left]
        left, seated = left[more], seated[more]
    return tables


def discount_of(once: float, twice: float) -> float:
    """From how many dishes were eaten once and twice."""
    return float(np.clip(once / max(once + 2 * twice, 1.0), 0.05, 0.95))


@dataclass
class Totals:
    """Sums over the whole corpus, and where the answers of the finished exchanges are."""

    tokens: float = 0
    kinds: float = 0
    texts: float = 0
    discount: float = 0.5
    word_path: str = ""
    pair_path: str = ""
    #: For each sweep: path, customers and tables of the parent, and its discount.
    sweeps: list[tuple[str, float, float, float]] = field(default_factory=list)
    begin_tables: list[float] = field(default_factory=list)


class _Tokens:
    """The tokens of a block: words and one end for each row, with the token before. What a scan
    does not ask about, words or pairs, is left out."""

    def __init__(self, block: Block, with_words: bool = True, with_pairs: bool = True):
        buf, offsets = column_bytes(block.rows.column(0))
        starts, ends, before = words(buf, offsets)
        rows = len(offsets) - 1
        self.bounds = before + np.arange(rows + 1)
        token = np.empty(len(starts) + rows, np.uint64)
        last = self.bounds[1:] - 1
        own = np.ones(len(token), bool)
        own[last] = False
        token[own], token[last] = hash_spans(buf, starts, ends, LOWER_VALUE), _END
        if with_words:
            self.words, self.word = np.unique(token, return_inverse=True)
        if with_pairs:
            pair = mix(self._before(token, _BEGIN) * np.uint64(0x9E3779B97F4A7C15) + token)
            self.pairs, first, self.pair = np.unique(pair, return_index=True, return_inverse=True)
        if with_words and with_pairs:
            # A context is a place among the words; one past them is the begin.
            self.pair_word, self.pair_context = self.word[first], self._before(self.word, len(self.words))[first]
        train = np.asarray(block.rows.column(1).combine_chunks().fill_null(True).to_numpy(zero_copy_only=False), bool)
        self.train = np.repeat(train, np.diff(self.bounds))

    def _before(self, token: np.ndarray, begin) -> np.ndarray:
        out = np.empty_like(token)
        out[1:] = token[:-1]
        out[self.bounds[:-1]] = begin
        return out


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, where each first stands, the place of every key among them, and the sums
    of their values."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    starts, place = np.flatnonzero(new), np.empty(len(own), np.int64)
    place[order] = np.cumsum(new) - 1
    total = np.add.reduceat(values[order].astype(np.float64), starts, axis=0) if len(starts) else np.zeros((0, values.shape[1]))
    return own[starts], order[starts], place, total


class _Model:
    """What a block knows after the exchanges that are finished."""

    def __init__(self, block: Block, known: Totals, check: int):
        self.tokens = t = _Tokens(block)
        self.known = known
        self.count = exchange.answers(known.word_path, block, check, "<i8").astype(np.float64)
        told = exchange.answers(known.pair_path, block, check, "<i8")
        self.pair_count, self.first = (told >> 1).astype(np.float64), (told & 1).astype(bool)
        self.base = (self.count + 0.5) / (known.tokens + 0.5 * (known.kinds + 1))
        self.customers = np.append(self.count, known.texts)  # of each context restaurant
        begin = np.searchsorted(t.words, _BEGIN)  # asked for among the words, but none of them
        self.told = [np.delete(exchange.answers(path, block, check, "<i8").reshape(-1, 3).astype(np.float64), begin, axis=0) for path, *_ in known.sweeps]
        if len(self.count) != len(t.words) or len(told) != len(t.pairs):
            raise RuntimeError("answers do not fit the block")

    def parent(self, sweep: int) -> np.ndarray:
        """The parent's probability of each word after a sweep; -1: before any."""
        if sweep < 0:
            return self.base
        _, customers, tables, discount = self.known.sweeps[sweep]
        floor = (STRENGTH + discount * tables) / (self.known.kinds + 1)
        return (np.maximum(self.told[sweep][:, 0] - discount * self.told[sweep][:, 1], 0) + floor) / (STRENGTH + customers)

    def tables(self, sweep: int) -> np.ndarray:
        """Tables of each context restaurant after a sweep; -1: a guess."""
        if sweep < 0:
            return self.customers * self.known.discount
        return np.append(self.told[sweep][:, 2], self.known.begin_tables[sweep])

    def seating(self, sweep: int) -> np.ndarray:
        t = self.tokens
        opening = (STRENGTH + self.known.discount * self.tables(sweep - 1)[t.pair_context]) * self.parent(sweep - 1)[t.pair_word]
        return seat(self.pair_count, opening, self.known.discount, t.pairs, sweep)

    def probability(self, sweep: int) -> np.ndarray:
        """Of each pair's word after its context, under one sweep's seating."""
        t, d = self.tokens, self.known.discount
        c, tables = self.customers[t.pair_context], self.tables(sweep)[t.pair_context]
        stay = np.maximum(self.pair_count - d * self.seating(sweep), 0)
        parent = self.parent(sweep)[t.pair_word]
        return np.where(c > 0, (stay + (STRENGTH + d * tables) * parent) / (STRENGTH + c), parent)


SCORES = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    held_out: a column; rows for which it holds are not learned from (null: learned from). score
    and base_score are log10 probabilities of the whole text under the model and under smoothed
    word counts. A null or empty text is one end token. Without training rows all words are
    unknown. df is scanned several times and must be read from files."""
    spark = df.sparkSession
    df = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"), (~held_out).alias("train"), F.col(key).alias("k"))
    size, texts = df.agg(F.sum(F.octet_length("t")), F.sum(F.coalesce(F.col("train"), F.lit(True)).cast("long"))).first()
    parts = exchange.parts_of(size or 0)
    known = Totals(texts=float(texts or 0))

    def ask(work, extra: str, reply) -> str:
        return exchange.answer(exchange.scan(df, exchange.ROW, work, BLOCK_BYTES), reply, extra)

    def ask_words(block: Block) -> Iterator[pa.RecordBatch]:
        t = _Tokens(block, with_pairs=False)
        count = np.bincount(t.word, t.train, len(t.words)).astype("<u4")
        yield exchange.questions(block, block.check(0), t.words, parts, count)

    def count_words(keys: np.ndarray, count: np.ndarray):
        _, _, place, total = _sum_by(keys, count[:, None])
        total = total[:, 0]
        return total.astype("<i8")[place], [total.sum(), (total > 0).sum()]

    known.word_path = ask(ask_words, "<u4", count_words)
    known.tokens, known.kinds = exchange.tallies(spark, known.word_path, 2)

    def ask_pairs(block: Block) -> Iterator[pa.RecordBatch]:
        t = _Tokens(block, with_words=False)
        count = np.bincount(t.pair, t.train, len(t.pairs)).astype("<u4")
        yield exchange.questions(block, block.check(0), t.pairs, parts, count)

    def count_pairs(keys: np.ndarray, count: np.ndarray):
        _, at, place, total = _sum_by(keys, count[:, None])
        total = total[:, 0]
        first = np.zeros(len(keys), np.int64)
        first[at] = 1
        return (total.astype("<i8")[place] << 1) | first, [(total == 1).sum(), (total == 2).sum()]

    known.pair_path = ask(ask_pairs, "<u4", count_pairs)
    known.discount = discount_of(*exchange.tallies(spark, known.pair_path, 2))

    for sweep in range(SWEEPS):

        def ask_tables(block: Block, known=known, sweep=sweep) -> Iterator[pa.RecordBatch]:
            check = block.check(0)
            m = _Model(block, known, check)
            t, mine = m.tokens, np.where(m.first, m.seating(sweep), 0)
            n = len(t.words)
            dishes, contexts = np.bincount(t.pair_word, mine, n), np.bincount(t.pair_context, mine, n + 1)
            # The begin is no word: its tables travel with a key of their own.
            keys = np.append(t.words, _BEGIN)
            order = np.argsort(keys)
            yield exchange.questions(block, check, keys[order], parts, np.column_stack([np.append(dishes, 0), contexts])[order].astype("<u4").view("<u8").ravel())

        def seat_parent(keys: np.ndarray, told: np.ndarray, known=known, sweep=sweep):
            unique, _, place, total = _sum_by(keys, told.view("<u4").reshape(-1, 2))
            customers = total[:, 0]
            d = known.discount
            tables = seat(customers, np.full(len(unique), (STRENGTH + d * known.kinds) / (known.kinds + 1)), d, unique, sweep)
            begin = total[unique == _BEGIN, 1].sum()
            out = np.column_stack([customers, tables, total[:, 1]]).astype("<i8")[place]
            return out.view(PARENT).ravel(), [customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum(), begin]

        path = ask(ask_tables, "<u8", seat_parent)
        customers, tables, once, twice, begin = exchange.tallies(spark, path, 5)
        known.sweeps.append((path, customers, tables, discount_of(once, twice)))
        known.begin_tables.append(begin)

    def last(block: Block) -> Iterator[pa.RecordBatch]:
        m = _Model(block, known, block.check(0))
        t = m.tokens
        chance = np.mean([m.probability(s) for s in range(SWEEPS)], axis=0)
        first = t.bounds[:-1]
        total = lambda x: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        train = block.rows.column(1).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [
                block.rows.column(2).combine_chunks(), pc.invert(train.fill_null(True)), pa.array(np.diff(t.bounds)), pa.array(total((m.count > 0)[t.word].astype(np.int64))),
                pa.array(np.full(len(first), int(known.tokens))), pa.array(total(np.log10(m.base)[t.word])), pa.array(total(np.log10(chance)[t.pair])),
            ],
            names=["k", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return exchange.scan(df, f"k {df.schema['k'].dataType.simpleString()}, {SCORES}", last, BLOCK_BYTES).withColumnRenamed("k", key)


PARENT = np.dtype([("customers", "<i8"), ("tables", "<i8"), ("context", "<i8")])


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of every document under the model of four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)


QUERIES = {"op3_language_model": op3_language_model}
