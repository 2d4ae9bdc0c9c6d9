"""Operator 9, benchmark decontamination by template canonicalisation.

Texts become sequences of tokens in which numbers, units and names are typed placeholders. Windows
of template tokens of the benchmark meet those of the documents in a hash join. Along one alignment
of a document with an item the values in the slots must be consistent: one value of the item always
stands for one value of the document. So a copied question is found, and also one with other
numbers or names. Windows of plain lower-cased words meet in the same join, so a copy of any item
is found whatever its words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.spans import BYTE_VALUE, LOWER_VALUE, chain, column_bytes, hash_spans, mix

#: Tokens of a window. Items of fewer are searched as a whole: as plain words down to one word, as
#: templates down to LEAST tokens.
WINDOW, LEAST = 8, 4
#: Forms in which texts are compared: as templates, as templates in which a capitalised word at the
#: start of a sentence is a name as well, and as plain lower-cased words.
TEMPLATE, OPENED, PLAIN = 0, 1, 2
#: An item counts as found in a document when this share of its windows is.
COVERAGE = 0.5
#: Bits of the filter that windows of documents pass before the join, and bytes handled at a time.
FILTER_BITS, STEP = 24, 1 << 21

#: Words read as numbers, and units read as such after a number.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half quarter twice"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh kph watt watts volt volts joule joules meter meters metre metres "
    "kilometer kilometers kilometre kilometres centimeter centimeters byte bytes kb mb gb"
).split()

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_BREAK = np.zeros(256, bool)
_BREAK[[*b'.!?:;"|\n']] = True
_NUMBER, _UNIT, _NAME = (mix(np.array([k], np.uint64))[0] for k in (1, 2, 3))


def _hashes_of(words: list[str]) -> np.ndarray:
    buf, offsets = column_bytes(pa.array(words))
    return np.sort(hash_spans(buf, offsets[:-1], offsets[1:], LOWER_VALUE))


_NUMBERS_KNOWN, _UNITS_KNOWN = _hashes_of(NUMBER_WORDS), _hashes_of(UNITS)


def forms(buf: np.ndarray, offsets: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each form its tokens of all rows end to end, the value behind each placeholder (0 for a
    literal token), how many tokens lie before each row (n + 1), and how many template tokens
    before each token."""
    n = len(buf)
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    if not n:
        return {TEMPLATE: none, OPENED: none, PLAIN: none}
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside, digit = _TOKEN[buf], _DIGIT[buf]
    point = np.zeros(n, bool)
    point[1:-1] = ((buf[1:-1] == 44) | (buf[1:-1] == 46)) & digit[:-2] & digit[2:] & ~edge[1:-2] & ~edge[2:-1]
    inside |= point
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        return {TEMPLATE: none, OPENED: none, PLAIN: none}
    word = hash_spans(buf, s, e, LOWER_VALUE)
    digits = np.concatenate([[0], np.cumsum(digit)])
    number = (digits[e] > digits[s]) | np.isin(word, _NUMBERS_KNOWN)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[buf])])
    fresh = np.ones(len(s), bool)  # starts a row or a sentence
    fresh[1:] = (breaks[s[1:]] > breaks[e[:-1]]) | (np.searchsorted(offsets, s[1:], side="right") != np.searchsorted(offsets, s[:-1], side="right"))
    unit = np.zeros(len(s), bool)
    unit[1:] = number[:-1] & ~fresh[1:] & np.isin(word[1:], _UNITS_KNOWN)
    second = buf[np.minimum(s + 1, n - 1)]
    capital = (buf[s] >= 65) & (buf[s] <= 90) & (e - s > 1) & ((second >= 97) & (second <= 122) | (second >= 128))
    capital |= (buf[s] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (e - s > 2)
    capital &= ~number & ~unit
    name = capital & ~fresh
    # At the start of a sentence a word joins a name that follows only if the row has it as a name elsewhere.
    row = np.searchsorted(offsets, s, side="right").astype(np.uint64)
    known = capital & np.isin(word ^ mix(row), (word ^ mix(row))[name])
    plain = np.zeros(len(s), np.uint64)

    def slotted(name: np.ndarray, joins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        # A run of name words is one slot.
        again = np.zeros(len(s), bool)
        again[1:] = name[1:] & name[:-1] & joins[:-1] & ~fresh[1:]
        token = word.copy()
        for found, kind in ((number, _NUMBER), (unit, _UNIT), (name, _NAME)):
            token[found] = kind
        value = np.where(number | unit | name, word | np.uint64(1), np.uint64(0))
        if again.any():
            head = np.flatnonzero(name & ~again)
            tail = np.flatnonzero(name & ~np.append(again[1:], False))
            long = tail > head
            value[head[long]] = hash_spans(buf, s[head[long]], e[tail[long]], BYTE_VALUE) | np.uint64(1)
        kept = ~again
        return token[kept], value[kept], np.searchsorted(s[kept], offsets), kept

    templates = {TEMPLATE: slotted(name, name), OPENED: slotted(capital, name | known)}
    place = np.cumsum(templates[TEMPLATE][3]) - 1
    made = {f: (token, value, starts, place[kept]) for f, (token, value, starts, kept) in templates.items()}
    return made | {PLAIN: (word, plain, np.searchsorted(s, offsets), place)}


def _windows(token: np.ndarray, value: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of windows that lie in one row and hold at least half literal tokens, and their
    hashes. All tokens of the plain form are literal."""
    hashes = chain(token, size)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes
    row = np.searchsorted(starts, np.arange(len(token)), side="right")
    literal = np.concatenate([[0], np.cumsum(value == 0)])
    good = (row[: len(hashes)] == row[size - 1 :]) & (literal[size:] - literal[: len(hashes)] >= -(-size // 2))
    at = np.flatnonzero(good)
    return at, hashes[at]


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of about STEP bytes at a time: number of the first, bytes, offsets."""
    buf, offsets = column_bytes(column)
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + STEP, side="right")) - 1)
        yield i, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def windows(df: DataFrame, text: str, sizes: dict[int, list[int]], allowed: np.ndarray | None = None, whole: bool = False) -> DataFrame:
    """Rows (all columns of df but the text, form, size, at, hash, slots, place, windows) of windows.

    sizes: of the windows of each form. allowed: a filter of 2**FILTER_BITS bits; windows whose hash
    it does not hold cannot match and are left out, and equal plain windows of a row are one. whole:
    each row takes only the largest size that it can fill. place: template tokens of the row before
    the window; windows: rows of this text, form and size."""
    others = [c for c in df.columns if c != text]
    mask = df.sparkSession.sparkContext.broadcast(allowed) if allowed is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, buf, offsets in _pieces(batch.column(text)):
                made = forms(buf, offsets)
                first = made[TEMPLATE][2]
                for form, size in ((f, x) for f in sizes for x in sizes[f]):
                    token, value, starts, place = made[form]
                    length = np.diff(starts)
                    at, hashes = _windows(token, value, starts, size)
                    if mask is not None:
                        bit = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                        held = (mask.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                        at, hashes = at[held], hashes[held]
                    row = np.searchsorted(starts, at, side="right") - 1
                    if whole:
                        good = (length[row] >= size) & ((size == max(sizes[form])) | (length[row] == size))
                        at, hashes, row = at[good], hashes[good], row[good]
                    if mask is not None and form == PLAIN:
                        once = np.sort(np.unique(np.stack([row.astype(np.uint64), hashes]), axis=1, return_index=True)[1])
                        at, hashes, row = at[once], hashes[once], row[once]
                    if not len(at):
                        continue
                    width = 0 if form == PLAIN else size
                    slots = value[at[:, None] + np.arange(width)].astype(np.int64)
                    out = batch.select(others).take(pa.array(row + base))
                    slots = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * np.int32(width), pa.array(slots.ravel()))
                    for name, col in (
                        ("form", pa.array(np.full(len(at), form))), ("size", pa.array(np.full(len(at), size))), ("at", pa.array(at - starts[row])), ("hash", pa.array(hashes.astype(np.int64))),
                        ("slots", slots), ("place", pa.array(place[at] - first[row])), ("windows", pa.array(np.bincount(row)[row])),
                    ):
                        out = out.append_column(name, col)
                    yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text)
    return df.mapInArrow(cut, f"{fields}, form long, size long, at long, hash long, slots array<long>, place long, windows long")


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Rows (key, text_hash, item, kind, matched, windows, coverage, at) of documents that hold an item.

    kind: `exact` if the words or all slot values are the item's, else `reparameterised`. An item is
    found as plain words, whatever they are, or as a template, in which capitalised words at the start of
    a sentence are all literal or all names. windows: of the item in the form in
    which it was found; of a template only those with at least half literal tokens, as others say too
    little to be searched. matched: how many of them were found at consistent alignments; at: first
    template token of the passage in the document. Items of equal text are one item, named by the
    least key. Null texts and texts without a word match nothing; an item of fewer than LEAST
    template tokens, or without a window of enough literal ones, is found as plain words only.
    Other columns are ignored."""
    items = items.where(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("t")).agg(F.min(item_key).alias("item"))
    bench = windows(items.select("item", "t"), "t", {**dict.fromkeys((TEMPLATE, OPENED), list(range(LEAST, WINDOW + 1))), PLAIN: list(range(1, WINDOW + 1))}, whole=True)
    mine = bench.select("item", "form", "size", "hash", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "windows")
    # The filter is a bitmap of fixed size, built from the distinct places that windows take.
    places = bench.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).alias("p"), "form", "size").distinct().toPandas()
    allowed = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    place = places["p"].to_numpy(np.int64)
    np.bitwise_or.at(allowed, place >> 3, (1 << (place & 7)).astype(np.uint8))
    sizes = {int(f): sorted({int(s) for s in part}) for f, part in places.groupby("form")["size"]} or {PLAIN: [WINDOW]}
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    theirs = windows(source, "t", sizes, allowed).drop("windows")
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda x: x["item_slots"] != 0)
    # Plain windows of a row were made one, so their distance says nothing; they are consistent anyhow.
    shift = F.when(F.col("form") != PLAIN, F.col("at") - F.col("item_at"))
    met = theirs.join(mine, ["form", "size", "hash"]).withColumn("pairs", pairs).withColumn("shift", shift)
    aligned = met.groupBy("key", "text_hash", "item", "form", "windows", "shift").agg(
        F.collect_set("item_at").alias("found"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.min("place").alias("at")
    )
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["item_slots"])))
    same = F.forall("pairs", lambda x: x["item_slots"] == x["slots"])
    whole = aligned.where(consistent).withColumn("same", same).groupBy("key", "text_hash", "item", "form", "windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("matched"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("same"), F.col("found")))))).alias("matched_same"), F.min("at").alias("at"),
    )
    enough = F.lit(coverage) * F.col("windows")
    held = whole.where(F.col("matched") >= enough).withColumn("exact", F.col("matched_same") >= enough).withColumn("share", F.col("matched") / F.col("windows"))
    best = F.max_by(F.struct("exact", "matched", "windows", "share", "at"), F.struct("exact", "share", -F.col("form"))).alias("b")
    return held.groupBy("key", "text_hash", "item").agg(best).select(
        F.col("key").alias(key), "text_hash", "item", F.when(F.col("b.exact"), "exact").otherwise("reparameterised").alias("kind"),
        F.col("b.matched").cast("long").alias("matched"), "b.windows", F.col("b.share").alias("coverage"), "b.at",
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that hold no item, all their columns as they were. Rows with the same key
    and text share the decision; a null key is a key like others."""
    found = leaks(docs, items, key, text, **options).select(F.col(key).alias("_k"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(found, docs[key].eqNullSafe(found["_k"]) & (F.xxhash64(docs[text]) == found["_h"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, copied or with other numbers and names."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return leaks(docs, items).select("doc_id", F.col("item").alias("item_id"), "kind", "matched", "windows", "coverage", "at")


QUERIES = {"op9_decontamination": op9_decontamination}
