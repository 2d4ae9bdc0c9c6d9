"""Name similarity (Arrow batches). Spark's levenshtein is a different measure."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - indel distance / total length) = 200 * LCS / (len a + len b)."""
    if not a and not b:
        return 100.0
    # bit-parallel longest common subsequence: a zero bit per matched position of a
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_places = full
    for letter in b:
        here = open_places & places.get(letter, 0)
        open_places = ((open_places + here) | (open_places - here)) & full
    common = len(a) - open_places.bit_count()
    return 200.0 * common / (len(a) + len(b))


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(
        [None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64"
    )


@cache
def _udf():
    return F.pandas_udf(_ratios, T.DoubleType())


def ratio(a: Column, b: Column) -> Column:
    return _udf()(a, b)


def ratio_once(a: Column, b: Column) -> Column:
    """The ratio, in a form that a filter on it never moves below the ``distinct`` of the pairs, where it would be
    computed for every repeat of a pair and once more above. Same value in every run."""
    return F.pandas_udf(_ratios, T.DoubleType()).asNondeterministic()(a, b)


def subsequences(length: Column, keep: Column) -> Column:
    """Number of ways to keep ``keep`` of ``length`` letters, as a double."""
    return F.aggregate(
        F.when(keep > 0, F.sequence(F.lit(1), keep)).otherwise(F.array().cast("array<int>")),
        F.lit(1.0), lambda n, i: n * (length - keep + i) / i,
    )


def _cuts(text: pd.Series, prefix: pd.Series, tags: pd.Series, keeps: pd.Series) -> pd.Series:
    out = []
    for value, skip, names, lengths in zip(text, prefix, tags, keeps, strict=True):
        letters, made, keys = value[skip:], {}, []
        for tag, keep in zip(names, lengths, strict=True):
            if keep < 0:
                keys.append(tag)
                continue
            if keep not in made:
                made[keep] = {"".join(c) for c in combinations(letters, keep)}
            keys += [tag + c for c in made[keep]]
        out.append(keys)
    return pd.Series(out)


@cache
def _cuts_udf():
    return F.pandas_udf(_cuts, T.ArrayType(T.StringType()))


def cuts(text: Column, prefix: Column, tags: Column, keeps: Column) -> Column:
    """Every tag with every subsequence of its length of the text after the prefix; a negative length is the tag alone."""
    return _cuts_udf()(text, prefix, tags, keeps)


def token_sort(value: Column) -> Column:
    return F.array_join(F.array_sort(F.split(value, " ")), " ")


def best_ratio(a: Column, b: Column) -> Column:
    """The better of the plain and the word-order-free ratio."""
    return F.greatest(ratio(a, b), ratio(token_sort(a), token_sort(b)))


def best_of(a: str, b: str) -> float:
    """``best_ratio`` of two texts."""
    x, y = " ".join(sorted(a.split(" "))), " ".join(sorted(b.split(" ")))
    plain = indel_ratio(a, b)
    return plain if x == a and y == b else max(plain, indel_ratio(x, y))


def _best_ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else best_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def best_ratio_once(a: Column, b: Column) -> Column:
    """``best_ratio`` as ``ratio_once``."""
    return F.pandas_udf(_best_ratios, T.DoubleType()).asNondeterministic()(a, b)


def _letters(texts: list[str]) -> np.ndarray:
    """How often each text has each letter, one row for each letter that occurs; for ASCII texts."""
    counts = np.zeros((128, len(texts)), np.int16)
    for i, text in enumerate(texts):
        np.add.at(counts[:, i], np.frombuffer(text.encode("ascii"), np.uint8), 1)
    return counts


def _bound(shared: np.ndarray, length: np.ndarray) -> np.ndarray:
    """No ratio, plain or of sorted words, is higher for texts of that total length with so many letters in common."""
    return np.where(length == 0, 100.0, 200.0 * shared / np.maximum(length, 1))


def weighted_matches(group: pd.DataFrame, threshold: float, name_cutoff: float, slab: int = 1 << 21) -> pd.DataFrame:
    """Pairs of triples of one sire (rows without and with right_id) whose weighted score reaches the threshold.

    Letters in common bound the ratios, so all but few pairs are left out by counts before they are compared."""
    out: list[tuple] = []
    for father, rows in group.groupby("l_father_name", sort=False):
        right = rows["_n"].notna().to_numpy()
        if right.all() or not right.any():
            continue
        sides = []
        for mask in (~right, right):
            names, mothers = rows["_name"][mask].tolist(), rows["_mother"][mask].tolist()
            sides.append((names, mothers, _letters(names), _letters(mothers), np.array([len(x) for x in names]), np.array([len(x) for x in mothers])))
        (ln, lm, lnc, lmc, lnl, lml), (rn, rm, rnc, rmc, rnl, rml) = sides
        fs, ids, ns = rows["_f"][right].to_numpy(), rows["right_id"][right].tolist(), rows["_n"][right].tolist()
        step = max(1, slab // len(rn))
        for low in range(0, len(ln), step):
            part = slice(low, low + step)
            shared = np.zeros((len(ln[part]), len(rn)), np.int16)
            for c in np.flatnonzero(lnc[:, part].any(axis=1) & rnc.any(axis=1)):
                shared += np.minimum(lnc[c, part][:, None], rnc[c][None, :])
            name = _bound(shared, lnl[part][:, None] + rnl[None, :])
            x, y = np.nonzero((name >= name_cutoff - 1e-9) & (0.55 * name + 0.225 * fs[None, :] + 22.5 >= threshold - 1e-9))
            name, x = name[x, y], x + low
            for at in range(0, len(x), 1 << 16):
                i, j = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                mother = _bound(np.minimum(lmc[:, i], rmc[:, j]).sum(axis=0), lml[i] + rml[j])
                may = 0.55 * name[at : at + (1 << 16)] + 0.225 * fs[j] + 0.225 * mother >= threshold - 1e-9
                for i, j, most in zip(i[may].tolist(), j[may].tolist(), mother[may].tolist(), strict=True):
                    n = best_of(ln[i], rn[j])
                    if n < name_cutoff or 0.55 * n + 0.225 * fs[j] + 0.225 * most < threshold - 1e-9:
                        continue
                    score = 0.55 * n + 0.225 * float(fs[j]) + 0.225 * best_of(lm[i], rm[j])
                    if score >= threshold:
                        out.append((ln[i], father, lm[i], ids[j], int(ns[j]), score))
    return pd.DataFrame(out, columns=["l_name", "l_father_name", "l_mother_name", "right_id", "_n", "score"])


def _window(short: str, long: str) -> float:
    """Best ratio of the shorter text with any stretch of the longer one of its length, the ends included."""
    n, best = len(short), 0.0
    letters = set(short)
    for low in range(1 - n, len(long)):
        stretch = long[max(low, 0) : low + n]
        # A best stretch ends, or at an end of the text begins, with a letter of the shorter text.
        edge = stretch[-1] if low + n <= len(long) else stretch[0]
        if edge in letters:
            best = max(best, indel_ratio(short, stretch))
            if best == 100.0:
                break
    return best


def best_window(a: str, b: str) -> float:
    """Ratio of the shorter text with the most similar stretch of the longer one."""
    if not a and not b:
        return 100.0
    if not a or not b:
        return 0.0
    if len(a) == len(b):
        return max(_window(a, b), _window(b, a))
    return _window(a, b) if len(a) < len(b) else _window(b, a)


def token_set(a: str, b: str) -> float:
    """Ratio by words: common words against common and own words of each side; 100 where all words of
    one side are common, 0 where a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, own, other = x & y, x - y, y - x
    if common and not (own and other):
        return 100.0
    left, right = " ".join(sorted(own)), " ".join(sorted(other))
    best = 0.0
    base = " ".join(sorted(common))
    with_left, with_right = f"{base} {left}".strip(), f"{base} {right}".strip()
    best = indel_ratio(with_left, with_right)
    if common:
        best = max(best, indel_ratio(base, with_left), indel_ratio(base, with_right))
    return best


def composite_ratio(a: str, b: str) -> float:
    """The best of several ratios, each with the weight of its trust.

    The plain ratio counts fully. Of lengths less than 1.5 times apart, sorted words and common
    words count 0.95. Beyond, the best window counts 0.9 (0.6 from 8 times on), and so many times
    0.95 the windows of sorted words and of words that only one side has. An empty text scores 0."""
    if not a or not b:
        return 0.0
    sorted_a, sorted_b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    plain = indel_ratio(a, b)
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < 1.5:
        return max(plain, 0.95 * indel_ratio(sorted_a, sorted_b), 0.95 * token_set(a, b))
    scale = 0.9 if apart < 8.0 else 0.6
    x, y = set(a.split()), set(b.split())
    if x & y:
        by_words = 100.0
    else:
        by_words = best_window(" ".join(sorted(x - y)), " ".join(sorted(y - x))) if x and y else 0.0
    return max(plain, scale * best_window(a, b), 0.95 * scale * max(best_window(sorted_a, sorted_b), by_words))


def _composites(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else composite_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@cache
def _composite_udf():
    return F.pandas_udf(_composites, T.DoubleType())


def composite_once(a: Column, b: Column) -> Column:
    """``composite`` as ``ratio_once``."""
    return F.pandas_udf(_composites, T.DoubleType()).asNondeterministic()(a, b)


def composite(a: Column, b: Column) -> Column:
    """Composite score 0 to 100 of two names; see composite_ratio."""
    return _composite_udf()(a, b)
