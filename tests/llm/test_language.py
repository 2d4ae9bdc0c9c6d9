import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from llm_tables import table  # noqa: F401
from furlong.llm import langid, pitmanyor
from furlong.llm.spans import LOWER_VALUE, hash_spans, mix

SCHEMA = "doc_id long, text string, lang string, score string"


def labelled(n=60):
    draw = random.Random(4)
    kinds = {"en": "the of and thing where with house".split(), "de": "der und ist straße nicht über haus".split(), "fr": "le est été dans maison où être".split()}
    rows = [(i, " ".join(draw.choices(kinds[k], k=draw.randint(3, 30))) + draw.choice(["", "!", " 12"]), k, "x") for i, k in ((i, list(kinds)[i % 3]) for i in range(n))]
    return [*rows, (n, None, "en", None), (n + 1, "", "de", None), (n + 2, "12 !?", "fr", None), (n + 3, "the house " * 5000, None, None), (None, "die straße ist nicht", None, None)]


def test_languages_are_told_apart_and_odd_texts_are_und(table):
    df = table(labelled(), SCHEMA)
    out = langid.predict(df, langid.fit(df.where("doc_id < 40"))).toPandas()
    assert len(out) == df.count() and out.score.between(0, 1).all()
    test = out[(out.doc_id >= 40) & (out.doc_id < 60)]
    assert (test.lang == test.lang_pred).all()
    assert set(out[out.doc_id.isin([60, 61, 62])].lang_pred) == {"und"}
    assert out[out.doc_id == 63].lang_pred.item() == "en" and out[out.doc_id.isna()].lang_pred.item() == "de"
    nothing = langid.predict(df, langid.fit(df.limit(0))).toPandas()
    assert set(nothing.lang_pred) == {"und"} and (nothing.score == 0).all()


def test_code_lengths_are_those_of_the_context_trees():
    texts = {"a": ["abab ba", "abc"], "b": ["xyz abx"]}
    model = langid.Model({k: langid.tree(pa.array(v)) for k, v in texts.items()})
    probe = "abq xyz"
    bits, n = model.code_lengths(pa.array([probe]))
    assert n[0] == len(probe)
    for k, name in enumerate(model.languages):
        seen = Counter()
        for t in texts[name]:
            t = "   " + t
            for i in range(3, len(t)):
                for order in range(4):
                    seen[t[i - order : i], t[i]] += 1
        total = 0.0
        coded = "   " + probe
        for i in range(3, len(coded)):
            for order in range(3, -2, -1):
                if order < 0:
                    total += 8
                    break
                context = coded[i - order : i]
                followers = {s: c for (x, s), c in seen.items() if x == context}
                size, kinds = sum(followers.values()), len(followers)
                if coded[i] in followers:
                    total -= math.log2(followers[coded[i]] / (size + kinds))
                    break
                if size:
                    total -= math.log2(kinds / (size + kinds))
        assert abs(bits[0][k] - total) < 1e-3


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def test_one_sweep_against_a_plain_model(table, monkeypatch):
    """The same seating in dictionaries gives the same scores, and probabilities that sum to one."""
    monkeypatch.setattr(pitmanyor, "SWEEPS", 1)
    draw = random.Random(5)
    after = {"a": "b", "b": "c", "c": "a", "The": "cat", "cat": "sat", "sat": "The"}

    def walk(n):
        w = draw.choice(list(after))
        for _ in range(n):
            yield w
            w = after[w] if draw.random() < 0.8 else draw.choice(list(after))

    rows = [(i, " ".join(walk(draw.randint(0, 30))), None, None) for i in range(50)]
    rows += [(50, None, None, None), (51, "", None, None), (52, "new words only", None, None), (3, rows[3][1], None, None), (None, "the cat", None, None)]
    out = pitmanyor.score(table(rows, SCHEMA), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1).toPandas()
    assert len(out) == len(rows)
    train = [tokens(t) for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t)
    total, kinds = sum(count.values()), len(count)
    pairs, contexts = Counter(), Counter()
    for t in train:
        for before, w in zip(["begin", *t[:-1]], t, strict=True):
            pairs[before, w] += 1
            contexts[before] += 1

    def key(w):
        if w is None or w == "begin":
            return pitmanyor._END if w is None else pitmanyor._BEGIN
        return hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]), LOWER_VALUE)[0]

    def of(counts):
        return pitmanyor.discount_of(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))

    def seat(customers, opening, discount, name):
        return pitmanyor.seat(np.array([float(customers)]), np.array([opening]), discount, np.array([name], np.uint64), 0)[0]

    d = of(pairs)
    base = lambda w: (count[w] + 0.5) / (total + 0.5 * (kinds + 1))
    seats, tables, dishes = {}, Counter(), Counter()
    for (u, w), c in pairs.items():
        name = mix(np.array([key(u)]) * np.uint64(0x9E3779B97F4A7C15) + np.array([key(w)]))[0]
        seats[u, w] = seat(c, (1 + d * contexts[u] * d) * base(w), d, name)
        tables[u] += seats[u, w]
        dishes[w] += seats[u, w]
    d0, customers = of(dishes), sum(dishes.values())
    inner = {w: seat(c, (1 + d * kinds) / (kinds + 1), d, key(w)) for w, c in dishes.items()}

    def parent(w):
        return (max(dishes[w] - d0 * inner.get(w, 0), 0) + (1 + d0 * sum(inner.values())) / (kinds + 1)) / (1 + customers)

    def chance(u, w):
        if not contexts[u]:
            return parent(w)
        return (max(pairs[u, w] - d * seats.get((u, w), 0), 0) + (1 + d * tables[u]) * parent(w)) / (1 + contexts[u])

    vocabulary = [*count, b"unknown"]
    for u in ["begin", b"a", b"the", b"unknown"]:
        assert abs(sum(chance(u, w) for w in vocabulary) - 1) < 1e-9
    for row in out.itertuples():
        t = tokens(next(t for i, t, *_ in rows if i == row.doc_id or i is None and row.doc_id != row.doc_id))
        assert row.n_tokens == len(t) and row.n_known == sum(count[w] > 0 for w in t) and row.train_tokens == total
        assert abs(row.base_score - sum(math.log10(base(w)) for w in t)) < 1e-8
        assert abs(row.score - sum(math.log10(chance(u, w)) for u, w in zip(["begin", *t[:-1]], t, strict=True))) < 1e-6
    assert out[out.held_out].score.sum() > out[out.held_out].base_score.sum()


def test_sweeps_are_averaged_and_an_empty_table_is_empty(table):
    df = table(labelled(), SCHEMA)
    out = pitmanyor.score(df, F.col("doc_id") % 5 == 1).toPandas()
    assert len(out) == df.count() and np.isfinite(out.score).all() and (out.score < 0).all()
    assert out[out.held_out].score.sum() > out[out.held_out].base_score.sum()
    assert pitmanyor.score(df.where("doc_id > 1000"), F.col("doc_id") > 0).count() == 0


def test_seating_is_bounded_and_exact_for_ones():
    keys = mix(np.arange(1000, dtype=np.uint64))
    customers = np.concatenate([np.zeros(10), np.ones(10), np.full(980, 5000.0)])
    tables = pitmanyor.seat(customers, np.full(1000, 2.0), 0.5, keys, 0)
    assert (tables[:10] == 0).all() and (tables[10:20] == 1).all() and (tables <= np.maximum(customers, 0)).all()
    assert (pitmanyor.seat(customers, np.full(1000, 2.0), 0.5, keys, 0) == tables).all()
    assert (pitmanyor.seat(customers, np.full(1000, 2.0), 0.5, keys, 1) != tables).any()


def test_seating_is_that_of_customers_who_come_one_by_one():
    rng = np.random.default_rng(3)
    for opening, d in ((2.0, 0.5), (0.3, 0.8)):
        tables = pitmanyor.seat(np.full(4000, 2000.0), np.full(4000, opening), d, mix(np.arange(4000, dtype=np.uint64)), 0)
        plain = np.ones(4000)
        for seated in range(1, 2000):
            plain += rng.random(4000) < opening / (opening + seated - d * plain)
        assert abs(tables.mean() / plain.mean() - 1) < 0.02
