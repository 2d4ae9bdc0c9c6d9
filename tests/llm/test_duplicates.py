import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_tables import table  # noqa: F401
from furlong.llm import components, exchange, jaccard, repeats, spotsigs

SCHEMA = "doc_id long, text string, kept string, row string"


def corpus(seed=1, families=6, members=8):
    """Near copies with one to many edits, exact copies, passages in common, and odd rows."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(draw.choice([3, 6, 12, 40, 90, 200, 400]))]
        for k in range(members):
            mine = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // draw.choice([12, 30, 60])))):
                mine[draw.randrange(len(mine))] = word()
            if k == 3:
                mine[len(mine) // 2 : len(mine) // 2] = passage.split()
            texts.append((" " if k % 2 else "\n").join(mine))
    texts += [texts[0], texts[0].upper(), texts[9], None, "", "one two", "ONE two", "x" * 199, "y" * 450, "z" * 30000, None, ""]
    draw.shuffle(texts)
    return [(i, t, "clash", None) for i, t in enumerate(texts)] + [(None, texts[2], None, None), (3, texts[3], None, None)]


def removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(gone))
    return out


@pytest.mark.parametrize("length", [200, 50, 9])
def test_difference_cover(length):
    v, cover = repeats.difference_cover(length)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and 3 * v <= 2 * length


@pytest.mark.parametrize(("length", "block"), [(200, 1 << 24), (50, 2000), (21, 500)])
def test_repeats_against_brute_force(table, monkeypatch, length, block):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", block)
    monkeypatch.setattr(exchange, "STEP_ROWS", 7)
    rows = corpus()
    out = repeats.find_repeats(table(rows, SCHEMA), length=length).toPandas()
    texts = [(t or "").encode() for _, t, *_ in rows]
    want = sorted((-1 if i is None else i, b"".join(t[k : k + 1] for k in range(len(t)) if not g[k]), len([1 for k in range(len(g)) if g[k] and (not k or not g[k - 1])])) for (i, *_), t, g in zip(rows, texts, removed(texts, length), strict=True))
    got = sorted((-1 if i != i else int(i), bytes(k), len(r)) for i, k, r in zip(out.doc_id, out.kept, out.removed, strict=True))
    assert got == want


def test_repeats_of_characters_and_nothing(table):
    df = table([(1, "é" * 150 + "x", None, None), (2, "y" + "é" * 150, None, None)], SCHEMA)
    out = repeats.find_repeats(df, characters=True).toPandas()
    assert sorted(bytes(k).decode() for k in out.kept) == ["x", "y"]
    assert repeats.find_repeats(df.limit(0)).count() == 0
    assert repeats.op4_suffix_dedup.__doc__


def sets_of(rows):
    out = []
    for _, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [least[find(i)] for i in range(len(rows))], sets


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(table, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(exchange, "STEP_ROWS", 9)
    rows = corpus(seed, 8, 9)
    df = table(rows, SCHEMA)
    out = jaccard.near_duplicates(df).toPandas()
    want, sets = brute_components(rows)
    none = lambda x: -1 if x is None or x != x else int(x)
    assert sorted((none(k), s, none(c)) for k, s, c in zip(out.key, out["size"], out.component_id, strict=True)) == sorted((none(r[0]), len(s), none(c)) for r, s, c in zip(rows, sets, want, strict=True))
    kept = jaccard.keep_first(df).toPandas()
    alone = sum(not s for s in sets)
    assert len(kept) == len({c for c, s in zip(want, sets, strict=True) if s}) + alone and list(kept.columns) == df.columns
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_hub_rounds_and_blocks_agree(table, monkeypatch):
    rows = corpus(5, 4, 9)
    df = table(rows, SCHEMA)
    want = sorted(map(tuple, jaccard.near_duplicates(df).select("row", "component_id").fillna(-1).collect()))
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    monkeypatch.setattr(jaccard, "COLUMNS", 50)
    assert sorted(map(tuple, jaccard.near_duplicates(df).select("row", "component_id").fillna(-1).collect())) == want


@pytest.mark.parametrize("size", [1, 4, 5, 9, 10, 27, 60, 64, 65, 130, 700])
def test_linked_sets_share_a_probed_key(size):
    draw = np.random.default_rng(size)
    for _ in range(20):
        x = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
        most = jaccard.differ_most(size, 80, 100)
        drop = int(draw.integers(0, most + 1))
        y = np.unique(np.concatenate([x[draw.permutation(size)[drop // 2 + drop % 2 :]], draw.integers(0, 2**64, drop // 2, dtype=np.uint64)]))
        common = len(np.intersect1d(x, y))
        if not len(y) or 100 * common < 80 * (size + len(y) - common):
            continue
        (kx, px), (ky, _) = jaccard.keys_of(x), jaccard.keys_of(y)
        assert np.isin(kx[px], ky).any()


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(draw.randint(300, 399), draw.randint(300, 399)) for _ in range(80)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    parent = {x: x for e in edges for x in e}
    for _ in range(len(parent)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: p for x, p in parent.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_exchange_codes_keys_and_refuses_other_blocks(table):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (exchange.thick(exchange.thin(keys)) == keys).all()
    bounds = exchange.part_bounds(keys, 7)
    assert bounds[0] == 0 and bounds[-1] == 1000 and (np.diff(bounds) > 80).all()


def test_spot_signatures_and_next_rows(table):
    rows = [(1, "The cat sat on the mat and dogs ran", None, None), (2, None, None, None), (3, "", None, None), (4, "!!!", None, None), (900, "The cat sat on the mat and dogs ran", None, None), (5000, "of the", None, None), (None, "alone", None, None)]
    df = table(rows, SCHEMA).withColumn("s", spotsigs.signatures(F.col("text")))
    got = {r.doc_id: r.s for r in df.collect()}
    assert got[1] == got[900] and len(got[1]) == 3 and got[2] == got[3] == [] and len(got[4]) == len(got[5000]) == 1
    order = spotsigs.with_next(df, "doc_id", ["text"]).toPandas()
    follow = {(-1 if a != a else int(a)): (-1 if b != b else int(b)) for a, b in zip(order.doc_id, order.next_doc_id, strict=True)}
    assert follow == {5000: 900, 900: 4, 4: 3, 3: 2, 2: 1, 1: -1, -1: 5000}


def test_texts_without_listed_anchors(table):
    words = [f"слово{i}" for i in range(40)]
    other = [f"другое{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:20] + other[:20]), " ".join(words[:-1]), "10 20 30 40", "10 20 30 50", "the " + " ".join(other) + " and more", " ".join(f"{i}" for i in range(20000))]
    df = table([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA).withColumn("signatures", spotsigs.signatures(F.col("text")))
    sets = {r.doc_id: set(r.signatures) for r in df.collect()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert [len(sets[i]) for i in range(6)] == [39, 39, 38, 3, 3, 39] and len(sets[6]) > 19990  # of 32 bits
    assert like(0, 1) == 19 / 59 and like(0, 2) == 38 / 39 and like(3, 4) == 0.5
    members, pairs = spotsigs.similar_pairs(df, 0.8)
    assert all(r.doc_id == r["class"] for r in members.collect()) and {(r.a, r.b) for r in pairs.collect()} == {(0, 2)}


def test_edited_texts(spark, table, tmp_path):
    rows = [(i, t, None, None) for i, (_, t, *_) in enumerate(corpus(3, 4, 6))]
    path = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(path / "documents.parquet"))
    out = spotsigs.op10_fingerprints(spark, str(path)).toPandas().set_index("doc_id")
    for i, t, *_ in rows:
        t, n = t or "", (rows[i - 1][1] or "")
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert out.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and out.n_chars[i] == len(t)
        a, b, c = (set(x.split()) for x in (out.fingerprint[i], out.edited_fingerprint[i], out.fingerprint[(i - 1) % len(rows)]))
        for other, value in ((b, out.near_edited[i]), (c, out.near_next[i])):
            assert abs(value - (len(a & other) / len(a | other) if a | other else 1.0)) < 1e-12


def test_similar_fingerprints_against_brute_force(table):
    df = table(corpus(2), SCHEMA).where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("signatures", spotsigs.signatures(F.col("text")))
    members, pairs = spotsigs.similar_pairs(df, 0.6)
    sets = {r.doc_id: frozenset(r.signatures) for r in df.collect()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert {(r.doc_id, r["class"]) for r in members.collect()} == {(i, first[s]) for i, s in sets.items()}
    names = sorted(first.values())
    want = {(a, b) for a in names for b in names if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_sets_of_a_large_family_are_not_repeated_for_the_blocks_they_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    base = np.arange(1000, 1100, dtype=np.uint64)
    tokens = {i: np.unique(np.concatenate([base[: 100 - i % 9], np.arange(i * 50, i * 50 + 10 + i % 5, dtype=np.uint64)])) for i in range(40)}
    sets = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in tokens.items()], "row long, tokens binary")
    residue = spark.createDataFrame([(i, len(t), i // 2, i // 30) for i, t in tokens.items()], "row long, size long, c long, family long")
    out = jaccard.compare_residue(residue, sets, 80, 100)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    common = lambda x, y: len(np.intersect1d(tokens[x], tokens[y]))
    linked = lambda x, y: 100 * common(x, y) >= 80 * (len(tokens[x]) + len(tokens[y]) - common(x, y))
    want = {(x, y) for x in tokens for y in tokens if x < y and x // 30 == y // 30 and x // 2 != y // 2 and linked(x, y)}
    assert {tuple(sorted(r)) for r in out.collect()} == want and 0 < len(want) < 400
