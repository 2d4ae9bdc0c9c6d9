import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_tables import table  # noqa: F401
from test_duplicates import SCHEMA, corpus
from furlong.llm import bottomk, components, exchange, merkle, packing, prefixtrie, sidetable, spread

none = lambda x: None if x is None or x != x else int(x)


def graph_roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# --- bottom-k sketches ---------------------------------------------------------------------


def sets_of(rows, size):
    out = []
    for _, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("seed", "kept"), [(1, 64), (4, 24)])
def test_sketches_against_brute_force(table, monkeypatch, seed, kept):
    monkeypatch.setattr(bottomk, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(exchange, "STEP_ROWS", 9)
    if kept == 24:  # everything is left to the comparison in blocks
        monkeypatch.setattr(bottomk, "ROUNDS", 0)
        monkeypatch.setattr(bottomk, "BLOCK_SETS", 3)
        monkeypatch.setattr(bottomk, "COLUMNS", 50)
        monkeypatch.setattr(bottomk, "MISS", 1e-6)
    rows = corpus(seed, 8, 9)
    out = bottomk.near_duplicates(table(rows, SCHEMA), kept=kept).toPandas()
    sets = sets_of(rows, 4)
    link = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    root = graph_roots(range(len(rows)), link)
    members = defaultdict(list)
    for i, r in root.items():
        members[r].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    got = [(none(k), int(n), none(c)) for k, n, c in zip(out.key, out["size"], out.component_id, strict=True)]
    want = [(rows[i][0], len(sets[i]), least[root[i]]) for i in range(len(rows))]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bottomk.near_duplicates(table(rows[:1], SCHEMA).limit(0)).count() == 0


def test_overlap_that_linked_sets_need():
    assert bottomk.least_shared(64, 80, 100) == max(m for m in range(65) if sum(__import__("math").comb(64, i) * 0.8**i * 0.2 ** (64 - i) for i in range(m)) <= 1e-12)
    assert bottomk.needed(10, 80, 100) == 8 and bottomk.needed(11, 80, 100) == 9
    draw = np.random.default_rng(1)
    for size in (1, 5, 40, 63, 64, 65, 80, 500):
        for _ in range(20):
            x = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
            drop = size // 9
            y = np.unique(np.concatenate([x[draw.permutation(size)[drop:]], draw.integers(0, 2**64, drop, dtype=np.uint64)]))
            if bottomk.linked(x, y, 80, 100):
                assert bottomk.may_link(x, y, 80, 100)
                assert len(np.intersect1d(x[:64], y[:64])) >= min(bottomk.needed(min(len(s), 64), 80, 100) for s in (x, y))
    far = np.unique(draw.integers(0, 2**64, 300, dtype=np.uint64))
    assert not bottomk.may_link(far[:150], far[100:], 80, 100)


def test_many_short_rows_have_numbers_of_their_own(table, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_ROWS", 300)
    df = table([(i, None if i % 3 else f"row {i // 2}", "", "") for i in range(2000)], SCHEMA, 1)
    out = bottomk.near_duplicates(df)
    assert out.select("row").distinct().count() == 2000 and out.agg(F.max(F.col("row").bitwiseAND(F.lit((1 << 20) - 1)))).first()[0] < 512


# --- prefix trie ---------------------------------------------------------------------------


def trie(rows):
    by = defaultdict(list)
    for c, t, role, x in rows:
        if c is not None:
            role, x = role or "", x or ""
            by[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{x}".encode()).hexdigest()), (role, x)))
    turns = {c: [x for _, x in sorted(v)] for c, v in by.items()}
    members = defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 * (1 if c >= 0 else -1))
        whole = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, len(whole) == d))
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            kids[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: hashlib.sha256(",".join(str(c) for c, last in members[p] if last).encode()).hexdigest()
    return sorted((m[0][0], len(p), members[p[:-1]][0][0] if p else -1, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), 10**12, 10**12 + 3]:
        if c % 11 == 4:
            continue
        for t in range(draw.choice([1, 2, 3, 5, 8, 12])):
            rows.append((c, None if draw.random() < 0.1 else t, draw.choice(["user", "assistant", None]), draw.choice(["", None, "é", "same", "other", f"own {c}"])))
    rows += [(20, t, "user", f"turn {t % 3}") for t in range(300)] + [(None, 1, "user", "lost")] + [(35, 2, "user", "twice")] * 3
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_trie_against_brute_force(spark, tmp_path, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(prefixtrie, "CHUNK", 3)
        monkeypatch.setattr(prefixtrie, "BAND", 40)
        monkeypatch.setattr(spread, "BLOCK", 16)
    rows = conversations(seed)
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).repartition(3).write.parquet(path)
    out = prefixtrie.op12_prefixes(spark, str(tmp_path)).toPandas().fillna({"parent_conv_id": -1})
    assert sorted((int(a), int(b), int(c), *map(int, r), h) for a, b, c, *r, h in out.itertuples(index=False)) == trie(rows)
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(path)
    assert prefixtrie.op12_prefixes(spark, str(tmp_path)).count() == 0


def test_queue_spills_and_keeps_order():
    draw = random.Random(3)
    items = [(draw.randint(-9, 0), draw.randint(0, 30), k, k) for k in range(3000)]
    queue, got = prefixtrie.Queue(50), []
    for x in items:
        queue.push(x)
    assert queue.runs and len(queue.heap) <= 50
    for key in sorted({x[:2] for x in items}):
        got += queue.take(key)
    assert sorted(items) == sorted(got) and [x[:2] for x in got] == sorted(x[:2] for x in items)


# --- manifest ------------------------------------------------------------------------------


def manifest(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha("".join(map(text, (r[0], r[3], r[2], r[4], t))))

    def levels(h):
        out = [h]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def way(tree, i):
        for level in tree[:-1]:
            s = i // 3 * 3
            yield "".join(level[s:i]), "".join(level[i + 1 : s + 3])
            i //= 3

    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))):
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r, r[1]) for r in groups[s]]) for s in order}
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            t = r[1]
            if t is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                t = t.replace("\n", "")
            h, siblings = leaf(r, t), ""
            for a, b in [*way(trees[s], i), *way(top, k)]:
                h, siblings = sha(a + h + b), siblings + a + b
            out.append((-1 if r[0] is None else r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha(siblings), h, h == top[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("case", ["mixed", "one source", "one row", "a source each", "28 and 81"])
def test_manifest_against_brute_force(spark, tmp_path, monkeypatch, case):
    monkeypatch.setattr(merkle, "BLOCK", 8)
    monkeypatch.setattr(spread, "BLOCK", 8)
    draw = random.Random(5)
    row = lambda i, s: (i, draw.choice([None, "", "a\nb", "é\n\n", f"text {i}"]), draw.choice(["en", None]), s, draw.choice([None, 3]))
    made = {
        "mixed": lambda: [row(i, draw.choice(["b", "b", "b", None, "", "é", "a", f"s{i % 7}"])) for i in range(200)] + [(7, "x\ny", "en", "b", 1)] * 3 + [(None, "t\n", None, "b", None)] * 2,
        "one source": lambda: [row(i, "only") for i in range(30)],
        "one row": lambda: [row(4, None)],
        "a source each": lambda: [row(i, f"s{i}") for i in range(40)],
        "28 and 81": lambda: [row(i, "x" if i < 28 else "y") for i in range(109)],
    }
    rows = made[case]()
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("leaf", F.lit(1)).repartition(3).write.parquet(path)
    out = merkle.op13_manifest(spark, str(tmp_path)).toPandas().fillna({"doc_id": -1})
    assert sorted((int(x[0]), *x[1:]) for x in out.itertuples(index=False)) == manifest(rows)


def test_manifest_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op13_manifest(spark, str(tmp_path)).collect() == []


# --- shared parts --------------------------------------------------------------------------


def test_components_of_chains_stars_and_random_edges(spark):
    draw = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(9999, 1000 + i) for i in range(300)] + [(draw.randint(2000, 2400), draw.randint(2000, 2400)) for _ in range(300)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    real = [(a, b) for a, b in edges if a is not None and a != b]
    parent = {x: x for e in real for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in real:
            low = min(parent[a], parent[b])
            changed |= parent[a] != low or parent[b] != low
            parent[a] = parent[b] = low
    assert got == parent


def test_attached_aggregates_and_side_tables(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2700, 0).otherwise(F.col("id")).alias("k"))
    out = spread.attach(df, ["k"], ["id"], F.col("n") > 1, n=F.count(F.lit(1)), low=F.min("id"))
    assert out.count() == 2700 and out.select("n", "low").distinct().collect() == [(2700, 0)]
    assert spread.look_up(df, spark.createDataFrame([(0, "hot"), (2999, "x")], "k long, v string"), ["k"], ["id"], "left").where("v = 'hot'").count() == 2700
    numbered = {r.id: r.g for r in spread.numbered(df, ["k", "id"]).collect()}
    assert [numbered[i] for i in range(3000)] == list(range(3000))
    table = sidetable.side_table(df.where("id % 7 = 0").repartition(5), "id", "sevens")
    assert table.between(10, 30)["id"].to_pylist() == [14, 21, 28] and table.between(1, 6).num_rows == 0


def test_packing_carries_ids_without_a_shuffle(spark):
    pieces = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 90 + 11).alias("length"), F.col("id").cast("string").cast("binary").alias("ids"))
    out = packing.pack_with_ids(pieces, 100).toPandas()
    assert len(out) == 500 and all(int(bytes(i)) == d for i, d in zip(out.ids, out.doc_id, strict=True))
    assert out.groupby("sequence_id").length.sum().max() <= 100
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
    assert packing.pack_with_ids(pieces.limit(0), 100).count() == 0


def test_packing_reads_many_small_files_in_one_batch(spark):
    """Forty files are read by a few tasks, out of order, so a batch holds rows of several."""
    pieces = spark.range(400).repartition(40).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "id % 60 + 1 AS length", "encode(string(id), 'utf-8') AS ids")
    out = packing.pack_with_ids(pieces, 100).toPandas()
    assert sorted(out.doc_id) == list(range(400)) and (out.length == out.doc_id % 60 + 1).all()
    for _, rows in out.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *rows.length.cumsum()[:-1]] and rows.length.sum() <= 100


def test_sketches_of_many_pairs_are_compared_at_once(monkeypatch):
    """The same answer as pair by pair, for small sets, full sketches and values at the ends of the range."""
    monkeypatch.setattr(bottomk, "PAIRS", 100)
    draw = np.random.default_rng(5)
    top = np.uint64(2**64 - 1)
    pool = np.unique(np.append(draw.integers(0, 2**64 - 1, 90, np.uint64), [np.uint64(0), top]))
    sides = [[np.sort(draw.choice(pool, draw.integers(1, 91), replace=False))[:64] for _ in range(40)] for _ in range(2)]
    sides[1] += sides[0][:5]
    sides[0].append(np.array([top], np.uint64))
    sides[1].append(np.array([top], np.uint64))
    i, j = (x.ravel() for x in np.indices((len(sides[0]), len(sides[1]))))
    got = bottomk.may_link_pairs(*sides, i, j, 80, 100)
    assert got.tolist() == [bottomk.may_link(sides[0][a], sides[1][b], 80, 100) for a, b in zip(i, j, strict=True)] and 0 < got.sum() < len(got)
