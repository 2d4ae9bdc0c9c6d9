import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from llm_tables import table  # noqa: F401
from furlong.llm import idfile, packing, sharding, tokens
from furlong.llm.spans import Index, mix

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
DOCS = "doc_id long, text string, shard string"


def docs(n=60):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice(["the", "Été", "it's", "x1 22", "!?", "\n\n", "  "]) for _ in range(draw.randint(0, 40))), "clash") for i in range(n)]
    return [*rows, (n, None, None), (n + 1, "", ""), (n + 2, "word " * 9000, "long"), (5, rows[5][1], "repeat"), (None, "no key", None)]


def test_index_numbers_keys():
    keys = mix(np.arange(5000, dtype=np.uint64))
    index = Index(4)
    index.add(keys[:3000])
    index.add(keys[3000:])
    assert (index.find(keys) == np.arange(5000)).all()
    assert (index.find(mix(np.arange(5000, 6000, dtype=np.uint64))) == -1).all()


def test_index_takes_six_slots_a_key_at_most():
    index, keys = Index(4), mix(np.arange(30_000, dtype=np.uint64))
    for at in range(0, len(keys), 500):
        index.add(keys[at : at + 500])
        assert 3 * index.count <= len(index.keys) <= max(16, 6 * index.count)
    assert (index.find(keys) == np.arange(len(keys))).all()


def test_packing_drops_the_tokenizer_of_a_worker_once_ids_are_made():
    class Items:
        def groupBy(self, *_):
            return self

        def applyInPandas(self, work, _):
            return work

    tokens.encode_column(pa.array(["some words"]), WORDS, 1)
    assert tokens.encoder.cache_info().currsize
    group = pd.DataFrame({"region": 0, "island": 0, "item": [0, 1], "length": [3000, 2000], "bin": -1, "migrant": -1})
    assert len(set(packing._epoch(Items(), 0, 4096)(group)["bin"])) == 2
    assert not tokens.encoder.cache_info().currsize


def test_rendezvous_moves_only_into_the_new_shard_and_follows_weights(spark):
    df = spark.range(20000).select(sharding.rendezvous(["id"], [1.0] * 4).alias("a"), sharding.rendezvous(["id"], [1.0] * 5).alias("b"), sharding.rendezvous(["id"], [3.0, 1.0, 0.0]).alias("w")).toPandas()
    moved = df[df.a != df.b]
    assert set(moved.b) == {4} and 0.17 < len(moved) / len(df) < 0.23
    assert 0.73 < (df.w == 0).mean() < 0.77 and set(df.w) == {0, 1}


def test_slots_are_gapless_with_a_hot_key_nulls_and_an_empty_table(table):
    df = table([*docs(), *[(7, "hot", None)] * 40], DOCS)
    out = sharding.shard(df, ["doc_id"], [1.0] * 3).toPandas()
    assert len(out) == df.count()
    for _, group in out.groupby("shard"):
        assert sorted(group.slot) == list(range(len(group)))
    assert out[out.doc_id == 7]["shard"].nunique() == 1
    assert sharding.shard(df.limit(0), ["doc_id"], [1.0]).count() == 0


def _ids(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_pieces_and_packing(table):
    rows = docs()
    df = table(rows, DOCS)
    pieces = packing.token_pieces(df, WORDS, 1)
    out = packing.pack(pieces).toPandas()
    want = sorted((r[0] if r[0] is not None else -1, k, k * 4096, np.array(ids[k * 4096 : k * 4096 + 4096], "<u4").tobytes()) for r, ids in zip(rows, _ids(WORDS, [r[1] for r in rows], 1), strict=True) for k in range(-(-len(ids) // 4096)))
    got = sorted((int(a) if a == a else -1, b, c, bytes(d)) for a, b, c, d in out[["doc_id", "piece", "start", "ids"]].itertuples(index=False))
    assert got == want
    for _, group in out.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group.length.sum() <= 4096 and group.offset.tolist() == [0, *group.length.cumsum()[:-1]]
    assert out.sequence_id.nunique() == -(-out.length.sum() // 4096)
    assert packing.pack(pieces.limit(0)).count() == 0
    whole = packing.sequences(packing.pack(pieces)).toPandas()
    assert (whole.ids.map(len) == 4 * whole.length).all()


def test_regions_and_islands_reach_the_bound(spark, table):
    draw = random.Random(1)
    df = table([(i, draw.randint(1, 2500)) for i in range(9000)], "item long, length long")
    out = packing.pack_items(df).toPandas()
    assert len(out) == 9000 and out.item.is_unique and out.groupby("bin").length.sum().max() <= 4096
    assert out.bin.nunique() <= 1.003 * out.length.sum() / 4096 + 1


def test_crossover_keeps_every_item_once():
    draw = random.Random(2)
    lengths = [draw.randint(1, 60) for _ in range(200)]
    parents = packing.evolve([], lengths, 100, draw, 0, 2)
    child = packing.crossover(*parents, lengths, 100, draw)
    assert sorted(i for b in child for i in b) == list(range(200))
    assert max(sum(lengths[i] for i in b) for b in child) <= 100


def test_byte_coding_round_trip():
    draw = np.random.default_rng(1)
    counts = np.array([0, 1, 4, 5, 1000])
    values = draw.integers(0, 2**32, counts.sum(), dtype=np.uint32) >> draw.integers(0, 32, counts.sum()).astype(np.uint32)
    parts = [idfile.pack_bytes(v) for v in np.split(values, np.cumsum(counts)[:-1])]
    control, data = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    assert (idfile.unpack_bytes(control, data, counts) == values).all()


def test_id_files_round_trip(spark, table, tmp_path):
    rows = [*docs(), *[(9, f"hot {i % 5}", None) for i in range(60)]]
    df = table(rows, DOCS)
    folder = str(tmp_path / "ids")
    out = idfile.read(idfile.write(df, folder, BYTES, 2), folder).toPandas().sort_values("start")
    assert out.start.tolist() == [0, *out.n_tokens.cumsum()[:-1]]
    keys = [k if k == k else -(1 << 63) for k in out.key]
    assert keys == sorted(keys)
    want = sorted((r[0] if r[0] is not None else -1, zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, _ids(BYTES, [r[1] for r in rows], 2), strict=True))
    assert sorted((int(k) if k == k else -1, zlib.crc32(bytes(i))) for k, i in zip(out.key, out.ids, strict=True)) == want
    empty = str(tmp_path / "none")
    assert idfile.read(idfile.write(df.limit(0), empty, BYTES, 2), empty).count() == 0
