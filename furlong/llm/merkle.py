"""Operator 13, Merkle dataset manifest: levels stored as parent-linked nodes, proofs by a recursive query.

Leaves are numbered in the order (group, key), so every node covers a range of leaf numbers. A node
links to the one HOPS levels higher and holds the siblings met on the way. Levels are built bottom-up,
HOPS at a time, first a tree for each group, then one tree over the roots of the groups.

A recursive query climbs from every leaf: each turn joins the node it stands on, yields the siblings
and folds them into the hash. Nodes near the root stand on the way of most leaves; their links are
repeated for each block of leaf numbers they cover, so a turn joins on (node, block) and no key has
more rows than a block.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.spread import BLOCK, block, blocks, numbered
from furlong.llm.storage import stored

#: Nodes of a run, and levels that a link climbs.
FAN, HOPS = 3, 3
#: Steps of the tree over the groups are numbered from here; a node is named low * STEPS + step.
TOP, STEPS = 1024, 2048


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def counted(column: str | Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*columns: str | Column) -> Column:
    return digest(F.concat(*[counted(c) for c in columns]))


def _raised(hashes: Column) -> Column:
    """The next level of an array of hex hashes."""
    starts = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FAN).cast("int"))
    return F.transform(starts, lambda i: digest(F.array_join(F.slice(hashes, i * FAN + 1, F.lit(FAN)), "")))


def _hops(n: Column) -> Column:
    """Levels that the nodes of a tree with n of them still climb, HOPS at most."""
    return reduce(lambda rest, k: F.when(n <= FAN**k, k).otherwise(rest), range(HOPS - 1, 0, -1), F.lit(HOPS))


def _climb_level(nodes: DataFrame, step: int, top: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links and parents of the nodes (tree, n, pos, low, high, hash, start) of trees with several, and
    the nodes of trees with one. The links hold siblings before and after the node for each hop."""
    run = nodes.where("n > 1").groupBy("tree", F.floor(F.col("pos") / FAN**HOPS).alias("up"))
    item = F.struct("pos", "low", "high", "hash", "start")
    runs = run.agg(F.max("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items")).withColumn("hops", _hops(F.col("n")))
    runs = runs.withColumn("l0", F.col("items.hash"))
    for k in range(1, HOPS + 1):
        runs = runs.withColumn(f"l{k}", F.when(F.col("hops") >= k, _raised(F.col(f"l{k - 1}"))))
    runs = stored(runs, "runs")
    up = F.coalesce(*[F.col(f"l{k}") for k in range(HOPS, 0, -1)])[0]
    size = reduce(lambda n, _: F.ceil(n / FAN), range(HOPS), F.col("n")).cast("long")
    first = F.col("items")[0]["low"]
    parents = runs.select("tree", size.alias("n"), F.col("up").cast("long").alias("pos"), first.alias("low"), F.element_at("items", -1)["high"].alias("high"), up.alias("hash"), F.lit(None).cast("binary").alias("start"))
    at = runs.select("*", F.posexplode("items").alias("i", "item"))
    before, after = [], []
    for k in range(HOPS):
        place = F.floor(F.col("i") / FAN**k)
        start = (F.floor(place / FAN) * FAN).cast("int")
        place = place.cast("int")
        level = F.col(f"l{k}")
        before.append(F.unhex(F.array_join(F.slice(level, start + 1, place - start), "")))
        after.append(F.unhex(F.array_join(F.slice(level, place + 2, start + FAN - 1 - place), "")))
    named = lambda low, at: low * STEPS + at
    parent = F.when(size > 1, named(first, F.lit(step + 1))).otherwise(named(first, F.lit(TOP)) if not top else F.lit(-1))
    links = at.select(
        F.col("item.low").alias("low"), F.col("item.high").alias("high"), named(F.col("item.low"), F.lit(step)).alias("node"), parent.cast("long").alias("parent"), F.lit(step).alias("step"),
        F.slice(F.array(*before), F.lit(1), F.col("hops")).alias("before"), F.slice(F.array(*after), F.lit(1), F.col("hops")).alias("after"),
        F.unhex("item.hash").alias("hash"), F.col("item.start").alias("start"),
    )
    return links, parents, nodes.where("n = 1")


def _tree(nodes: DataFrame, most: int, step: int, top: bool) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links of each step, and the roots of the trees, of which the largest has `most` nodes."""
    links, ends = [], []
    while True:
        if most <= 1:
            return links, [*ends, nodes.where("n = 1")]
        link, nodes, done = _climb_level(nodes, step, top)
        links, ends, step, most = [*links, link], [*ends, done], step + 1, -(-most // FAN**HOPS)


#: Folds siblings into a hash, hop by hop.
_FOLD = """aggregate(sequence(0, size({l}.before) - 1), {h}, (acc, i) -> unhex(sha2(cast(concat(lower(hex({l}.before[i])),
 lower(hex(acc)), lower(hex({l}.after[i]))) as binary), 256)))"""
_SIBLINGS = "aggregate(sequence(0, size({l}.before) - 1), cast('' as binary), (acc, i) -> concat(acc, {l}.before[i], {l}.after[i]))"


def manifest(leaves: DataFrame, key: str, group: str) -> tuple[DataFrame, str | None]:
    """Proofs of the leaves (key, group, leaf, start), and the root of all.

    leaf is a hex hash; start the hash to climb with, the leaf itself unless the record was changed
    since. Rows: key, leaf, subroot, proof_sha256, folded_root. Leaves ascend by group, then key,
    nulls first; equal keys by their hash. An empty table has no rows and no root."""
    spark = leaves.sparkSession
    rows = leaves.select(F.col(key).alias("key"), F.col(group).alias("group"), F.unhex("leaf").alias("leaf"), F.unhex("start").alias("start"))
    rows = numbered(rows, ["group", "key", "leaf"], name="leaves")
    trees = rows.groupBy("group").agg(F.min("g").alias("tree"), F.count(F.lit(1)).alias("n"))
    trees = numbered(trees, ["tree"], "t", "trees")
    groups, most = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    if not groups:
        empty = spark.createDataFrame([], "leaf string, subroot string, proof_sha256 string, folded_root string")
        return rows.select("key").limit(0).crossJoin(empty), None
    spans = trees.select(F.col("group").alias("of"), "tree", "n", blocks("tree", F.col("tree") + F.col("n") - 1).alias("b"))
    placed = rows.join(spans, F.col("group").eqNullSafe(F.col("of")) & (block("g") == F.col("b")))
    nodes = placed.select("tree", "n", (F.col("g") - F.col("tree")).alias("pos"), F.col("g").alias("low"), F.col("g").alias("high"), F.lower(F.hex("leaf")).alias("hash"), "start")
    links, ends = _tree(nodes, most, 0, False)
    ends = reduce(DataFrame.unionByName, ends)
    tops = ends.join(trees.select("tree", "t"), "tree").select(F.lit(0).cast("long").alias("tree"), F.lit(groups).cast("long").alias("n"), F.col("t").alias("pos"), "low", "high", "hash", F.lit(None).cast("binary").alias("start"))
    tops = stored(tops, "roots")
    more, last = _tree(tops, groups, TOP, True)
    root = last[-1].first()["hash"]
    return _proofs(rows, nodes, links, more, root), root


def _proofs(rows: DataFrame, nodes: DataFrame, links: list[DataFrame], more: list[DataFrame], root: str) -> DataFrame:
    spark = rows.sparkSession
    name = f"m{uuid.uuid4().hex}"
    single = nodes.where("n = 1").select(F.col("low").alias("g"), (F.col("low") * STEPS + TOP).alias("node"), F.col("start").alias("h"), F.unhex(F.lit("")).alias("siblings"))
    if links:
        single.unionByName(links[0].select(F.col("low").alias("g"), F.col("parent").alias("node"), F.expr(_FOLD.format(l="x", h="x.start").replace("x.", "")).alias("h"), F.expr(_SIBLINGS.format(l="x").replace("x.", "")).alias("siblings"))).createOrReplaceTempView(f"{name}_leaves")
    else:
        single.createOrReplaceTempView(f"{name}_leaves")
    higher = [x.select("node", "parent", "step", "before", "after", F.when(F.col("step") == TOP, F.col("hash")).alias("own"), blocks("low", "high").alias("b")) for x in [*links[1:], *more]]
    if higher:
        stored(reduce(DataFrame.unionByName, higher), "links").createOrReplaceTempView(f"{name}_links")
        climb = f"""
WITH RECURSIVE climb(g, node, step, h, siblings, own) AS (
  SELECT g, node, 0, h, siblings, cast(null AS binary) FROM {name}_leaves
  UNION ALL
  SELECT c.g, l.parent, l.step, {_FOLD.format(l="l", h="c.h")}, {_SIBLINGS.format(l="l")}, l.own
  FROM climb c JOIN {name}_links l ON c.node = l.node AND c.g div {BLOCK} = l.b
) SELECT * FROM climb"""
    else:
        climb = f"SELECT g, node, 0 AS step, h, siblings, cast(null AS binary) AS own FROM {name}_leaves"
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit, None)
    spark.conf.set(limit, "-1")
    try:
        way = F.sort_array(F.collect_list(F.struct("step", "siblings")))
        proofs = spark.sql(climb).groupBy("g").agg(
            F.lower(F.hex(F.max_by("h", "step"))).alias("folded_root"), F.lower(F.hex(F.max("own"))).alias("subroot"),
            digest(F.array_join(F.transform(way, lambda x: F.lower(F.hex(x["siblings"]))), "")).alias("proof_sha256"),
        )
        proofs = stored(proofs, "proofs")
    finally:
        spark.conf.set(limit, before) if before is not None else spark.conf.unset(limit)
        for view in ("leaves", "links"):
            spark.catalog.dropTempView(f"{name}_{view}")
    found = rows.select("g", "key", F.lower(F.hex("leaf")).alias("leaf")).join(proofs, "g")
    return found.select("key", "leaf", F.coalesce("subroot", F.lit(root)).alias("subroot"), "proof_sha256", "folded_root")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded again from records of which some lost their line ends.

    A record without doc_id is a leaf like any other and is never tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars"]
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))
    start = F.when(tampered, leaf_hash(*columns, F.replace("text", F.lit("\n"), F.lit("")))).otherwise(F.col("leaf"))
    leaves = docs.withColumn("leaf", leaf_hash(*columns, "text")).select("doc_id", "source", "leaf", start.alias("start"))
    proofs, root = manifest(leaves, "doc_id", "source")
    root = F.lit(root).cast("string")
    return proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


QUERIES = {"op13_manifest": op13_manifest}
