"""Exact n-gram Jaccard join by token-combination prefixes, and the groups that its links make.

A document is its set of shingles (hashed to 64 bits; their order as integers is the first global order). Documents
with equal sets are one node. Two nodes link when their sets' Jaccard similarity is at least 4/5.

1. Sieve. In a set of n shingles at most n // 5 are missing from a linked set. So of the first n // 5 + n // 10 shingles
   of each set (at least one), some 8 % of n must also be among another node's first. A count by shingle finds those
   that only one node has, a count by node what is left; nodes with too little left have no link. No pair is made here.
2. Signatures. Among the remaining nodes, shingles in more than `frequent` sets are the frequent ones; they come last in
   the second order, and are dealt to m classes by their hash, m following the set's size. A node's prefix is
   extended until rare + sum over classes of (frequent of the class - 1) exceeds n // 5. Then two linked nodes share a
   rare shingle of their prefixes or two frequent ones of a class. Rare shingles are indexed alone, frequent ones as pairs
   of the same class. Classes hold four or five prefix shingles, so a node has a few hundred keys at most.
3. Links. First each node is verified against one partner, the one that most of its keys name as their smallest
   member; this joins large groups with as many comparisons as members. Then only members of a key that are still in
   different groups are paired, filtered by size and by bitmaps of 512 bits, and verified on their whole sets. Pairs
   within a group can't change it, so no link between groups is lost. Keys with more than `crowded` members aren't
   joined with themselves: the nodes that they connect are compared by bitmaps, block by block, inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BITS = 512
SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
KEYS = T.StructType([T.StructField("key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    return x ^ (x >> np.uint64(27))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the runs of `width` words; fewer words are one run, none give an empty array."""
    ws = (text or "").encode().translate(common.LOWER).split()
    if not ws:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    k = min(width, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = (out ^ h[j : len(h) - k + 1 + j]) * MIX + np.uint64(j + 1)
    return np.unique(mixed(out + np.uint64(k)).view(np.int64))


def first(n: int) -> int:
    """How many of a set's shingles the sieve takes."""
    return min(n, n // 5 + max(1, n // 10))


def node_of(found: np.ndarray) -> int | None:
    """The hash of a set of shingles; none for an empty set."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), pa.int64()))


def sets(docs: DataFrame, keep: str) -> DataFrame:
    """doc_id, hash of the text, node and n of each row of docs, with its shingles: the first ones, or all. Empty sets have no node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            found = [shingles(x.as_py()) for x in b.column(2)]
            nodes = pa.array(list(map(node_of, found)), pa.int64())
            n = pa.array([len(s) for s in found], pa.int64())
            kept = [s if keep == "all" else s[: first(len(s))] for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), nodes, n, lists(kept)], names=SETS.fieldNames())

    text = F.col("text").cast("string")
    return common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")), run, SETS)


def sieve(firsts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that may have a link; firsts: node and the first shingles of its set, once or more often."""
    t = firsts.select("node", F.explode("shingles").alias("s"))
    alone = t.groupBy("s").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    alone = alone.groupBy("node").agg(F.count("*").alias("alone"))
    taken = F.expr("least(n, n div 5 + greatest(1, n div 10))")
    needed = F.expr("greatest(1, ((4 * n + 4) div 5) div 10)")
    return nodes.join(alone, "node", "left").where(taken - F.coalesce("alone", F.lit(0)) >= needed).select("node", "doc_id", "n")


def schemes(n: int) -> set[int]:
    """The numbers of classes under which a set of n shingles is indexed: those of each size that a smaller partner may have."""
    return {1 << max(0, k.bit_length() - 5) for k in ((4 * n + 4) // 5, n)}


def keys(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The signature keys of a set, given those of its shingles that are frequent."""
    n = len(tokens)
    often = np.isin(tokens, frequent, assume_unique=True)
    rare, common_ones = tokens[~often].view(np.uint64), tokens[often].view(np.uint64)
    need = n // 5 + 1
    out = [rare[:need]]
    if len(rare) >= need:
        return np.unique(out[0]).view(np.int64)
    for m in schemes(n):
        cls = (mixed(common_ones) >> np.uint64(7)) & np.uint64(m - 1)
        members: dict[int, list[int]] = {}
        have = len(rare)
        for c, t in zip(cls.tolist(), common_ones.tolist()):
            own = members.setdefault(c, [])
            have += bool(own)
            own.append(t)
            if have >= need:
                break
        for own in members.values():
            a = np.array(own, np.uint64)
            i, j = np.triu_indices(len(a), 1)
            out.append(mixed((a[i] * MIX) ^ (mixed(a[j]) + np.uint64(m))))
    return np.unique(np.concatenate(out)).view(np.int64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles by hash: two sets differ in at least as many shingles as their bitmaps in bits."""
    at = (mixed(tokens.view(np.uint64)) >> np.uint64(20)) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(bool))


def index(survivors: DataFrame, frequent: DataFrame) -> DataFrame:
    """key, node, n, bits for each signature of each survivor; frequent: node and the frequent shingles of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            for node, tokens, often in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                t = np.array(tokens.values.to_numpy(zero_copy_only=False), np.int64)
                k = keys(t, often.values.to_numpy(zero_copy_only=False) if often.is_valid else t[:0])
                bits = bitmap(t).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), node)), pa.array(np.full(len(k), len(t))), pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(k), np.int32)), pa.array([bits], pa.binary())).cast(pa.binary())], names=KEYS.fieldNames())

    return common.in_arrow(survivors.join(frequent, "node", "left").select("node", "shingles", "often"), run, KEYS)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both)


def verify(pairs: DataFrame, survivors: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of nodes that link, compared on their whole sets."""
    s = survivors.select("node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.filled(batches):
            x, y = (batch.column(k) for k in (2, 3))
            ok = [linked(p.values.to_numpy(zero_copy_only=False), q.values.to_numpy(zero_copy_only=False)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    p = pairs.select("a", "b").join(s.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(s.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    return common.in_arrow(p.select("a", "b", "x", "y"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and its group, the smallest node reachable, for all nodes of the edges (a, b).

    Each round takes the smallest label among a node and its neighbours, then that label's own label; rounds end when
    nothing changes. Labels are written after each round.
    """
    both = common.settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = common.settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("group")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        hop = labels.select(F.col("node").alias("at"), F.col("group").alias("hop"))
        new = labels.join(near, "node").join(hop, F.col("group") == F.col("at")).select("node", F.least("near", "hop").alias("group"), (F.least("near", "hop") < F.col("group")).alias("moved"))
        new = common.settle(new, "labels")
        labels = new.select("node", "group")
        if new.where("moved").limit(1).count() == 0:
            return labels


def grouped(docs: DataFrame, frequent: int = 32, crowded: int = 64) -> tuple[DataFrame, DataFrame]:
    """doc_id, hash, node and n of each row of docs; and node, doc_id (the smallest) and group of each node."""
    firsts = common.settle(sets(docs, "first"), "sets")
    rows = firsts.drop("shingles")
    nodes = common.settle(rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "nodes")
    maybe = common.settle(sieve(firsts, nodes), "sieved", free=True)
    wanted = common.small(maybe.select(F.col("doc_id").alias("_id")).distinct())
    again = sets(docs.select("doc_id", "text").join(wanted, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi"), "all")
    survivors = common.settle(again.join(common.small(maybe.select("node")), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "survivors")
    t = survivors.select("node", F.explode("shingles").alias("s"))
    often = common.settle(t.groupBy("s").count().where(F.col("count") > frequent).select("s"), "frequent")
    often = t.join(common.small(often), "s").groupBy("node").agg(F.collect_list("s").alias("often"))
    k = common.settle(index(survivors, often), "keys", free=True)

    centre = k.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("m")).where("m > 1")
    named = k.join(centre, "key").where("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("shared"))
    best = named.groupBy("node").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre"))
    edges = common.settle(verify(best.select(F.col("node").alias("a"), F.col("centre").alias("b")), survivors), "links")
    labels = components(edges)

    k = k.join(labels, "node", "left").withColumn("group", F.coalesce("group", "node"))
    open_keys = k.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min("node").alias("centre"), F.count("*").alias("m")).where("low < high").select("key", "centre", "m")
    k = common.settle(k.drop("group").join(open_keys, "key"), "open-keys", free=True)
    crowd = common.settle(clusters(k.where(F.col("m") > crowded)), "crowd")
    for closest in (True, False):
        edges = edges.union(common.settle(verify(crowd_pairs(crowd, labels, closest), survivors), "links"))
        labels = components(edges)
    x, y = (k.where(F.col("m") <= crowded).join(labels, "node", "left").select("key", F.col("node").alias(f"node{i}"), F.col("n").alias(f"n{i}"), F.col("bits").alias(f"bits{i}"), F.coalesce("group", "node").alias(f"group{i}")) for i in (1, 2))
    fits = F.expr("group1 <> group2 and node1 < node2 and 10 * n1 >= 8 * n2 and 10 * n2 >= 8 * n1")
    apart = near_bits(x.join(y, "key").where(fits).select("node1", "node2", "n1", "n2", "bits1", "bits2"))
    pairs = apart.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct()
    edges = edges.union(common.settle(verify(pairs, survivors), "links", free=True))
    labels = components(edges)

    return rows, nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("group", "node").alias("group"))


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs.

    component_id is the smallest doc_id that links reach, itself included. A text without words, or null, has no
    shingles and is a group of its own; a group in which no row has a doc_id has a null component_id. Repeated rows with
    one id count as so many documents. An empty table gives no rows; other columns are not read.
    """
    rows, nodes = grouped(docs)
    lowest = nodes.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    placed = nodes.join(lowest, "group").select("node", "component_id")
    return rows.join(placed, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay: of each group the one with the smallest doc_id.

    A row without an id stays only where its group has none with one; of rows with the same id and set one stays, and
    texts without words all stay.
    """
    rows, nodes = grouped(docs)
    own = rows.where("node is not null").join(nodes.select("node", "group"), "node")
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("node").alias("set"), F.col("hash").alias("hash"))).alias("k")
    kept = own.groupBy("group").agg(kept).select("k.id", "k.hash", F.lit(False).alias("blank"))
    kept = common.settle(kept.union(rows.where("node is null").select("doc_id", "hash", F.lit(True)).distinct()), "kept")
    name, kept_id, kept_hash, blank = (common.free_name(docs, x) for x in ("hash", "kept_id", "kept_hash", "blank"))
    marked = docs.withColumn(name, F.xxhash64(F.col("text").cast("string")))
    stay = marked.join(common.small(kept.toDF(kept_id, kept_hash, blank)), F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(name) == F.col(kept_hash)))
    if rows.where("node is not null").groupBy("doc_id", "hash").count().where("count > 1").limit(1).count():
        stay = stay.where(~F.col(blank)).dropDuplicates(["doc_id", name]).unionByName(stay.where(blank))
    return stay.select(*docs.columns)


def clusters(k: DataFrame) -> DataFrame:
    """cluster, node, n, bits and size of the cluster, for nodes with keys (key, node, n, bits, centre): nodes that keys connect."""
    own = k.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    c = components(k.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()).withColumnRenamed("group", "cluster")
    c = own.join(c, "node")
    return c.join(c.groupBy("cluster").agg(F.count("*").alias("size")), "cluster")


def crowd_pairs(crowd: DataFrame, labels: DataFrame, closest: bool, block: int = 2048) -> DataFrame:
    """Pairs of nodes of a cluster in different groups that sizes and bitmaps allow to be linked.

    A cluster is cut by hash into blocks of about `block` nodes and each two blocks meet in one task, which compares
    bitmaps and hands on nothing else. closest: only the best pair of each node in each two blocks, to join groups
    before all that is left is looked at.
    """
    m = crowd.join(labels, "node", "left").withColumn("group", F.coalesce("group", "node")).withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    m = m.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "bits", "group")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for own in (g["low"].iloc[0], g["high"].iloc[0]):
            x = g[g["own"] == own].sort_values("node")
            sides.append((x["node"].to_numpy(), x["n"].to_numpy(), x["group"].to_numpy(), np.frombuffer(b"".join(x["bits"]), np.uint64).reshape(len(x), -1)))
        (node1, n1, group1, bits1), (node2, n2, group2, bits2) = sides
        found, best = [], np.full(len(node2), 1 << 20)
        partner = np.zeros(len(node2), np.int64)
        for at in range(0, len(node1), 128):
            part = slice(at, at + 128)
            differ = sum(np.bitwise_count(bits1[part, None, w] ^ bits2[None, :, w]).astype(np.int32) for w in range(bits1.shape[1]))
            a, b = n1[part, None], n2[None, :]
            ok = (9 * differ <= a + b) & (group1[part, None] != group2[None, :]) & (10 * a >= 8 * b) & (10 * b >= 8 * a)
            if not closest:
                ok &= node1[part, None] != node2[None, :]
                i, j = np.nonzero(ok)
                found.append((node1[part][i], node2[j]))
                continue
            differ = np.where(ok, differ, 1 << 20)
            if differ.size:
                i = np.flatnonzero(differ.min(axis=1) < 1 << 20)
                found.append((node1[part][i], node2[differ.argmin(axis=1)[i]]))
                low = differ.min(axis=0)
                partner, best = np.where(low < best, node1[part][differ.argmin(axis=0)], partner), np.minimum(best, low)
        found.append((partner[best < 1 << 20], node2[best < 1 << 20]))
        a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return m.groupBy("cluster", "low", "high").applyInPandas(run, "a long, b long").distinct()


def near_bits(pairs: DataFrame) -> DataFrame:
    """Pairs whose bitmaps don't rule a link out: linked sets differ in at most a ninth of their sizes' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            x, y = (np.frombuffer(b.column(k).cast(pa.binary(BITS // 8)).buffers()[1], np.uint64)[b.column(k).offset * (BITS // 64) :][: b.num_rows * (BITS // 64)].reshape(b.num_rows, -1) for k in (4, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1)
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            yield b.filter(pa.array(9 * differ.astype(np.int64) <= sizes)).select([0, 1])

    return common.in_arrow(pairs, run, "node1 long, node2 long")
