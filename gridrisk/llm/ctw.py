"""Language-model scores by context-tree weighting over bytes, beside a smoothed unigram score of words.

A byte is eight binary decisions, each made at a node: a context of 0 to `depth` bytes before it and the bits so far.
A node estimates its bit by Krichevsky and Trofimov; context-tree weighting gives each node the weight that its own
estimate deserves against those of the contexts one byte longer, from the evidence of all training texts. Weights are
carried from the root down, so that each node holds the mixed probability for texts whose longest known context it is.
A context that training never saw takes no part: the mixture ends with the last known one. Texts are lower-cased (A-Z),
begin after `depth` zero bytes and end with a byte 255, which no UTF-8 text holds, so a text's probability is that of
exactly this text. Code length per byte is -log2 of it over the number of bytes.

1. All texts are cut into grams (the bytes of a context and the byte after it), counted over training and over all.
2. Distinct grams are dealt by the nearest `depth` - 2 bytes of their contexts. What lies below such a context in the tree
   is worked out in one go, deepest nodes first, by array operations; it has at most 2**24 grams, however much text there is.
3. The nodes above are worked out by grouping and joins, up to the root and back down.
4. The part below is worked out again, now downwards, and gives each gram the log-probability of its byte.
5. Texts look their grams up: the most frequent ones are broadcast, the others are joined. The sum is the text's score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STRETCH = 1_000_000  # bytes whose grams are sorted at a time
END = b"\xff"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words, and the empty word as the end."""
    ws = (text or "").encode().translate(common.LOWER).split()
    ws.append(b"")
    return ws


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts and their ends the `depth` bytes before it and itself, as an integer; where texts start."""
    joined = np.frombuffer(b"".join([bytes(depth) + t + END for t in texts]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    g = np.zeros(len(joined) - depth, np.int64)
    for k in range(depth + 1):
        g = (g << 8) | joined[k : len(joined) - depth + k]
    # the stretch of `depth` zero bytes before each later text gives no grams
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(g), bool)
    for k in range(1, depth + 1):
        keep[(starts + depth * np.arange(len(texts)))[1:] - k] = False
    return g[keep], starts


def stretches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in groups of about STRETCH bytes, with their lower-cased texts."""
    for b in common.filled(batches):
        first, texts, size = 0, [], 0
        for i, x in enumerate(b.column(column), 1):
            texts.append((x.as_py() or "").encode().translate(common.LOWER))
            size += len(texts[-1]) + 1
            if size >= STRETCH or i == b.num_rows:
                yield b.slice(first, i - first), texts
                first, texts, size = i, [], 0


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=n).astype(np.int64)


def count_grams(texts: DataFrame, depth: int, most: int = 1_000_000) -> DataFrame:
    """gram, n (in training texts) and m (in all) over texts (training, text).

    A task hands on its counts when it holds `most` different grams, and at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # gram * 2 + whether it is from a training text, and counts

        def out() -> pa.RecordBatch:
            keys, m = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array(m * (keys & 1)), pa.array(m)], names=["gram", "n", "m"])

        for b, part in stretches(batches, 1):
            gs, starts = grams(part, depth)
            learnt = np.repeat(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.diff([*starts, len(gs)]))
            held.append(np.unique(gs << 1 | learnt, return_counts=True))
            if sum(len(keys) for keys, _ in held) > 2 * most:
                held = [merge(held)]
                if len(held[0][0]) > most:
                    yield out()
        if held:
            held = [merge(held)]
            yield out()

    counted = common.in_arrow(texts.select("training", "text"), run, "gram long, n long, m long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def count_words(texts: DataFrame, most: int = 400_000) -> DataFrame:
    """word, n over all texts, the end as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for b in common.filled(batches):
            for text in b.column(0):
                held.update(tokens(text.as_py()))
                if len(held) > most:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return common.in_arrow(texts.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; right to about 1e-12 for x of 1/2 and more."""
    z, product = x + 8, x.copy()
    for k in range(1, 8):
        product *= x + k
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(product)


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The log of Krichevsky and Trofimov's probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - math.log(math.pi) - log_gamma(n0 + n1 + 1.0)


def half_of_each(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """log((exp(own) + exp(below)) / 2)."""
    return np.logaddexp(own, below) - math.log(2)


def one(n0, n1):
    """The estimate of a one after n0 zeros and n1 ones."""
    return (n1 + 0.5) / (n0 + n1 + 1.0)


def shorter(node, d: int):
    """The node's context cut to its nearest d bytes. A node is context * 256 + the bits so far after a leading 1."""
    mask = (1 << 8 * (d + 1)) - 1
    return node.bitwiseAND(F.lit(mask)) if isinstance(node, Column) else node & mask


class Subtree:
    """The nodes of the levels `top` to `depth` for some grams and their counts in training."""

    def __init__(self, gs: np.ndarray, n: np.ndarray, depth: int, top: int):
        byte = gs & 255
        nodes = np.concatenate([(gs & ~np.int64(255)) | (1 << j) | (byte >> (8 - j)) for j in range(8)])
        self.ones = np.concatenate([(byte >> (7 - j)) & 1 for j in range(8)]).astype(bool)
        level, self.of_bits = np.unique(nodes, return_inverse=True)
        n = np.tile(n, 8)
        n1 = np.bincount(self.of_bits, np.where(self.ones, n, 0), len(level))
        n0 = np.bincount(self.of_bits, n, len(level)) - n1
        below = None
        #: From the deepest level up: nodes, their counts, the weight of their own estimate, and the place of each in the next level.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]] = []
        for d in range(depth, top - 1, -1):
            own = kt(n0, n1)
            evidence = own if below is None else half_of_each(own, below)
            weight = np.ones(len(own)) if below is None else np.exp(own - evidence - math.log(2))
            up, at = np.unique(shorter(level, d - 1), return_inverse=True) if d > top else (None, None)
            self.levels.append((level, n0, n1, weight, at))
            if d > top:
                n0, n1, below = (np.bincount(at, x, len(up)) for x in (n0, n1, evidence))
                level = up
        self.evidence = evidence

    def logs(self, so_far: np.ndarray, left: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's byte, given what the nodes of the top level have from above."""
        for _, n0, n1, weight, at in reversed(self.levels):
            if at is not None:
                so_far, left, mixed = so_far[at], left[at], mixed[at]
            p, known = one(n0, n1), n0 + n1 > 0
            mixed = np.where(known, so_far + left * p, mixed)
            so_far, left = so_far + left * weight * p, left * (1 - weight)
        p = mixed[self.of_bits]
        return np.log10(np.where(self.ones, p, 1 - p)).reshape(8, -1).sum(axis=0)


def by_subtree(rows: DataFrame, work, schema: str, least: int = 100_000) -> DataFrame:
    """work(columns as arrays) over rows dealt and ordered by their first column, `least` rows at a time, whole keys together."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in common.filled(batches):
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
            fresh = not held or held[-1].column(0)[-1].as_py() != key[0]
            if held and size >= least and (cut or fresh):
                first = 0 if fresh else int(np.searchsorted(key, key[0], side="right"))
                yield from work(pa.Table.from_batches([*held, b.slice(0, first)]))
                b, held, size = b.slice(first), [], 0
            held.append(b)
            size += b.num_rows
        if held:
            yield from work(pa.Table.from_batches(held))

    dealt = rows.repartition(names[0]).sortWithinPartitions(*names[:3])
    return common.in_arrow(dealt, run, schema)


def tree_scores(counted: DataFrame, depth: int) -> DataFrame:
    """gram, m and log (log10 of the probability of its last byte after the others) for counted grams."""
    top = max(0, depth - 2)
    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))

    def up(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tree = Subtree(t.column("gram").to_numpy(), t.column("n").to_numpy(), depth, top)
        level, n0, n1, *_ = tree.levels[-1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level, n0, n1, tree.evidence)], names=["node", "n0", "n1", "evidence"])

    level = common.settle(by_subtree(counted.select(context.alias("context"), "gram", "n"), up, "node long, n0 double, n1 double, evidence double"), f"level-{top}", free=True)
    levels = [level]
    for d in range(top - 1, -1, -1):
        levels.insert(0, common.settle(summed_up(levels[0], d), f"level-{d}"))
    above = None
    for d, level in enumerate(levels[:-1]):
        above = common.settle(carried_down(level, above, d), f"above-{d}")
    from_above = levels[-1].select("node") if above is None else levels[-1].select("node", shorter(F.col("node"), top - 1).alias("up")).join(above.withColumnRenamed("node", "up"), "up", "left")
    start = {"so_far": 0.0, "left": 1.0, "mixed": 0.5}
    nodes = from_above.select(F.shiftright("node", 8).alias("context"), F.lit(0).alias("kind"), F.col("node").alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"), *[F.col(c) if above is not None else F.lit(x).alias(c) for c, x in start.items()])
    leaves = counted.select(context.alias("context"), F.lit(1).alias("kind"), F.col("gram").alias("id"), "n", "m", *[F.lit(None).cast("double").alias(c) for c in start])

    def down(t: pa.Table) -> Iterator[pa.RecordBatch]:
        leaf = pc.equal(t.column("kind"), 1)
        own, above = t.filter(leaf), t.filter(pc.invert(leaf))
        gs = own.column("id").to_numpy()
        tree = Subtree(gs, own.column("n").to_numpy(), depth, top)
        order = np.argsort(above.column("id").to_numpy())
        logs = tree.logs(*(above.column(c).to_numpy()[order] for c in start))
        yield pa.RecordBatch.from_arrays([pa.array(gs), own.column("m").combine_chunks(), pa.array(logs)], names=["gram", "m", "log"])

    return by_subtree(nodes.unionByName(leaves), down, "gram long, m long, log double")


def summed_up(level: DataFrame, d: int) -> DataFrame:
    """The nodes of level d, from those one byte longer: node, n0, n1, weight and evidence."""
    up = level.groupBy(shorter(F.col("node"), d).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("evidence").alias("below"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            node, n0, n1, below = (c.to_numpy() for c in b.columns)
            own = kt(n0, n1)
            evidence = half_of_each(own, below)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, n0, n1, np.exp(own - evidence - math.log(2)), evidence)], names=["node", "n0", "n1", "weight", "evidence"])

    return common.in_arrow(up, run, "node long, n0 double, n1 double, weight double, evidence double")


def carried_down(level: DataFrame, above: DataFrame | None, d: int) -> DataFrame:
    """node, so_far, left and mixed of level d, from those of the level above it (none for the root's)."""
    if above is None:
        level = level.withColumns({"so_far": F.lit(0.0), "left": F.lit(1.0), "mixed": F.lit(0.5)})
    else:
        level = level.withColumn("up", shorter(F.col("node"), d - 1)).join(above.withColumnRenamed("node", "up"), "up")
    p, known = one(F.col("n0"), F.col("n1")), F.col("n0") + F.col("n1") > 0
    return level.select("node", (F.col("so_far") + F.col("left") * F.col("weight") * p).alias("so_far"), (F.col("left") * (1 - F.col("weight"))).alias("left"), F.when(known, F.col("so_far") + F.col("left") * p).otherwise(F.col("mixed")).alias("mixed"))


def most_frequent(scored: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """gram and log, ordered by gram, of the grams that occur most often, `most` of them at most, as far as counts tell them apart."""
    rank = F.floor(F.log2("m") * 64)
    n, least = 0, None
    for r in scored.groupBy(rank.alias("rank")).count().orderBy(F.desc("rank")).collect():  # some 64 * 64 ranks at most
        n += r["count"]
        if n > most:
            break
        least = r["rank"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    t = scored.where(rank >= least).select("gram", "log").toArrow()
    gs, logs = t.column("gram").to_numpy(), t.column("log").to_numpy()
    order = np.argsort(gs)
    return gs[order], logs[order]


def scores(docs: DataFrame, training: Column, depth: int = 5, frequent: int = 200_000, frequent_grams: int = 3_000_000) -> DataFrame:
    """Score all rows of docs by models of the rows for which `training` holds.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes. A null text counts as empty, which is one
    end token and one end byte; repeated rows are counted and scored each for itself; an empty table gives no rows, and
    without training rows every bit has 1/2 and every token the base's share of one unseen token.
    The counts of the `frequent` most frequent words and the log-probabilities of the `frequent_grams` most frequent grams
    are broadcast (at most 16 bytes a gram); the other words and grams of each text are joined with all of them.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.col("text").cast("string").alias("text"))
    counts = common.settle(count_words(texts.where("training")), "words", free=True)
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    known = spark.sparkContext.broadcast({w: (math.log10(n + 0.5)) for w, n in zip(top.column(0).to_pylist(), top.column(1).to_pylist())})
    counted = common.settle(count_grams(texts, depth), "grams", free=True)
    logs = common.settle(tree_scores(counted, depth), "logs", free=True)
    often = spark.sparkContext.broadcast(most_frequent(logs, frequent_grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_words, (common_grams, common_logs) = known.value, often.value
        for b, raw in stretches(batches, 2):
            gs, starts = grams(raw, depth)
            unique, at = np.unique(gs, return_inverse=True)
            place = np.minimum(np.searchsorted(common_grams, unique), max(0, len(common_grams) - 1))
            here = common_grams[place] == unique if len(common_grams) else np.zeros(len(unique), bool)
            total_score = np.add.reduceat(np.where(here, common_logs[place] if len(common_grams) else 0.0, 0.0)[at], starts)
            rare = np.flatnonzero(~here[at])
            rare_ends = np.searchsorted(rare, [*starts, len(gs)])
            n_tokens, n_known, sums, rest = [], [], [], []
            for t in raw:
                ws = t.split()
                ws.append(b"")
                found = list(map(common_words.get, ws))
                own = [x for x in found if x is not None]
                n_tokens.append(len(ws))
                n_known.append(len(own))
                sums.append(math.fsum(own))
                rest.append(list(Counter(w for w, x in zip(ws, found) if x is None).items()) if len(own) < len(ws) else [])
            tail = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rest)]), pa.int32()), pa.StructArray.from_arrays([pa.array([w for r in rest for w, _ in r], pa.binary()), pa.array([n for r in rest for _, n in r], pa.int64())], names=["word", "k"]))
            grams_left = pa.ListArray.from_arrays(pa.array(rare_ends, pa.int32()), pa.array(gs[rare]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.array(total_score), pa.array([len(t) for t in raw], pa.int64()), tail, grams_left], names=["doc_id", "training", "n_tokens", "known", "sum", "log", "n_bytes", "tail", "rare"])

    scored = common.in_arrow(texts, run, "doc_id long, training boolean, n_tokens long, known long, sum double, log double, n_bytes long, tail array<struct<word:binary,k:long>>, rare array<long>")
    scored = common.settle(scored.withColumn("row", F.monotonically_increasing_id()), "scored", free=True)
    tail = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k").join(counts, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    tail = tail.groupBy("row").agg(F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10(c + 0.5)).alias("more"))
    rare = scored.select("row", F.explode("rare").alias("gram")).join(logs.select("gram", F.col("log").alias("own")), "gram").groupBy("row").agg(F.sum("own").alias("more_log"))
    everything = math.log10(total + 0.5 * (kinds + 1))
    more = lambda x: F.coalesce(F.col(x), F.lit(0))
    joined = scored.drop("tail", "rare").join(tail, "row", "left").join(rare, "row", "left")
    return joined.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", (F.col("known") + more("more_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("sum") + more("more") - F.col("n_tokens") * everything).alias("base_score"), (F.col("log") + more("more_log")).alias("score"), "n_bytes")
