"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models, of toxic and of ordinary texts, give each character of a word its probability after up to five characters
before it in the word. Each discounts its own counts and backs off to one shared model of shorter contexts, whose
continuation counts come from both classes; so an expression that a class has seen too rarely costs the same in both.
A text's evidence is the difference of its log-likelihoods divided by its number of words, as far as each word's exceeds
a margin, and a logistic curve turns it into a score. Margin and curve are fitted on the training texts alone: each is
scored by models of the other folds. Counts and models of all folds are estimated together by grouping and joins.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

START, END = "\x02", "\x03"
ORDER = 6
MIX = np.uint64(0x9E3779B97F4A7C15)


#: What may stand around a word.
EDGES = string.punctuation + "…«»¿¡“”‘’„–—"


def words(text: str | None) -> list[str]:
    """Lower-case words with what stands around them."""
    return (text or "").lower().split()


def core(word: str) -> str:
    return word.strip(EDGES)


def grams(word: str) -> list[str]:
    """For each character of the word and its end, the character after up to ORDER - 1 characters from the word's start on."""
    w = START + word + END
    return [w[max(0, i + 1 - ORDER) : i + 1] for i in range(1, len(w))]


def hashes(codes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the context of each position and of the context with its character; place: characters before it in its word."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(1, ORDER):
        before = np.concatenate([np.zeros(k, np.uint64), codes[:-k]]) if k < len(codes) else np.zeros(len(codes), np.uint64)
        h = np.where(place >= k, (h ^ (before + np.uint64(1))) * MIX, h)
        h = np.where(place >= k, h ^ (h >> np.uint64(29)), h)
    g = (h + np.uint64(77)) * MIX ^ (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return h, g ^ (g >> np.uint64(31))


def positions(of: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, places and starts of words joined, each with its start and end marks."""
    joined = "".join([f"{START}{w}{END}" for w in of])
    sizes = np.fromiter(map(len, of), np.int64, len(of)) + 2
    starts = np.cumsum(sizes) - sizes
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), np.arange(len(joined)) - np.repeat(starts, sizes), starts


#: What a word's evidence must exceed to count; the first is no margin at all. Units of the curve's argument.
MARGINS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
SCALES = (1e-4, 1e-3, 1e-2, 1e-1)


@dataclass
class Model:
    """Log-likelihood ratios by hash: of seen grams, and of contexts for the characters not seen after them in either class."""

    gram_keys: np.ndarray
    gram_ratios: np.ndarray
    context_keys: np.ndarray
    context_ratios: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    margin: float = 3.0
    scale: float = 1.0

    def ratios(self, of: list[str]) -> np.ndarray:
        """For each word the log of its probability as toxic over that as ordinary."""
        if not of:
            return np.zeros(0)
        codes, place, starts = positions(of)
        h, g = hashes(codes, place)
        out = np.zeros(len(codes), np.float32)
        for keys, values, want in ((self.context_keys, self.context_ratios, h), (self.gram_keys, self.gram_ratios, g)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                out = np.where(keys[at] == want, values[at], out)
        out[starts] = 0
        return np.add.reduceat(out.astype(np.float64), starts)

    def probability(self, evidence: Column) -> Column:
        return 1 / (1 + F.exp(-(F.asinh(evidence / self.scale) * self.slope + self.offset)))


def beyond(ratios: np.ndarray, margin: float) -> np.ndarray:
    """What of words' ratios counts. By chance the models differ on most words a little, which summed over a long text would outweigh a few toxic ones."""
    return np.sign(ratios) * np.maximum(np.abs(ratios) - margin, 0)


class Scorer:
    """Evidence of texts under a model; the ratios of up to 2 * cached words are kept."""

    def __init__(self, model: Model, cached: int = 120_000):
        self.model, self.cached = model, cached
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def ratios(self, of: list[str]) -> np.ndarray:
        found = list(map(self.young.get, of))
        lost = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in lost:
            if (x := self.old.get(of[i])) is None:
                new.append(i)
            else:
                found[i] = x
        for i, x in zip(new, self.model.ratios([of[i] for i in new]).tolist()):
            found[i] = x
        if len(self.young) >= self.cached:
            self.young, self.old = {}, self.young
        self.young.update((of[i], found[i]) for i in lost if len(of[i]) <= 64)
        return np.array(found, float)

    def evidence(self, texts: pa.Array, margins: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
        """By text and margin the sum of what its words' ratios exceed the margin by, divided by the number of words; and that number."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        places = lists.offsets.to_numpy()
        coded = lists.values.slice(places[0], places[-1] - places[0]).dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        starts = (places - places[0])[:-1]
        some = np.diff(places) > 0
        by_text = lambda x: np.add.reduceat(x, starts[some]) if some.any() else np.zeros(0)
        counts = np.zeros(len(texts), np.int64)
        counts[some] = by_text((pc.binary_length(words).to_numpy() > 0).astype(np.int64)[codes])
        ratios = self.ratios(pc.utf8_trim(words, EDGES).to_pylist())
        out = np.zeros((len(texts), len(margins)))
        for k, m in enumerate(margins):
            out[some, k] = by_text(beyond(ratios, m)[codes])
        return out / np.maximum(counts, 1)[:, None], counts


def text_counts(texts: DataFrame) -> DataFrame:
    """fold, toxic, gram, n over texts (fold, toxic, text); a word counts once in a text, so that no text's repetitions make a rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            own: dict[tuple[int, int], Counter] = defaultdict(Counter)
            for fold, c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own[fold, c].update(set(map(core, words(text.as_py()))) - {""})
            for (fold, c), counted in own.items():
                of_gram: Counter = Counter()
                for w, n in counted.items():
                    for g in grams(w):
                        of_gram[g] += n
                k = len(of_gram)
                yield pa.RecordBatch.from_arrays([pa.array([fold] * k, pa.int32()), pa.array([c] * k, pa.int32()), pa.array(list(of_gram)), pa.array(list(of_gram.values()), pa.int64())], names=["fold", "toxic", "gram", "n"])

    return common.in_arrow(texts.select("fold", "toxic", "text"), run, "fold int, toxic int, gram string, n long").groupBy("fold", "toxic", "gram").agg(F.sum("n").alias("n"))


def estimate(counts: DataFrame, folds: int, discount: float) -> DataFrame:
    """model, key, as_context and ratio of Kneser-Ney models from counts by fold, class and gram.

    Model k below `folds` leaves fold k out; model `folds` has all. The shared model interpolates the pooled counts of full
    grams with continuation counts of shorter ones, with discounts estimated from the numbers of grams seen once and
    twice. A class's model takes `discount` from each of its counts and gives what that frees to the shared model, so a gram
    that a class has no more often than that tells the classes apart by its context only.
    """
    by_class = lambda c: F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0))
    models = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds)), lambda m: m != F.col("fold"))).alias("model")
    pooled = common.settle(counts.select(models, "toxic", "gram", "n").groupBy("model", "gram").agg(by_class(0).alias("n0"), by_class(1).alias("n1")), "gram-counts")

    #: From full grams down: grams from a word's start on are counted as they are, all others by the grams one longer.
    size, levels = F.length("gram"), []
    for n in range(ORDER, 0, -1):
        own = pooled.where(size == n).select("model", "gram", (F.col("n0") + F.col("n1")).alias("k"))
        if levels:
            longer = levels[0].select("model", F.expr("substring(gram, 2)").alias("gram"), F.lit(1).cast("long").alias("k"))
            own = common.settle(own.unionByName(longer).groupBy("model", "gram").agg(F.sum("k").alias("k")), f"counts-{n}")
        levels.insert(0, own)
    shared = common.settle(reduce(DataFrame.unionByName, levels).withColumn("size", size), "shared-counts")
    seen = shared.groupBy("model", "size").agg(F.sum("k").alias("sum"), F.count("*").alias("kinds"), F.count_if(F.col("k") == 1).alias("once"), F.count_if(F.col("k") == 2).alias("twice"))
    seen = F.broadcast(seen.select("model", "size", (F.col("sum") + 0.5 * (F.col("kinds") + 1)).alias("base"), F.when(F.col("once") > 0, F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5).alias("d")))

    context = F.expr("substring(gram, 1, length(gram) - 1)")
    own = lambda n: shared.where(F.col("size") == n).join(seen, ["model", "size"])
    p = own(1).select("model", "gram", ((F.col("k") + 0.5) / F.col("base")).alias("p"))
    of_size = [p]
    for n in range(2, ORDER + 1):
        after = Window.partitionBy("model", "context")
        level = own(n).withColumn("context", context).withColumn("total", F.sum("k").over(after)).withColumn("kinds", F.count("*").over(after)).withColumn("shorter", F.expr("substring(gram, 2)"))
        level = level.join(of_size[-1].withColumnsRenamed({"gram": "shorter", "p": "backoff"}), ["model", "shorter"])
        level = level.select("model", "gram", ((F.col("k") - F.col("d") + F.col("d") * F.col("kinds") * F.col("backoff")) / F.col("total")).alias("p"))
        of_size.append(common.settle(level, f"chances-{n}"))  # the next level and the last join read it
    p = reduce(DataFrame.unionByName, of_size)

    found = pooled.join(p, ["model", "gram"]).withColumn("context", context)
    by_context = pooled.withColumn("context", context).groupBy("model", "context").agg(*[f for c in "01" for f in (F.sum(f"n{c}").alias(f"total{c}"), F.sum(F.least(F.col(f"n{c}"), F.lit(discount))).alias(f"freed{c}"))])
    freed = lambda c: F.when(F.col(f"total{c}") > 0, F.col(f"freed{c}") / F.col(f"total{c}")).otherwise(1.0)
    by_context = by_context.select("model", "context", "total0", "total1", freed(0).alias("freed0"), freed(1).alias("freed1"))
    chance = lambda c: F.when(F.col(f"total{c}") > 0, F.greatest(F.col(f"n{c}") - discount, F.lit(0.0)) / F.col(f"total{c}")).otherwise(0.0) + F.col(f"freed{c}") * F.col("p")
    of_grams = found.join(by_context, ["model", "context"]).select("model", "gram", F.lit(False).alias("as_context"), F.log(chance(1) / chance(0)).cast("float").alias("ratio"))
    of_contexts = by_context.select("model", F.col("context").alias("gram"), F.lit(True), F.log(F.col("freed1") / F.col("freed0")).cast("float"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys(b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)).view(np.int64)), b.column(2), b.column(3)], names=["model", "key", "as_context", "ratio"])

    return common.in_arrow(of_grams.union(of_contexts), run, "model int, key long, as_context boolean, ratio float")


def keys(of: list[str], as_context: np.ndarray) -> np.ndarray:
    """The hashes of grams or contexts, as hashes() gives them."""
    sizes = np.fromiter(map(len, of), np.int64, len(of)) + 1
    codes = np.frombuffer("".join([f"{g}\x00" for g in of]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes) - 1
    h, g = hashes(codes, np.arange(len(codes)) - np.repeat(ends + 1 - sizes, sizes))
    return np.where(as_context, h[ends], g[np.maximum(ends - 1, 0)])


def read_model(estimated: DataFrame, number: int) -> Model:
    """One of the models as arrays in order of their keys; what it holds is bounded by the sample that it comes from."""
    arrays = []
    for as_context in (False, True):
        own = estimated.where((F.col("model") == number) & (F.col("as_context") == as_context)).select("key", "ratio").toArrow()
        key, ratio = own.column(0).to_numpy().view(np.uint64), own.column(1).to_numpy()
        order = np.argsort(key)
        arrays += [key[order], ratio[order]]
    return Model(*arrays)


def sample(labels: DataFrame, max_rows: int) -> DataFrame:
    """doc_id, toxic of at most max_rows labelled documents of each class, those with the smallest hashes of their ids.

    A document with several labels counts as toxic if one says so; rows without an id or a label of 0 or 1 don't count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    pick = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return pick(0).unionByName(pick(1))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression of y on x."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, folds: int = 4, discount: float = 2.0, false_positives: float = 0.01, threshold: float = 0.7) -> Model:
    """A model from a bounded sample of labelled documents: max_rows of each class at most; what they hold is all that is collected.

    Each sampled text is scored by the models of the other folds. Of MARGINS and SCALES those are taken whose logistic curve
    has the least log loss over these scores, both classes weighing the same; its offset is then lowered until the
    share of ordinary texts at or above the threshold is within false_positives. Labels or texts that are null, and labels of
    documents that docs lacks, don't count. If a class has no texts, all scores are the share of toxic labels.
    """
    chosen = sample(labels, max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = common.settle(texts.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(folds)).cast("int")), "labelled")
    shares = {r["toxic"]: r["n"] for r in labels.where(F.col("toxic").isin(0, 1)).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    empty = np.zeros(0, np.uint64), np.zeros(0, np.float32)
    if texts.select("toxic").distinct().count() < 2:
        return Model(*empty, *empty, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    estimated = common.settle(estimate(text_counts(texts), folds, discount), "models", free=True)
    evidence, toxic = [], []
    for k in range(folds):
        seen = score_raw(texts.where(F.col("fold") == k).select("toxic", "text"), read_model(estimated, k), margins=MARGINS).toArrow()
        evidence += seen.column("evidence").to_pylist()
        toxic += seen.column("toxic").to_pylist()
    model = read_model(estimated, folds)
    model.margin, model.scale, model.slope, model.offset = curve(np.array(evidence), np.array(toxic, float), false_positives, threshold)
    return model


def curve(evidence: np.ndarray, toxic: np.ndarray, false_positives: float, threshold: float) -> tuple[float, float, float, float]:
    """Margin, scale, slope and offset from evidence by margin of texts that their models did not see."""
    weight = np.where(toxic == 1, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))
    best = None
    for k, margin in enumerate(MARGINS):
        for scale in SCALES:
            x = np.arcsinh(evidence[:, k] / scale)
            slope, offset = logistic(x, toxic, weight)
            z = np.where(toxic == 1, 1, -1) * (slope * x + offset)
            loss = float((weight * np.logaddexp(0, -z)).sum())
            if slope > 0 and (best is None or loss < best[0]):
                best = loss, margin, scale, slope, offset, x
    if best is None:
        return 0.0, 1.0, 0.0, float(np.log(toxic.mean() / (1 - toxic.mean())))
    _, margin, scale, slope, offset, x = best
    ordinary = np.sort(slope * x[toxic == 0])
    highest = ordinary[min(len(ordinary) - 1, int(np.ceil((1 - false_positives) * len(ordinary))))]
    return margin, scale, slope, min(offset, float(np.log(threshold / (1 - threshold)) - highest - 1e-3))


def score_raw(texts: DataFrame, model: Model, names: tuple[str, str] = ("evidence", "n_words"), keep_text: bool = False, margins: tuple[float, ...] | None = None) -> DataFrame:
    """texts with evidence and n_words of the column text, under these names; without the text itself unless keep_text.

    Evidence is at the model's margin, or if margins are given an array, by margin.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    at = texts.columns.index("text")
    kept = [i for i in range(len(texts.columns)) if keep_text or i != at]
    kind = T.DoubleType() if margins is None else T.ArrayType(T.DoubleType())
    schema = T.StructType([*(texts.schema.fields[i] for i in kept), T.StructField(names[0], kind), T.StructField(names[1], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in common.filled(batches):
            found, n = scorer.evidence(b.column(at), margins or (shared.value.margin,))
            e = pa.array(found[:, 0]) if margins is None else pa.array(list(found), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), e, pa.array(n)], names=schema.fieldNames())

    return common.in_arrow(texts, run, schema)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, evidence, n_words for each row of docs. A null or empty text has no evidence either way.

    Repeated rows are scored each for itself; an empty table gives no rows. Only the text is read for a score.
    """
    s = score_raw(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return s.withColumn("score", model.probability(F.col("evidence"))).withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "score", "predicted", "evidence", "n_words")


def keep_ordinary(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold.

    A null or empty text has no evidence and so goes only where the model holds most texts toxic. Repeated rows stay or
    go together; an empty table stays empty; columns of docs may have any names.
    """
    names = tuple(common.free_name(docs, x) for x in ("evidence", "n_words"))
    s = score_raw(docs.withColumn("text", F.col("text").cast("string")), model, names, keep_text=True)
    return s.where(model.probability(F.col(names[0])) < threshold).select(*docs.columns)
