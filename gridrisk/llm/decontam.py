"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of words of every item. A task streams a document's words through it and so knows, at
each word, the longest run ending there that also stands in some item. Where that run has at least `window` words, the
last `window` of them are a window of an item. Items shorter than a window count as a whole.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes of words of the items that a worker holds as an automaton at a time.
MAX_BYTES = 2_000_000
#: What match() adds.
SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("longest_match", T.LongType()), T.StructField("hit_spans", T.ArrayType(SPAN)), T.StructField("item_ids", T.ArrayType(T.StringType()))])


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, ASCII letters and characters beyond ASCII."""
    return (text or "").encode().translate(common.ALNUM).split()


class Automaton:
    """Generalised suffix automaton over sequences of words, with the items of each window and each short item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []
        whole: list[tuple[list[int], str]] = []
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]
            last = 0
            for x in ids:
                last = self._extend(last, x)
                if len(ids) >= window:
                    ends.append((last, item))
            if 0 < len(ids) < window:
                whole.append((ids, item))
        n = len(self.length)
        order = sorted(range(1, n), key=self.length.__getitem__)
        #: The short items that are runs of a state, by their length: each stands at one state, whatever number of runs ends with it.
        self.short: dict[int, dict[int, set[str]]] = {}
        for ids, item in whole:
            v = 0
            for x in ids:
                v = self.next[v][x]
            self.short.setdefault(v, {}).setdefault(len(ids), set()).add(item)
        #: For each state, that of its runs' last `window` words, and the nearest of itself and its links that has short items.
        self.at_window, self.at_short = [-1] * n, [-1] * n
        for v in order:
            up = self.link[v]
            if self.length[v] >= window:
                self.at_window[v] = v if self.length[up] < window else self.at_window[up]
            self.at_short[v] = v if v in self.short else self.at_short[up]
        #: A state's items are those with a run that ends in it or in any state below it.
        below: dict[int, set[str]] = {}
        for v, item in ends:
            below.setdefault(v, set()).add(item)
        for v in reversed(order):
            if v in below and self.length[self.link[v]] >= window:
                below.setdefault(self.link[v], set()).update(below[v])
        self.items = {v: below[v] for v in set(self.at_window) if v >= 0}
        self.least = min([window, *(len(ids) for ids, _ in whole)])

    def _extend(self, last: int, x: int) -> int:
        if x in self.next[last]:
            q = self.next[last][x]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, x, q)
        cur = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, x, q)
        return cur

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(follow)
        self.link.append(link)
        return len(self.length) - 1

    def _clone(self, p: int, x: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = clone
            p = self.link[p]
        return clone

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], int, set[str]]:
        """The hit stretches (word numbers, end exclusive, merged), the longest match in words, and the items with a hit."""
        ids = np.fromiter((self.vocabulary.get(w, -1) for w in ws), np.int32, len(ws))
        known = np.concatenate([[0], (ids >= 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known)).reshape(-1, 2)
        spans: list[list[int]] = []
        windows: set[int] = set()
        shorts: set[tuple[int, int]] = set()
        longest = 0  # matches shorter than any window or short item are not looked for

        def hit(s: int, e: int) -> None:
            while spans and spans[-1][0] >= s:
                spans.pop()
            if spans and spans[-1][1] >= s:
                spans[-1][1] = e
            else:
                spans.append([s, e])

        for s, e in edges[edges[:, 1] - edges[:, 0] >= self.least].tolist():
            v = n = 0
            for i, x in enumerate(ids[s:e].tolist(), s):
                while v and x not in self.next[v]:
                    v = self.link[v]
                    n = self.length[v]
                if x in self.next[v]:
                    v, n = self.next[v][x], n + 1
                longest = max(longest, n)
                if n >= self.window:
                    hit(i + 1 - self.window, i + 1)
                    windows.add(self.at_window[v])
                u = self.at_short[v]
                while u >= 0:
                    for length in self.short[u]:
                        if length <= n:
                            hit(i + 1 - length, i + 1)
                            shorts.add((u, length))
                    u = self.at_short[self.link[u]]
        found = set().union(*(self.items[v] for v in windows), *(self.short[u][length] for u, length in shorts))
        return [(a, b) for a, b in spans], longest, found


def parts(ws: list[bytes], window: int, max_bytes: int) -> Iterator[list[bytes]]:
    """ws in stretches of at most max_bytes, but of `window` words at least, that share window - 1 words."""
    at = 0
    while True:
        end, size = at, 0
        while end < len(ws) and (end - at < window or size + len(ws[end]) <= max_bytes):
            size += len(ws[end])
            end += 1
        yield ws[at:end]
        if end == len(ws):
            return
        at = end - window + 1


def item_blocks(benchmark: DataFrame, window: int, max_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most max_bytes of words each, however large the benchmark is; there is at least one block.

    An item longer than a block is cut into stretches that share window - 1 words.
    """
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out, size, blocks = [], 0, 0
    for item, text in b.toLocalIterator():
        for part in parts(words(text), window, max_bytes):
            more = sum(map(len, part))
            if out and size + more > max_bytes:
                yield out
                out, size, blocks = [], 0, blocks + 1
            out.append((item, part))
            size += more
    if out or not blocks:
        yield out


def match(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside a window or whole short item), longest_match, hit_spans and item_ids.

    hit_spans are stretches of words that hit, merged. A null text has no words and no hits; repeated rows are matched
    each for itself; an item with a null id goes by the id "null"; without items, or for an empty table, nothing hits.
    Columns of docs with these names are replaced. Items are broadcast in blocks of at most max_bytes of words. Where
    there are several, docs are written once with numbered rows, each block passes over the texts and writes what it
    found by row, and one join puts it back: copies of the texts don't grow with the blocks.
    """
    base = docs.drop(*FOUND.fieldNames())
    found, column = _found(base, benchmark, window, max_bytes)
    return found.select(*base.columns, *[F.col(column)[c].alias(c) for c in FOUND.fieldNames()])


def _found(docs: DataFrame, benchmark: DataFrame, window: int, max_bytes: int) -> tuple[DataFrame, str]:
    """docs with one more column, FOUND over all blocks, and its name."""
    column, row = common.free_name(docs, "match"), common.free_name(docs, "row")
    empty, broadcast = F.lit(None).cast(FOUND), docs.sparkSession.sparkContext.broadcast
    blocks = item_blocks(benchmark, window, max_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        found = docs.withColumn(column, empty)
        return common.in_arrow(found, _matcher(broadcast(first), window, docs.columns.index("text")), found.schema, keeps=True), column
    numbered = common.settle(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(row, "text", empty.alias(column))
    schema = texts.schema
    hits = [common.settle(common.in_arrow(texts, _matcher(broadcast(items), window, 1), schema, keeps=True).drop("text"), "hits") for items in chain([first, second], blocks)]
    every = reduce(DataFrame.union, hits).groupBy(row).agg(F.collect_list(column).alias(column))
    joined = numbered.join(every, row).drop(row)
    return common.in_arrow(joined, _merger, T.StructType([*joined.schema.fields[:-1], T.StructField(column, FOUND)])), column


def _automaton(items, window: int):
    """A function that gives the automaton of broadcast items, built once a worker."""
    key = f"automaton {uuid.uuid4().hex}"
    return lambda: common.held(key, lambda: Automaton(items.value, window))


def _row(n_words: int, spans: list[tuple[int, int]], longest: int, ids: set[str]) -> dict:
    return {"n_words": n_words, "n_hit": sum(e - s for s, e in spans), "longest_match": longest, "hit_spans": [{"start": s, "end": e} for s, e in spans], "item_ids": sorted(ids)}


def _matcher(items, window: int, text_at: int):
    """For mapInArrow: fills the last column by one block of items."""
    automaton = _automaton(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            texts = (words(text.as_py()) for text in b.column(text_at))
            rows = [_row(len(ws), *automaton().match(ws)) for ws in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, b.schema.types[-1])], names=b.schema.names)

    return run


def _merger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the last column, what each block of items found, becomes what all of them found."""
    for b in common.filled(batches):
        rows = []
        for blocks in b.column(b.num_columns - 1):
            xs = blocks.as_py()
            spans = merged([(y["start"], y["end"]) for x in xs for y in x["hit_spans"]])
            rows.append(_row(xs[0]["n_words"], spans, max(x["longest_match"] for x in xs), set().union(*(x["item_ids"] for x in xs))))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, b.schema.types[-1].value_type)], names=b.schema.names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the stretches of words that are given by word numbers; a line break takes the place of each."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.translate(common.LOWER))]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"\n".join([*out, raw[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs without what hits the benchmark, in their own columns; n_chars, where docs has it, follows the new text.

    A stretch of words that reaches the length limit (`window`, or a whole shorter item) is removed; a document of which
    more than max_coverage of the words hit is removed as a whole. What moves together when a stretch goes may hit
    again, so this is repeated until nothing hits; each time the text gets shorter. With one block of items a text is
    cleaned in one task. With several, each pass first collects the hits of all blocks and then judges and cuts once, so
    the rows are the same; only what was cut goes through another pass.
    A null or empty text hits nothing and stays; repeated rows are cleaned each for itself; an empty table stays empty, and
    without items nothing changes. Other columns of docs may have any names.
    """
    spark, columns = docs.sparkSession, docs.columns
    docs = docs.withColumn("text", F.col("text").cast("string"))
    blocks = item_blocks(benchmark, window, max_bytes)
    first, second = next(blocks), next(blocks, None)
    places = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None
    if second is None:
        return common.in_arrow(docs, _cleaner(spark.sparkContext.broadcast(first), window, max_coverage, *places), docs.schema, keeps=True)
    done = []
    while True:
        found, column = _found(docs, benchmark, window, max_bytes)
        found = common.settle(found, "found")
        done.append(found.where(F.col(column)["n_hit"] == 0).select(*columns))
        docs = common.settle(common.in_arrow(found.where(F.col(column)["n_hit"] > 0), _cutter(max_coverage, *places), found.schema).select(*columns), "cut")
        if docs.isEmpty():
            return reduce(DataFrame.union, done)


def _cleaner(items, window: int, max_coverage: float, text_at: int, chars_at: int | None):
    """For mapInArrow: cuts hits out of texts and leaves out the rows whose documents go."""

    automaton = _automaton(items, window)

    def clean(text: str | None) -> tuple[bool, str | None]:
        while True:
            ws = words(text)
            spans, _, _ = automaton().match(ws)
            hit = sum(e - s for s, e in spans)
            if not hit or hit > max_coverage * len(ws):
                return not hit, text
            text = cut_spans(text, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            yield _rewritten(b, [clean(text.as_py()) for text in b.column(text_at)], text_at, chars_at)

    return run


def _cutter(max_coverage: float, text_at: int, chars_at: int | None):
    """For mapInArrow: one pass by the hits in the last column."""

    def cut(text: str, found: dict) -> tuple[bool, str]:
        if found["n_hit"] > max_coverage * found["n_words"]:
            return False, text
        return True, cut_spans(text, [(x["start"], x["end"]) for x in found["hit_spans"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.filled(batches):
            yield _rewritten(b, [cut(text.as_py(), found.as_py()) for text, found in zip(b.column(text_at), b.column(b.num_columns - 1))], text_at, chars_at)

    return run


def _rewritten(b: pa.RecordBatch, cleaned: list[tuple[bool, str | None]], text_at: int, chars_at: int | None) -> pa.RecordBatch:
    """The batch with each row's (stays, text) applied; n_chars follows a text that changed."""
    out = list(b.columns)
    out[text_at] = pa.array([text for _, text in cleaned], b.schema.types[text_at])
    if chars_at is not None:
        sizes = b.column(chars_at).to_pylist()
        for i, (old, (_, text)) in enumerate(zip(b.column(text_at), cleaned)):
            if old.as_py() != text:
                sizes[i] = len(text)
        out[chars_at] = pa.array(sizes, b.schema.types[chars_at])
    return pa.RecordBatch.from_arrays(out, names=b.schema.names).filter(pa.array([stays for stays, _ in cleaned], pa.bool_()))
