"""Periodic runs of words, by an enhanced suffix array and the branching-tandem test.

A run of period q ends in a square (two copies, one after the other, of q words) whose two copies are followed by different words.
The two suffixes at such a square's copies share exactly q words, so they stand in the LCP interval of depth q, in different children.
For each interval all suffixes but those of its largest child look whether the suffix `depth` words before or after them is in the
interval too: O(n log n) looks. A square found is then rotated to the left as far as its words repeat, which gives its whole run.

Documents are worked on in blocks of some 200,000 words. A document is part of the first rank, so suffixes of different documents
share nothing, and an interval never leaves its document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
#: What collapse() adds.
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def suffix_array(keys: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of a block, and ranks by level.

    keys: a number for each word, equal for equal words of one document only. ends: the end of each word's document.
    Two places have the same rank at level r if and only if the 2**r words from them on are the same and within their
    document. The last rank is the inverse suffix array. Only places that aren't alone with their rank are sorted again.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    fresh = np.r_[True, keys[order][1:] != keys[order][:-1]]
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks, width = [rank.astype(np.int32)], 1
    alone = fresh & np.r_[fresh[1:], True]
    active = order[~alone]
    while len(active):
        after = active + width
        second = np.where(after < ends[active], rank[np.minimum(after, n)], -1) + 1
        first = rank[active]
        both = first * (n + 1) + second
        by = np.argsort(both, kind="stable")
        active, both, first = active[by], both[by], first[by]
        fresh = np.r_[True, both[1:] != both[:-1]]
        at = np.arange(len(active))
        group = np.maximum.accumulate(np.where(np.r_[True, first[1:] != first[:-1]], at, 0))
        rank[active] = first + np.maximum.accumulate(np.where(fresh, at, 0)) - group
        ranks.append(rank.astype(np.int32))
        active = active[~(fresh & np.r_[fresh[1:], True])]
        width *= 2
    array = np.empty(n, np.int64)
    array[rank[:n]] = np.arange(n)
    return array, ranks


def common_prefixes(array: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """For each place of the suffix array, how many words its suffix shares with the one before; 0 at both ends."""
    a, b = array[:-1].copy(), array[1:].copy()
    shared = np.zeros(len(array) + 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = np.flatnonzero(ranks[level][a] == ranks[level][b])
        a[same] += 1 << level
        b[same] += 1 << level
        shared[same + 1] += 1 << level
    return shared


def borders(lcp: list[int]) -> tuple[np.ndarray, ...]:
    """For each border k of the suffix array: the nearest borders before and after it with a smaller value, and those with one not larger."""
    n = len(lcp)
    less, least, more, most = [0] * n, [0] * n, [n - 1] * n, [0] * n
    stack = [0]
    for k in range(1, n):
        h = lcp[k]
        top = stack[-1]
        while lcp[top] > h:
            stack.pop()
            more[top] = k
            if not most[top]:
                most[top] = k
            top = stack[-1]
        least[k] = top
        if lcp[top] == h:
            if not h:
                stack[0] = k  # nothing goes on beyond a border of 0
                continue
            less[k] = less[top]
            if not most[top]:
                most[top] = k
        else:
            less[k] = top
        stack.append(k)
    return tuple(np.array(x, np.int64) for x in (less, least, more, most))


def branching_squares(array: np.ndarray, ranks: list[np.ndarray], times: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares whose copies are followed by different words, of periods that fit `times` times into their document."""
    n, inverse = len(array), ranks[-1]
    lcp = common_prefixes(array, ranks)
    less, least, more, most = borders(lcp.tolist())
    k = np.flatnonzero(lcp[:n] > 0)
    k = k[times * lcp[k] <= sizes[array[k]]]
    if not len(k):
        return k, k
    first = k[least[k] == less[k]]
    low, high = np.r_[k, less[first]], np.r_[most[k], first]  # children: those right of each border, and the leftmost of each interval
    of = np.r_[k, first]
    left, right, depth = less[of], more[of], lcp[of]
    by = np.lexsort((low - high, left * (n + 1) + right))
    low, high, left, right, depth = low[by], high[by], left[by], right[by], depth[by]
    small = np.r_[False, (left[1:] == left[:-1]) & (right[1:] == right[:-1])]  # the largest child of each interval comes first
    low, high, left, right, depth = low[small], high[small], left[small], right[small], depth[small]
    count = high - low
    each = np.repeat(np.arange(len(low)), count)
    i = array[np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + low[each]]
    low, high, left, right, depth = low[each], high[each], left[each], right[each], depth[each]
    found = []
    for start, other in ((i, i + depth), (i - depth, i - depth)):
        place = inverse[np.clip(other, -1, n)]
        hit = (other >= 0) & (place >= left) & (place < right) & ((place < low) | (place >= high))
        found.append((start[hit], depth[hit]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def periodic_runs(words: np.ndarray, bounds: np.ndarray, least: int = 6, times: int = 4) -> np.ndarray:
    """Rows start, end, period of the maximal runs of at least `least` words and `times` smallest periods, by start and period.

    words: a number for each word of a block of documents. bounds: where each document starts, and the end of the last.
    """
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    sizes = np.diff(bounds)
    of = np.repeat(np.arange(len(sizes)), sizes)
    array, ranks = suffix_array(of * (int(words.max()) + 1) + words, bounds[1:][of])
    start, period = branching_squares(array, ranks, times, sizes[of])
    end = start + 2 * period
    for level in range(len(ranks) - 1, -1, -1):  # rotate to the left, by powers of two
        before = start - (1 << level)
        same = ranks[level][np.maximum(before, -1)] == ranks[level][np.maximum(before + period, -1)]
        start = np.where((before >= 0) & same, before, start)
    long = end - start >= np.maximum(least, times * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    found = np.stack([start[by], end[by], period[by]], axis=1)
    found = found[np.r_[True, (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1])]] if len(found) else found  # multiples of a period have its run
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse_block(texts: list[str | None], least: int, times: int) -> list[pa.Array]:
    """The added columns of some texts."""
    seen: dict[bytes, int] = {}
    split = [t.encode().split() if t else [] for t in texts]  # at 0x20 and 0x09 to 0x0D
    bounds = np.cumsum([0, *map(len, split)])
    words = np.fromiter((seen.setdefault(w, len(seen)) for ws in split for w in ws), np.int64, bounds[-1])
    found = periodic_runs(words, bounds, least, times)
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    collapsed = []
    for ws, a in zip(split, bounds):
        flags = kept[a : a + len(ws)]
        collapsed.append(b" ".join(ws if flags.all() else [w for w, k in zip(ws, flags) if k]).decode())
    of = np.searchsorted(bounds, found[:, 0], "right") - 1
    offsets = np.searchsorted(of, np.arange(len(texts) + 1))
    values = (found[:, 0] - bounds[of], found[:, 1] - found[:, 0], found[:, 2])
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], RUN.fieldNames()))
    return [pa.array(np.diff(bounds), pa.int64()), runs, pa.array(collapsed, pa.string())]


def collapse(docs: DataFrame, least: int = 6, times: int = 4, block_bytes: int = 1_000_000) -> DataFrame:
    """docs with n_words, runs (start, length, period, by start and period) and collapsed, the text without the words of each run
    after its first period, joined by single spaces.

    A word is a stretch without white space (0x20, 0x09 to 0x0D). A run is a stretch of `least` words and `times` smallest periods
    or more, which no neighbouring word extends. Null and empty texts have no words, no runs and an empty collapsed text;
    repeated rows stay, each for itself; an empty table stays empty. Columns of docs called like an added one are replaced.
    A text is worked on whole, with others up to about block_bytes bytes.
    """
    kept = docs.drop(*ADDED.fieldNames()).withColumn("text", F.col("text").cast("string"))
    at, names = kept.columns.index("text"), [*kept.columns, *ADDED.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            blocks = np.cumsum(sizes, dtype=np.int64) // block_bytes
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, *collapse_block(part.column(at).to_pylist(), least, times)], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *ADDED.fields]))
