"""Best-fit packing of tokenised documents into sequences, improved by swaps between underfull bins.

Each document becomes its ids and one end id; only a document longer than a sequence is cut, its first piece being the
shorter one. Full pieces fill sequences of their own. The other pieces are dealt by a hash into blocks of about
`block` pieces, and each block is packed in one task: best fit in order of arrival, then a local search that moves one
piece, or exchanges one or two for one, between underfull bins so that the sum of squared fills grows, and that drops
bins which become empty, until no step is left. Where that leaves more bins than their tokens need, best fit of falling lengths and the
search from there are tried as well, and the fewer bins kept. Underfull bins of different blocks meet in further rounds.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

NONE = 1 << 40
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
PACKED = PIECES + ", row long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole ones of the capacity after a shorter first one."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document. A null text counts as empty; a repeated row is packed again.

    with_ids: also the ids themselves, as little-endian unsigned 32-bit integers. Stretches of texts are shorter then and fewer parts
    are kept: the JVM beside the workers needs memory to write the ids.
    """
    cached, size = (100_000, 1_000_000) if with_ids else (300_000, 4_000_000)
    end = int(end_id).to_bytes(4, "little")

    schema = PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, found in tokens.encoder(tokenizer, cached).stretches(common.filled(batches), size):
            rows = []
            for doc, x in zip(own, found):
                ids = x + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own_ids = ids[4 * s : 4 * (s + n)]
                    rows.append((doc, k, s, n, zlib.crc32(own_ids), own_ids)[: len(kinds)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)

    return common.in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema, keeps=True)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit in the order given: bins as lists of indexes into lengths."""
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = defaultdict(list)  # by the room that is left
    rooms: list[int] = []  # sorted; those with an open bin
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            if not open_bins[room - n]:
                bisect.insort(rooms, room - n)
            open_bins[room - n].append(b)
    return bins


class Pool:
    """The bins that may give pieces up: by length the least filled of those that hold one.

    above[n] is that bin's fill less n, so a step that takes a piece of length n into a bin of fill f, which gives `given` for it, makes
    the squares larger if above[n] < f - given. Heaps keep entries of bins that have changed since, which go when they come up.
    """

    def __init__(self, capacity: int):
        self.above = np.full(capacity + 1, NONE)
        self.heaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        self.version: dict[int, int] = defaultdict(int)

    def put(self, b: int, fill: int, own: Iterable[int]) -> None:
        """Bin b, with pieces of the lengths own, may give."""
        for n in own:
            heapq.heappush(self.heaps[n], (fill, b, self.version[b]))
            if fill - n < self.above[n]:
                self.above[n] = fill - n

    def take(self, b: int, own: Iterable[int]) -> None:
        """Bin b may not give, or not as it was."""
        self.version[b] += 1
        for n in own:
            heap = self.heaps[n]
            while heap and heap[0][2] != self.version[heap[0][1]]:
                heapq.heappop(heap)
            self.above[n] = heap[0][0] - n if heap else NONE

    def best_step(self, own: Counter, fill: int, capacity: int) -> tuple[int, tuple[int, ...], int] | None:
        """(gain, lengths to give, length to take) of the step that fills most of a bin: a move, or one or two pieces for one."""
        best, room = None, capacity - fill
        gives = chain(((),), ((n,) for n in own), combinations(own, 2), ((n, n) for n, k in own.items() if k > 1))
        for out in gives:
            given = sum(out)
            if given >= fill:  # all that the bin has for a longer piece: no gain
                continue
            least = best[0] if best else 0
            found = (self.above[given + least + 1 : given + room + 1] < fill - given).nonzero()[0]
            if len(found):
                best = int(found[-1]) + least + 1, out, given + least + 1 + int(found[-1])
                if best[0] == room:
                    break
        return best


def swap_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull bins by moves and by exchanges of one or two pieces for one, until no step is left.

    A step takes a piece from the least filled bin that holds one of its length, if the sum of squared fills grows by it: so no state
    returns. Rounds go over the bins from the fullest, and end when a whole one finds no step, or when the bins are as few
    as can hold what is in them. Bins that lose their last piece are dropped.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    own = [defaultdict(list) for _ in bins]
    for b, content in enumerate(bins):
        for i in content:
            own[b][lengths[i]].append(i)
    pool, left, bound = Pool(capacity), sum(f > 0 for f in fill), -(-sum(fill) // capacity)
    under = [b for b in range(len(bins)) if 0 < fill[b] < capacity]
    for b in under:
        pool.put(b, fill[b], own[b])
    steps = 1
    while steps and left > bound:
        steps = 0
        under = sorted((b for b in under if 0 < fill[b] < capacity), key=lambda b: (-fill[b], b))
        for a in under:
            if not 0 < fill[a] < capacity:
                continue
            pool.take(a, own[a])
            while fill[a] < capacity and left > bound and (step := pool.best_step(Counter({n: len(x) for n, x in own[a].items()}), fill[a], capacity)):
                gain, out, n = step
                b = pool.heaps[n][0][1]
                pool.take(b, own[b])
                for length in out:
                    own[b][length].append(own[a][length].pop())
                own[a][n].append(own[b][n].pop())
                for c, gone in ((a, out), (b, (n,))):
                    for length in gone:
                        if length in own[c] and not own[c][length]:
                            del own[c][length]
                fill[a] += gain
                fill[b] -= gain
                steps += 1
                if fill[b]:
                    pool.put(b, fill[b], own[b])
                else:
                    left -= 1
            if fill[a] < capacity:
                pool.put(a, fill[a], own[a])
    return [sorted(i for x in content.values() for i in x) for content in own if content]


def fewest(lengths: list[int], capacity: int) -> list[list[int]]:
    """The fewest bins of the search from two starts: best fit in order of arrival and, if that leaves more than their sum needs, of falling length."""
    found = swap_search(best_fit(lengths, capacity), lengths, capacity)
    if len(found) > -(-sum(lengths) // capacity):
        order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        other = swap_search([[order[i] for i in b] for b in best_fit([lengths[i] for i in order], capacity)], lengths, capacity)
        found = min(found, other, key=len)
    return found


def chunks(bins: list[list[int]], block: int) -> Iterator[list[list[int]]]:
    """The bins in their order, as many at a time as hold at most `block` pieces (or one, if it holds more)."""
    part, size = [], 0
    for b in bins:
        if part and size + len(b) > block:
            yield part
            part, size = [], 0
        part.append(b)
        size += len(b)
    if part:
        yield part


def packed_blocks(rows: DataFrame, n_blocks: int, capacity: int, number: int, block: int) -> DataFrame:
    """rows (PACKED; sequence_id is null where a piece has no place yet) with _block, in new places, a block at a time, and at most `block` pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(common.filled(batches))
        if not got:
            return
        t = pa.Table.from_batches(got)
        for name in sorted(set(t.column("_block").to_pylist())):
            own = t.filter(pc.equal(t.column("_block"), name)).drop_columns(["_block", "offset"])
            own = own.take(pc.sort_indices(own, [("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")]))
            lengths, before = own.column("length").to_pylist(), own.column("sequence_id").to_pylist()
            of: dict[int, list[int]] = defaultdict(list)
            for i, k in enumerate(before):
                of[i if k is None else k].append(i)
            sequence, offset, k = [0] * len(lengths), [0] * len(lengths), 0
            for part in chunks(list(of.values()), block):
                at = [i for b in part for i in b]
                found = fewest([lengths[i] for i in at], capacity)
                if before[0] is not None:  # they have been packed as well as their old blocks could be
                    place = {i: x for x, i in enumerate(at)}
                    kept = swap_search([[place[i] for i in b] for b in part], [lengths[i] for i in at], capacity)
                    found = min(kept, found, key=len)
                for b in found:
                    room = 0
                    for x in b:
                        sequence[at[x]], offset[at[x]] = (number << 56) + (name << 28) + k, room
                        room += lengths[at[x]]
                    k += 1
            out = own.drop_columns(["sequence_id"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from out.combine_chunks().to_batches()

    return common.in_arrow(rows.repartition(n_blocks, "_block"), run, PACKED)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, block: int = 20_000, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with_ids its ids in binary. A
    null or empty text is its end id alone. Rows with the same or no doc_id are packed each for itself, and pieces of one length are
    exchanged as they come; an empty table gives no rows; other columns of docs are not read. The search shuffles lengths only, never ids.

    Bins that a round leaves underfull are dealt anew, whole, into blocks of about `block` pieces, as long as a round empties one bin
    in a thousand or more and there are more than can hold what is in them: never into one block that holds more.
    """
    cut_up = common.settle(pieces(docs, tokenizer or tokens.default_path(), capacity, end_id, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    none = F.lit(None).cast("long")
    lengths = cut_up.drop("ids")
    full = lengths.where(F.col("length") == capacity).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = lengths.where(F.col("length") < capacity).select("*", none.alias("sequence_id"), none.alias("offset"))
    dealt_by, number, done, entering = F.xxhash64("row"), 0, [full], None
    n_blocks = max(1, -(-rest.count() // block))
    while True:
        rest = rest.withColumn("_block", F.pmod(dealt_by, F.lit(n_blocks)))
        rest = common.settle(packed_blocks(rest, n_blocks, capacity, number, block), "packed")
        if n_blocks == 1:
            break
        bins = rest.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count("*").alias("n"))
        under = common.settle(bins.where(F.col("fill") < capacity), "underfull")
        left = bins.agg(F.count("*").alias("bins"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens")).first()
        sizes = under.agg(F.count("*").alias("bins"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces")).first()
        if left["bins"] == -(-left["tokens"] // capacity) or (entering is not None and 1000 * (entering - left["bins"]) < entering):
            break
        under = common.small(under.select("sequence_id"))
        done.append(rest.join(under, "sequence_id", "left_anti").select(*full.columns))
        rest = rest.join(under, "sequence_id", "left_semi").select(*full.columns)
        n_blocks, number, entering = max(1, -(-sizes["pieces"] // block)), number + 1, sizes["bins"]
        dealt_by = F.xxhash64(F.lit(number), "sequence_id")
    placed = reduce(DataFrame.unionByName, [*done, rest])
    if with_ids:
        placed = cut_up.join(common.small(placed.select("row", "sequence_id", "offset")), "row")
    return placed.select(*(x.split()[0] for x in PLACED.split(", ")), *(["ids"] if with_ids else []))
