"""The search of packing: no step is left, bins are few, and blocks are bounded."""

import random
from collections import Counter
from itertools import combinations

import pytest

from gridrisk.llm import packing


def steps_left(bins, lengths, capacity):
    """Whether a move or an exchange of one or two pieces for one between underfull bins raises the sum of squared fills."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    under = [b for b in range(len(bins)) if fill[b] < capacity]
    for a in under:
        for b in under:
            for i in bins[b] if a != b else ():
                for out in [(), *((x,) for x in bins[a]), *combinations(bins[a], 2)]:
                    gain = lengths[i] - sum(lengths[x] for x in out)
                    if 0 < gain <= capacity - fill[a] and (fill[a] + gain) ** 2 + (fill[b] - gain) ** 2 > fill[a] ** 2 + fill[b] ** 2:
                        return True
    return False


@pytest.mark.parametrize("start", ["arrival", "one each"])
def test_no_step_is_left(start):
    rnd = random.Random(start)
    for _ in range(250):
        capacity = rnd.choice([10, 20, 50])
        lengths = [rnd.randint(1, capacity - 1) for _ in range(rnd.randint(0, 40))]
        bins = packing.best_fit(lengths, capacity) if start == "arrival" else [[i] for i in range(len(lengths))]
        found = packing.swap_search(bins, lengths, capacity)
        assert sorted(i for b in found for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= capacity for b in found)
        assert len(found) == -(-sum(lengths) // capacity) or not steps_left(found, lengths, capacity)


def test_not_more_bins_than_sorted_best_fit():
    rnd = random.Random(8)
    for _ in range(250):
        capacity = rnd.choice([12, 40, 100])
        lengths = [rnd.randint(1, capacity - 1) for _ in range(rnd.randint(0, 60))]
        assert len(packing.fewest(lengths, capacity)) <= len(packing.best_fit(sorted(lengths, reverse=True), capacity))


def test_chunks_hold_at_most_a_block():
    bins = [[0] * k for k in (3, 3, 5, 1, 9, 2, 2, 2)]
    parts = list(packing.chunks(bins, 6))
    assert [sum(map(len, p)) for p in parts] == [6, 6, 9, 6] and sum(parts, []) == bins and list(packing.chunks([], 6)) == []


def ends(spark, monkeypatch, sizes, capacity, block):
    """The packing of pieces of given lengths, and how many blocks each round had."""
    rows = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in enumerate(sizes)], packing.PIECES)
    blocks, real = [], packing.packed_blocks
    monkeypatch.setattr(packing, "pieces", lambda *a, **k: rows)
    monkeypatch.setattr(packing, "packed_blocks", lambda rows, n, *a: blocks.append((n, rows.count())) or real(rows, n, *a))
    got = packing.pack(spark.createDataFrame([], "doc_id long, text string"), capacity=capacity, block=block).collect()
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert len(got) == len(sizes) and max(fill.values()) <= capacity
    return fill, blocks


def test_pieces_that_fit_with_none_do_not_meet_in_one_task(spark, monkeypatch):
    fill, blocks = ends(spark, monkeypatch, [5] * 3000, 8, 100)
    assert len(fill) == 3000 and len(blocks) <= 2 and all(n * 100 >= rows for n, rows in blocks)


def test_rounds_bring_the_bins_of_blocks_together(spark, monkeypatch):
    rnd = random.Random(4)
    sizes = [rnd.randint(1, 60) for _ in range(900)]
    fill, blocks = ends(spark, monkeypatch, sizes, 64, 90)
    assert len(fill) <= 1.03 * len(packing.fewest(sizes, 64)) and len(blocks) > 1
