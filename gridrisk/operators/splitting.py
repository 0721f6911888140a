"""Coherent ensembles: each member's total is split down a tree of entities by keyed binomials.

Given the member's factor the entities' counts are independent Poisson counts, so given their total they are multinomial, and a split
of a node's count between its two halves is binomial. Entities and totals agree by construction, and each entity's count
has the Poisson distribution of its own rate.

The tree is the binary trie of 52 bits of the MD5 of the entities' names, so that it doesn't depend on partitions or on how many
entities there are. It is walked STEP bits at a time: a row holds a node, its count by member and the rates of what is below it, and
gives a row for each child. What is shuffled of the counts are those of inner nodes, one for some 256 entities; the entities' own counts
stay where they were drawn. Draws hash their key (seed, target, node, member) alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, STEP, GROUP = 52, 8, 256
#: Up to this variance a binomial is drawn exactly, beyond it as a rounded normal, as Poisson counts are.
EXACT = 30.0
#: Halves of equal rates are told apart by rounding; within this much of one half the first is drawn.
TIE = 1e-9


def place(entity: Column) -> Column:
    """52 bits of the entity's MD5."""
    return F.conv(F.substring(F.md5(entity), 1, 13), 16, 10).cast("long")


def uniforms(key: str, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniforms on (0, 1) for each member, of the two leading 52 bits of the MD5 of the key and the member."""
    start, digests = hashlib.md5(key.encode()), []
    for m in members.tolist():
        h = start.copy()
        h.update(b"%d" % m)
        digests.append(h.digest())
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    first = np.ascontiguousarray(raw[:, :8]).view(">u8")[:, 0] >> np.uint64(12)
    second = (np.ascontiguousarray(raw[:, 6:14]).view(">u8")[:, 0] >> np.uint64(8)) & np.uint64((1 << BITS) - 1)
    return (first.astype(float) + 0.5) / 2.0**BITS, (second.astype(float) + 0.5) / 2.0**BITS


def binomial(n: np.ndarray, p: float, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial counts of n trials at p: the inverse distribution function at u, or beyond EXACT the rounded normal of u and v."""
    q = p if p <= 0.5 + TIE else 1 - p
    spread = n * q * (1 - q)
    out = np.zeros(len(n), np.int64)
    wide = spread > EXACT
    if wide.any():
        z = np.sqrt(-2 * np.log(u[wide])) * np.cos(2 * math.pi * v[wide])
        out[wide] = np.clip(np.trunc(n[wide] * q + np.sqrt(spread[wide]) * z + 0.5), 0, n[wide])
    left = np.flatnonzero(~wide)
    mass = np.exp(n[left] * np.log1p(-q))
    below, c, odds = mass.copy(), 0, q / (1 - q)
    while len(left):
        on = (u[left] > below) & (c < n[left])
        left, mass, below = left[on], mass[on], below[on]
        mass *= (n[left] - c) / (c + 1) * odds
        below += mass
        out[left] += 1
        c += 1
    return out if p <= 0.5 + TIE else n - out


def split_node(seed: int, target: int, level: int, places: np.ndarray, rates: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts, by leaf and member, of the leaves below a node that `level` bits lead to. places are sorted; equal ones are split off one by one."""
    out = np.zeros((len(places), len(counts)), np.int64)
    todo = [(0, len(places), level, counts)]
    while todo:
        a, b, level, n = todo.pop()
        if b - a == 1:
            out[a] = n
            continue
        drawn = np.flatnonzero(n)
        if not len(drawn):
            continue
        if level < BITS:
            middle = a + int(np.searchsorted(places[a:b], ((int(places[a]) >> (BITS - level) << 1) + 1) << (BITS - level - 1)))
        else:
            middle = a + 1
        if a < middle < b:
            whole, part = rates[a:b].sum(), rates[a:middle].sum()
            first = np.zeros_like(n)
            if whole > 0:
                node = int(places[a]) >> max(0, BITS - level)
                first[drawn] = binomial(n[drawn], part / whole, *uniforms(f"{seed}|{target}|{level}|{node}|", drawn + 1))
            todo += [(a, middle, level + 1, first), (middle, b, level + 1, n - first)]
        else:
            todo.append((a, b, level + 1, n))
    return out


def split(rates: DataFrame, totals: DataFrame, seed: int, entities: int) -> DataFrame:
    """target, entity and counts (by member) of rates (target, entity, mu), which add up to totals (target, counts) member by member.

    Where both have a study (a text), it is a key as well; all studies have the same draws at a node. entities: about how many there
    are, which decides in how many steps the tree is walked, not what is drawn. A target without totals has no rows;
    entities of rate 0 have counts of 0.
    """
    by = [*(["study"] if "study" in rates.columns else []), "target"]
    leaves = rates.select(*by, place(F.col("entity")).alias("place"), "entity", "mu")
    parents, at = totals.select(*by, F.lit(0).cast("long").alias("node"), "counts"), 0
    deep = math.ceil(math.log2(max(1, entities / GROUP)))
    schema = f"{'study string, ' if len(by) > 1 else ''}target int, place bigint, entity string, counts array<bigint>"
    for to in [*range(STEP, deep, STEP), *([deep] if deep else []), BITS]:
        if to < BITS:
            below = leaves.groupBy(*by, F.shiftright("place", BITS - to).alias("node")).agg(F.sum("mu").alias("mu"))
            below = below.select(*by, F.shiftleft("node", BITS - to).alias("place"), F.lit("").alias("entity"), "mu")
        else:
            below = leaves
        groups = below.groupBy(*by, (F.shiftright("place", BITS - at) if at else F.lit(0).cast("long")).alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "entity", "mu"))).alias("below"))
        found = groups.join(parents, [*by, "node"]).select(*by, "below", "counts").mapInArrow(_splitter(seed, at, len(by)), schema)
        parents, at = found.select(*by, F.shiftright("place", BITS - to).alias("node"), "counts"), to
    return found.select(*by, "entity", "counts")


def _splitter(seed: int, level: int, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                below = batch.column(keys)[k].values
                places, rates = (below.field(f).to_numpy(zero_copy_only=False) for f in ("place", "mu"))
                counts = split_node(seed, batch.column(keys - 1)[k].as_py(), level, places, rates, batch.column(keys + 1)[k].values.to_numpy())
                offsets = pa.array(np.arange(len(places) + 1) * counts.shape[1], pa.int32())
                own = [pa.repeat(batch.column(c)[k], len(places)) for c in range(keys)]
                listed = pa.ListArray.from_arrays(offsets, pa.array(counts.ravel()))
                yield pa.RecordBatch.from_arrays([*own, pa.array(places), below.field("entity"), listed], names=[*batch.schema.names[:keys], "place", "entity", "counts"])

    return run
