"""Quantiles of mixtures of Poisson distributions: the least count at which the mean of their distribution functions reaches a level.

The count is found by halving, so the distribution functions are asked for at some log2(rate) counts, not at each. Each is a sum from the
count's own mass away from the rate: its terms fall from the first on, and after some 9 sqrt(rate) of them the rest is lost in rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rates that are looked at together, and what is less than the rounding of a sum near 1, were it repeated for all terms.
BLOCK, NOTHING = 1 << 15, 1e-24


def _log_mass(c: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Logs of the Poisson masses at c, by row. Stirling's formula without the large numbers that would cancel; what it lacks is added."""
    some = np.maximum(c, 1.0)
    lacks = [math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) if x < 100 else (1 / 12 - (1 / 360 - 1 / 1260 / x**2) / x**2) / x for x in some.tolist()]
    off = (rates - some[:, None]) / some[:, None]
    with np.errstate(divide="ignore"):  # a rate of 0
        logs = some[:, None] * (np.log1p(off) - off) - (0.5 * np.log(2 * math.pi * some) + lacks)[:, None]
    return np.where(c[:, None] > 0, logs, -rates)


def _summed(term: np.ndarray, ratio: Callable[[int], np.ndarray]) -> np.ndarray:
    """term + term x ratio(0) + term x ratio(0) x ratio(1) and so on, as long as a term counts."""
    total, term, i = term.copy(), term.copy(), 0
    while len(term) and term.max() > NOTHING:
        term *= ratio(i)
        total += term
        i += 1
    return total


def distribution(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """The Poisson distribution functions of rates (row, member) at the row's count, 0 or more."""
    c = counts.astype(float)
    mass = np.exp(_log_mass(c, rates))
    c = np.broadcast_to(c[:, None], rates.shape)
    over = rates > c
    out = np.where(over, 0.0, 1.0)
    down, up = over & (mass > NOTHING), ~over & (mass > NOTHING)
    n, r = c[down], rates[down]
    out[down] = _summed(mass[down], lambda i: (n - i) / r)
    m, s = c[up] + 1, rates[up]
    out[up] -= _summed(mass[up] * s / m, lambda i: s / (m + 1 + i))
    return out


def least(rates: np.ndarray, level: float) -> np.ndarray:
    """The least count of each row at which the mean over its members reaches the level, which is below 1 - 1e-12.

    It lies within max + 10 sqrt(max) + 15 of the row's largest rate, whose own distribution function is past that there.
    """
    top = rates.max(axis=1)
    low, high = np.full(len(rates), -1), np.ceil(top + 10 * np.sqrt(top) + 15).astype(np.int64)
    while len(wide := np.flatnonzero(high - low > 1)):
        middle = (low[wide] + high[wide]) // 2
        reached = distribution(middle, rates[wide]).mean(axis=1) >= level
        high[wide[reached]], low[wide[~reached]] = middle[reached], middle[~reached]
    return high


def poisson(rows: DataFrame, level: float, name: str) -> DataFrame:
    """target, entity and the quantile of rows target, entity, mu and xs, the members' factors, of which all rows have as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mu, xs = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
                step = max(1, BLOCK // xs.shape[1])
                found = [least(mu[a : a + step, None] * xs[a : a + step], level) for a in range(0, len(mu), step)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(found))], names=["target", "entity", name])

    return rows.select("target", "entity", "mu", "xs").mapInArrow(run, f"target int, entity string, {name} bigint")
