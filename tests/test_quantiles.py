"""Quantiles of mixtures of Poisson distributions."""

import math
import time

import numpy as np
import pytest

from gridrisk.config import ModelConfig
from gridrisk.operators import model
from gridrisk.plans import backtest, queries


def plain(rates, level=0.95):
    """The least count at which masses, summed one by one from where they are nothing, reach the level."""
    below = max(0, math.floor(min(rates) - 12 * math.sqrt(min(rates)) - 20))
    cdf, c = 0.0, below
    while True:
        cdf += sum(math.exp(c * math.log(r) - r - math.lgamma(c + 1)) if r else float(c == 0) for r in rates) / len(rates)
        if cdf >= level:
            return c
        c += 1


def test_many_draws_of_large_rates_end(spark):
    """400 draws at a rate of a million: sums from 0 took minutes."""
    config, bases = ModelConfig(n=400), {"few": 0.4, "some": 12_000.0, "most": 1_000_000.0}
    moves = [0.001 * (m % 5) for m in range(400)]
    fitted = {
        "seasons": spark.createDataFrame([(24_000, m, 1.0) for m in range(1, 13)], "target int, moy int, s double"),
        "based": spark.createDataFrame([(24_000, e, b) for e, b in bases.items()], "target int, entity string, base double"),
        "drawn": spark.createDataFrame([(24_000, m, f) for m, f in enumerate(moves, 1)], "target int, member int, f double"),
    }
    start = time.monotonic()
    got = {r["entity"]: r["p95"] for r in model.p95_analytic(fitted, config).collect()}
    took = time.monotonic() - start
    assert got == {e: plain([b * math.exp(f) for f in moves[:5]]) for e, b in bases.items()} and took < 60


@pytest.mark.parametrize("level", [0.05, 0.5, 0.95, 0.999])
def test_least_count_equals_plain_sums(level):
    from gridrisk.operators import quantiles

    rows = [[0.0, 0.0, 0.0], [0.0, 3.0, 70.0], [1e-9, 0.2, 1e-300], [0.05, 0.05, 0.06], [4.5, 99.0, 101.0], [900.0, 20.0, 5_000.0], [40_000.0, 40_100.0, 41_000.0]]
    assert quantiles.least(np.array(rows), level).tolist() == [plain(r, level) for r in rows]


def test_terms_grow_with_the_root_of_the_rate(monkeypatch):
    from gridrisk.operators import quantiles

    seen, real = [], quantiles._summed
    monkeypatch.setattr(quantiles, "_summed", lambda term, ratio: real(term, lambda i: seen.append(i) or ratio(i)))
    used = []
    for rate in (1e4, 1e6):
        seen.clear()
        quantiles.least(np.full((1, 2), rate), 0.95)
        used.append(len(seen))
    assert used[1] < 20 * used[0] and used[1] < 500_000


def test_no_rows_and_rows_of_several_batches(spark):
    from gridrisk.operators import quantiles

    none = spark.createDataFrame([], "target int, entity string, mu double, xs array<double>")
    assert quantiles.poisson(none, 0.95, "p95").collect() == []
    rows = spark.createDataFrame([(1, f"e{k}", float(k), [0.5, 1.0, 2.0]) for k in range(200)], "target int, entity string, mu double, xs array<double>").repartition(3)
    got = {r["entity"]: r["p95"] for r in quantiles.poisson(rows, 0.95, "p95").collect()}
    assert got == {f"e{k}": plain([0.5 * k, 1.0 * k, 2.0 * k]) for k in range(200)}


def test_incidents_are_counted_in_one_scan(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(backtest, "fit", lambda panel, *_: seen.append(panel))
    monkeypatch.setattr(model, "p95_analytic", lambda *_: None)
    queries.QUERIES["p95_analytic_whole"](spark, "/root/testdata/sf0.001")
    assert not [f for f in seen[0].inputFiles() if "orders.parquet" in f]  # its entities, months and counts each scanned the orders
