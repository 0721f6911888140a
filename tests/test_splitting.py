"""Totals split down a tree of entities by keyed binomials."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.operators import splitting


def totals(spark, counts):
    return spark.createDataFrame([(t, list(c)) for t, c in counts.items()], "target int, counts array<long>")


def rates(spark, by_target):
    return spark.createDataFrame([(t, e, float(m)) for t, r in by_target.items() for e, m in r.items()], "target int, entity string, mu double").repartition(5)


def test_counts_add_up_and_follow_the_rates(spark):
    r = {e: (k % 7) / 3 for k, e in enumerate(f"{i}_{j}" for i in range(15) for j in range(10))}
    whole = np.random.default_rng(0).poisson(sum(r.values()), 600)
    got = {x["entity"]: np.array(x["counts"]) for x in splitting.split(rates(spark, {7: r}), totals(spark, {7: whole.tolist()}), 1, len(r)).collect()}
    assert set(got) == set(r) and (sum(got.values()) == whole).all()
    for rate in set(r.values()):
        c = np.concatenate([got[e] for e in r if r[e] == rate])
        assert c.mean() == pytest.approx(rate, abs=4 * math.sqrt(rate / len(c)) + 1e-12) and c.var() == pytest.approx(rate, rel=0.1)
    some = np.array([got[e] for e in sorted(r) if r[e] > 0])
    assert np.abs(np.corrcoef(some) - np.eye(len(some))).mean() < 0.05


def test_steps_do_not_change_the_draws(spark):
    r = {1: {f"e{k}": k % 5 + 0.5 for k in range(300)}, 2: {f"e{k}": k % 3 for k in range(0, 300, 7)}}
    t = totals(spark, {1: [700, 0, 3, 20_000], 2: [1, 2, 3, 90]})
    found = [sorted(map(tuple, splitting.split(rates(spark, r), t, 3, n).select("target", "entity", F.col("counts").cast("string")).collect())) for n in (1, 2_000, 300_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 343
    plan = splitting.split(rates(spark, r), t, 3, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")  # nothing is shuffled after the draws


def test_odd_rates(spark):
    r = {1: {"a": 0.0, "b": 2.0, "c": 0.0}, 2: {"a": 0.0}, 3: {"only": 1.0}, 4: {"a": 1.0}}
    got = {(x["target"], x["entity"]): x["counts"] for x in splitting.split(rates(spark, r), totals(spark, {1: [5, 0], 2: [0, 0], 3: [4, 9], 5: [1, 1]}), 1, 3).collect()}
    assert got == {(1, "a"): [0, 0], (1, "b"): [5, 0], (1, "c"): [0, 0], (2, "a"): [0, 0], (3, "only"): [4, 9]}
    assert splitting.split(rates(spark, r).limit(0), totals(spark, {1: [5]}), 1, 0).count() == 0


def test_equal_places_are_split_off_one_by_one():
    out = splitting.split_node(1, 2, 0, np.array([5, 9, 9, 9, 2**52 - 1]), np.array([1.0, 2.0, 3.0, 4.0, 0.0]), np.full(4000, 10))
    assert (out.sum(0) == 10).all() and np.allclose(out.mean(1), [1, 2, 3, 4, 0], atol=0.12)


@pytest.mark.parametrize("n, p", [(1, 0.3), (8, 0.5), (40, 0.02), (40, 0.97), (500, 0.001), (100, 0.4), (3000, 0.4)])
def test_binomial(n, p):
    u, v = splitting.uniforms(f"{n}|{p}|", np.arange(20_000))
    got = splitting.binomial(np.full(20_000, n), p, u, v)
    assert got.min() >= 0 and got.max() <= n
    assert got.mean() == pytest.approx(n * p, abs=4 * math.sqrt(n * p * (1 - p) / 20_000)) and got.var() == pytest.approx(n * p * (1 - p), rel=0.05)
    if n * p * (1 - p) <= 30:
        cdf = np.cumsum([math.comb(n, c) * p**c * (1 - p) ** (n - c) for c in range(n + 1)])
        seen = np.array([(got <= c).mean() for c in range(n + 1)])
        assert np.abs(cdf - seen).max() < 0.015
    assert abs(np.corrcoef(u, v)[0, 1]) < 0.03 and abs(u.mean() - 0.5) < 0.01
