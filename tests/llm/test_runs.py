"""Periodic runs against a version that tries every period at every place."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridrisk.llm import queries, runs


def plain_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_words(rnd):
    n, k = rnd.randint(0, 70), rnd.choice([1, 2, 3, 6])
    w = [f"w{rnd.randrange(k)}" for _ in range(n)]
    for _ in range(rnd.randint(0, 2)):
        if n:
            a, p = rnd.randrange(n), rnd.randint(1, max(1, n // 4))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_blocks_have_the_runs_of_each_text():
    rnd = random.Random(5)
    for _ in range(1500):
        texts = [odd_words(rnd) for _ in range(rnd.randint(1, 5))]
        ids = {}
        bounds = np.cumsum([0, *map(len, texts)])
        got = runs.periodic_runs(np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64), bounds).tolist()
        want = [[s + a, s + n + a, q] for t, a in zip(texts, bounds.tolist()) for s, n, q in plain_runs(t)]
        assert got == sorted(want, key=lambda x: (x[0], x[2])), texts


@pytest.mark.parametrize("least, times", [(2, 2), (6, 4), (10, 3)])
def test_other_limits(least, times):
    rnd = random.Random(7)
    for _ in range(300):
        t = odd_words(rnd)
        ids = {w: k for k, w in enumerate(dict.fromkeys(t))}
        got = runs.periodic_runs(np.array([ids[w] for w in t], np.int64), np.array([0, len(t)]), least, times).tolist()
        assert [(s, e - s, q) for s, e, q in got] == plain_runs(t, least, times), t


def test_suffix_array_and_shared_words():
    rnd = random.Random(3)
    for _ in range(200):
        t = [rnd.randrange(3) for _ in range(rnd.randint(1, 50))]
        array, ranks = runs.suffix_array(np.array(t, np.int64), np.full(len(t), len(t)))
        assert array.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        shared = runs.common_prefixes(array, ranks).tolist()
        for k in range(1, len(t)):
            a, b = t[array[k - 1] :], t[array[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_collapse(spark):
    texts = [None, "", " \n\t", "a", "a a a a a a", "a a a a a", "x a b a b a b a b y", "é é é é é é 😀", "one two " * 8, "\x1c \x1c \x1c \x1c \x1c \x1c", "p q r " * 4000 + "end", "x a b a b a b a b y"]
    rows = [(None if k == 3 else k, t, "clash", k) for k, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs string, other int").repartition(3)
    got = {r["other"]: r for r in runs.collapse(d, block_bytes=40).collect()}
    assert set(got) == set(range(len(texts)))
    for k, t in enumerate(texts):
        w = (t or "").encode().split()
        w = [x.decode() for x in w]
        want = plain_runs(w) if len(w) < 1000 else [(0, 12000, 3)]
        assert [tuple(r) for r in got[k]["runs"]] == want and got[k]["n_words"] == len(w) and got[k]["text"] == t
        assert got[k]["collapsed"] == plain_collapsed(w, want)
    assert runs.collapse(d.limit(0)).count() == 0


def test_query_on_empty_and_null_rows(spark, tmp_path):
    rows = [(None, "a " * 9), (1, None), (2, ""), (3, "b " * 9), (3, "b " * 9)]
    for name, given in (("some", rows), ("none", [])):
        spark.createDataFrame(given, "doc_id long, text string").withColumn("h", F.lit("own")).write.parquet(str(tmp_path / name / "documents.parquet"))
        got = queries.op13_periodic_runs(spark, str(tmp_path / name)).collect()
        assert len(got) == len(given)
    got = queries.op13_periodic_runs(spark, str(tmp_path / "some")).where("doc_id is null").first()
    assert (got["n_runs"], got["start"], got["length"], got["period"], got["exponent_milli"]) == (1, 0, 9, 1, 9000)
