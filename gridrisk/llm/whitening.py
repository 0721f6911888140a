"""PCA whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V is never formed: a block Q of `width` directions is multiplied by it in passes over all vectors, each task adding up
(x - mean) times ((x - mean) Q) of its rows, and Spark adding up the tasks' sums by dimension. A filter of degree m is m such passes in the
Chebyshev recurrence on [0, the least Ritz value of the block], which damps all eigenvectors with eigenvalues there. QR and
Rayleigh-Ritz follow, until the residuals |V q - e q| of all wanted components certify them: an eigenvalue is within its residual of e,
and the sine of the angle to its eigenvector is at most the residual over the gap to the next eigenvalue.
What reaches the driver are `width` numbers a dimension, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The largest size of an entry; what is beyond counts as that, so that sums stay exact.
LARGEST = float(1 << 20)


@dataclass(frozen=True)
class Whitening:
    """n vectors with sums by dimension; components by falling eigenvalue: values, vectors (in columns), residuals; trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x: floor(1024 c) + 100,000 of each entry c, of the vectors that are whole, written to the shared folder.

    Vectors that are null or hold a null, NaN or infinite entry go, and so do those of another length than most have (the
    longer, if two lengths are as frequent). Repeated rows stay; entries beyond LARGEST count as that.
    """
    c = F.col(vector).cast("array<double>")
    whole = embeddings.where(F.col(vector).isNotNull() & F.forall(c, lambda e: e.isNotNull() & (F.abs(e) < float("inf"))))
    x = F.transform(c, lambda e: (F.floor(1024 * F.least(F.greatest(e, F.lit(-LARGEST)), F.lit(LARGEST))) + 100_000).cast("long"))
    x = common.settle(whole.select("vec_id", x.alias("x")), "vectors")
    common_length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.where(F.size("x") == (common_length["d"] if common_length else 0))


def blocks(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def added_up(x: DataFrame, d: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """of(rows of x), a matrix of `width` columns, added up over all rows: by numpy in a task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, rows in blocks(batches, 0, d):
            part = of(rows)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *[pa.array(v) for v in np.ascontiguousarray(total.T)]], names=["j", *names])

    names = [f"v{k}" for k in range(width)]
    kind = "bigint" if of(np.zeros((0, d), np.int64)).dtype == np.int64 else "double"
    sums = x.select("x").mapInArrow(run, ", ".join(["j int", *[f"{c} {kind}" for c in names]])).groupBy("j").agg(*[F.sum(c).alias(c) for c in names])
    found = sorted(sums.collect())
    return np.array([r[1:] for r in found], np.int64 if kind == "bigint" else float).reshape(-1, width)


def degree(top: float, cut: float, most: int = 12, growth: float = 1e8) -> int:
    """The filter's degree: at most `most`, and so that the first component doesn't outgrow the block's last by more than `growth`."""
    return max(2, min(most, int(math.acosh(growth) / math.acosh(max(2 * top / cut - 1, 1 + 1e-12)))))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, top: float, cut: float, m: int) -> np.ndarray:
    """The Chebyshev polynomial of degree m on [0, cut], scaled to 1 at top, of V times q; vq is V q."""
    half = cut / 2
    first = sigma = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(m - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * following / half) - sigma * following * before
        sigma = following
    return now


def fit(x: DataFrame, components: int = 8, width: int = 24, tolerance: float = 1e-13, cycles: int = 300) -> Whitening:
    """The whitening of all vectors of integers(): as many components as asked for, or as V has beyond rounding.

    Ends when no residual is above `tolerance` times the first eigenvalue, or when residuals below 1,000 times that get no smaller, as
    rounding leaves them. Raises ArithmeticError if that doesn't come within `cycles` filters. No vectors: no components.
    """
    head = x.select(F.size("x").alias("d")).first()
    d = head["d"] if head else 0
    if not d:
        return Whitening(0 if head is None else x.count(), (), np.empty(0), np.empty((0, 0)), np.empty(0), 0.0, 0)
    first = added_up(x, d, 2, lambda rows: np.stack([rows.sum(0), np.full(d, len(rows))], 1))
    n, sums = int(first[0, 1]), tuple(int(s) for s in first[:, 0])
    mean = np.array([s / n for s in sums])
    trace = float(added_up(x, d, 1, lambda rows: ((rows - mean) ** 2).sum(0)[:, None]).sum()) / n
    passes, p = 2, min(d, max(width, components))

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def of(rows: np.ndarray) -> np.ndarray:
            y = rows - mean
            return y.T @ (y @ q)

        return added_up(x, d, q.shape[1], of) / n

    q, _ = np.linalg.qr(np.random.default_rng(0).standard_normal((d, p)))
    last = math.inf
    for _ in range(cycles):
        vq = times(q)
        values, turn = np.linalg.eigh((h := q.T @ vq) / 2 + h.T / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)
        kept = int((values[:components] > 1e-12 * max(values[0], 0)).sum())
        worst = residuals[:kept].max(initial=0.0) / max(values[0], 1e-300)
        if p == d or worst <= tolerance or values[-1] <= 1e-15 * values[0] or (worst <= 1000 * tolerance and worst > last / 2):
            return Whitening(n, sums, values[:kept], q[:, :kept], residuals[:kept], trace, passes)
        last = worst
        q, _ = np.linalg.qr(filtered(times, q, vq, values[0], values[-1], degree(values[0], values[-1])))
    raise ArithmeticError(f"not certified after {cycles} filters: residual {worst:.3g} of the first eigenvalue")


def transform(x: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, deviation (the sum over dimensions of (n x - S)^2, exact; null beyond a long) and whitened, a number for each component."""
    n, d, sums, mean = w.n, len(w.sums), np.array(w.sums, np.int64), w.mean if w.n else np.empty(0)
    scaled = w.vectors / np.sqrt(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in blocks(batches, 1, d):
            if n * int(np.abs(rows).max()) < 1 << 61 and int(np.abs(off := n * rows - sums).max()) ** 2 * d < 1 << 62:
                deviation = pa.array((off * off).sum(1))
            else:
                exact = [sum((n * v - s) ** 2 for v, s in zip(r, w.sums)) for r in rows.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            white = (rows - mean) @ scaled
            offsets = pa.array(np.arange(len(rows) + 1) * scaled.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(white.ravel()))], names=["vec_id", "deviation", "whitened"])

    schema = f"vec_id {x.schema['vec_id'].dataType.simpleString()}, deviation bigint, whitened array<double>"
    return x.select("vec_id", "x").where(F.lit(d > 0)).mapInArrow(run, schema)


def identity_error(x: DataFrame, w: Whitening) -> float:
    """The largest entry, without its sign, of the whitened vectors' covariance less the identity; 0 without components."""
    k, d, mean = len(w.values), len(w.sums), w.mean if w.n else None
    if not k:
        return 0.0
    scaled = w.vectors / np.sqrt(w.values)

    def of(rows: np.ndarray) -> np.ndarray:
        white = (rows - mean) @ scaled
        return white.T @ white

    return float(np.abs(added_up(x, d, k, of) / w.n - np.eye(k)).max())
