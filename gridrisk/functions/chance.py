"""Random numbers that depend on their key alone, so that no partitioning or retry changes a draw."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """Uniform on (0, 1) from 52 bits of the key's MD5; other engines can repeat it."""
    digest = F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(u: Column, v: Column) -> Column:
    """Standard normal from two uniforms, by Box and Muller."""
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def poisson(rate: Column, u: Column, z: Column) -> Column:
    """A Poisson count: the inverse distribution function at u up to a rate of 30, beyond it the rounded normal at z.

    The sum runs to rate + 10 sqrt(rate) + 15, past which the rest is below what a uniform can hit.
    """
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).cast("long").alias("n"))
    step = lambda s, c: F.struct((s["p"] * rate / c).alias("p"), (s["cdf"] + s["p"] * rate / c).alias("cdf"), (s["n"] + (u > s["cdf"]).cast("long")).alias("n"))
    small = F.aggregate(F.sequence(F.lit(1), (rate + 10 * F.sqrt(rate) + 15).cast("int")), start, step, lambda s: s["n"])
    large = F.greatest(F.lit(0), (rate + F.sqrt(rate) * z + 0.5).cast("long"))
    return F.when(rate <= 0, F.lit(0).cast("long")).when(rate > 30, large).otherwise(small)
