"""Strict parsing, rounding, severity and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What each severity code weighs, in tenths.
WEIGHT_TENTHS = {"1": 10, "2": 4, "3": 1}
EPSILON = 1e-12


def strict_double(text: Column) -> Column:
    """A number without spaces, suffix, NaN or infinity; null for anything else."""
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


def weight_tenths(code: Column) -> Column:
    out = F.lit(0)
    for c, w in WEIGHT_TENTHS.items():
        out = F.when(code == c, w).otherwise(out)
    return out.cast("long")


def is_serious(code: Column) -> Column:
    return F.coalesce(code.isin("1", "2"), F.lit(False))


def half_up_count(value: Column) -> Column:
    return (value + 0.5).cast("long")


def round_half_up(value: Column, places: int) -> Column:
    """value + half a unit, cut off: half up for values of 0 and more."""
    return (value * 10**places + 0.5).cast("long") / float(10**places)


def brier(p: Column, occurred: Column) -> Column:
    return F.pow(p - occurred.cast("double"), F.lit(2.0))


def log_loss(p: Column, occurred: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return -F.log(F.when(occurred, q).otherwise(1 - q))


def poisson_deviance(mu: Column, y: Column) -> Column:
    m = F.when(mu > 0, mu).otherwise(F.lit(EPSILON))
    return 2 * (F.when(y > 0, y * F.log(y / m)).otherwise(F.lit(0.0)) - (y - m))


def probability_bin(p: Column, bins: int = 10) -> Column:
    return F.greatest(F.least((p * bins).cast("int"), F.lit(bins - 1)), F.lit(0))


def occurrence(rate: Column) -> Column:
    """The probability of one incident or more at a Poisson rate."""
    return 1 - F.exp(-rate)


def skill_percent(naive: Column, model: Column) -> Column:
    return 100 * F.try_divide(naive - model, naive)
