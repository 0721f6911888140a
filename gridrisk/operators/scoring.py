"""Scores of forecasts: means of proper scores, reliability, and totals against their ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from .model import order_statistic


def means(scored: DataFrame, group: list[str]) -> DataFrame:
    """brier, log_loss, deviance and n by group, over rows with p, mu and y."""
    hit = F.col("y") > 0
    scores = {"brier": numbers.brier(F.col("p"), hit), "log_loss": numbers.log_loss(F.col("p"), hit), "deviance": numbers.poisson_deviance(F.col("mu"), F.col("y"))}
    return scored.groupBy(*group).agg(*[F.avg(c).alias(name) for name, c in scores.items()], F.count("*").alias("n"))


def reliability(scored: DataFrame, group: list[str], bins: int = 10) -> DataFrame:
    """group, bin, mean_p, frequency and n of the bins that have rows."""
    b = numbers.probability_bin(F.col("p"), bins if bins > 0 else 10)
    return scored.groupBy(*group, b.alias("bin")).agg(F.avg("p").alias("mean_p"), F.avg((F.col("y") > 0).cast("double")).alias("frequency"), F.count("*").alias("n"))


def calibration_error(curve: DataFrame, group: list[str]) -> DataFrame:
    """The mean distance of mean_p and frequency, weighted by n."""
    return curve.groupBy(*group).agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("frequency"))), F.sum("n")), F.lit(0.0)).alias("calibration_error"))


def crps(drawn_totals: DataFrame, realised: DataFrame) -> DataFrame:
    """target, crps of the ensemble of totals against y: mean distance less half the mean spread, with the biased 1/n**2."""
    w = Window.partitionBy("target")
    t = drawn_totals.join(F.broadcast(realised), "target").select("target", "total", "y", (F.row_number().over(w.orderBy("total", "member")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return t.groupBy("target").agg((F.avg(F.abs(F.col("total") - F.col("y"))) - F.sum((2 * F.col("i") - F.col("n") + 1) * F.col("total")) / F.max(F.col("n") * F.col("n"))).alias("crps"))


def coverage(drawn_totals: DataFrame, realised: DataFrame) -> DataFrame:
    """target, low, high and whether y is within them: the 5 % and 95 % places of the ensemble of totals."""
    e = drawn_totals.groupBy("target").agg(F.collect_list("total").alias("t")).join(F.broadcast(realised), "target")
    low, high = order_statistic("t", 0.05), order_statistic("t", 0.95)
    return e.select("target", "y", low.alias("low"), high.alias("high"), F.col("y").between(low, high).alias("covered"))
