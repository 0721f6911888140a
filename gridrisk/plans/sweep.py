"""Comparison of grouping units: cells of several sizes and districts, by the model's skill over the pooled rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions import numbers
from ..operators import model, panel as panels, scoring
from ..sources.work import staged
from . import backtest

UNITS: dict[str, float] = {"0.5 km": 500.0, "1 km": 1000.0, "2 km": 2000.0, "3 km": 3000.0, "4 km": 4000.0, "district": 0.0}


def studies(incidents: DataFrame, units: dict[str, float]) -> DataFrame:
    """study (a struct of tier and unit), entity, k and y: the dense panels of all tiers and units, one under the other.

    Incidents are scanned once and counted by grouping sets of (unit, month). A tier's panel takes both its axes from the tier's own records.
    """
    columns = {f"u{n}": panels.by_cell(side) if side else panels.by_district() for n, side in enumerate(units.values())}
    placed = incidents.select("k", "ksi", *[c.alias(name) for name, c in columns.items()])
    sets = [[F.col(name), F.col("k")] for name in columns]
    counted = placed.groupingSets(sets, *columns, "k").agg(F.count("*").alias("accidents"), F.count_if("ksi").alias("ksi"), *[F.grouping(name).alias(f"not_{name}") for name in columns])
    unit = F.coalesce(*[F.when(F.col(f"not_{u}") == 0, F.lit(name)) for u, name in zip(columns, units)])
    counted = counted.select(unit.alias("unit"), F.coalesce(*columns).alias("entity"), "k", "accidents", "ksi").where("entity != ''")
    tiers = counted.unpivot(["unit", "entity", "k"], ["accidents", "ksi"], "tier", "y").where("y > 0")
    return panels.densify(staged(tiers.select(F.struct("tier", "unit").alias("study"), "entity", "k", "y"), "counts"))


def skill(incidents: DataFrame, units: dict[str, float] | None = None, config: ModelConfig = ModelConfig(), min_history: int = 24) -> DataFrame:
    """tier, unit, n_units, deviance of the model and the pooled rate, both skills in percent, and the model's calibration error.

    All configurations are fitted together: the study is a key of each stage, as the target is.
    """
    fitted = backtest.fit(studies(incidents, units or UNITS), config, min_history, dense=True)
    s = summary(backtest.scored(fitted, config, ("poisson-factor", "naive")))
    n = fitted["based"].groupBy(*model.by_target(fitted["based"])).count().groupBy("study").agg(F.max("count").alias("n_units"))
    skills = [numbers.skill_percent(F.col(f"naive_{c}"), F.col(f"model_{c}")).alias(f"{c}_skill") for c in ("deviance", "log_loss")]
    return s.join(F.broadcast(n), "study").select("study.tier", "study.unit", "n_units", "model_deviance", "naive_deviance", *skills, "calibration_error")


def summary(scored: DataFrame) -> DataFrame:
    """A row for each study: mean deviance and log loss of the model and the pooled rate, and the model's calibration error."""
    hit, by = F.col("y") > 0, ["study", "forecaster"]
    bins = scored.groupBy(*by, numbers.probability_bin(F.col("p")).alias("bin")).agg(
        F.sum(numbers.poisson_deviance(F.col("mu"), F.col("y"))).alias("deviance"),
        F.sum(numbers.log_loss(F.col("p"), hit)).alias("log_loss"),
        F.avg("p").alias("mean_p"),
        F.avg(hit.cast("double")).alias("frequency"),
        F.count("*").alias("n"),
    )
    error = scoring.calibration_error(bins, by)
    means = bins.groupBy(*by).agg(*[(F.sum(c) / F.sum("n")).alias(c) for c in ("deviance", "log_loss")]).join(error, by)
    pick = lambda f, c: F.max(F.when(F.col("forecaster") == f, F.col(c)))
    return means.groupBy("study").agg(
        pick("poisson-factor", "deviance").alias("model_deviance"),
        pick("naive", "deviance").alias("naive_deviance"),
        pick("poisson-factor", "log_loss").alias("model_log_loss"),
        pick("naive", "log_loss").alias("naive_log_loss"),
        pick("poisson-factor", "calibration_error").alias("calibration_error"),
    )
