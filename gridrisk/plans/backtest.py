"""Expanding-window backtest: every month with enough history is forecast from the months before it and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..functions import numbers
from ..operators import model, scoring


def baselines(panel: DataFrame, targets: DataFrame, axis: DataFrame) -> DataFrame:
    """target, entity, y, naive (the pooled rate before the target) and climatology (the entity's own, or the pooled).

    An entity's own history is a running sum along its months, dense or not.
    """
    of, by = model.study(targets), model.by_target(targets)
    pool = model.known_months(axis, targets.select(*by, F.lit(None).cast("int").alias("cutoff"))).groupBy(*by).agg((F.sum("total").cast("double") / F.sum("n_rows")).alias("naive"))
    w = Window.partitionBy(*of, "entity").orderBy("k").rangeBetween(Window.unboundedPreceding, -1)
    run = panel.select(*of, "entity", F.col("k").alias("target"), "y", F.sum("y").over(w).alias("own"), F.count("*").over(w).alias("n"))
    rows = run.join(F.broadcast(targets.select(*by)), by).join(F.broadcast(pool), by)
    return rows.select(*by, "entity", numbers.half_up_count(F.col("y").cast("double")).alias("y"), "naive", F.coalesce(F.try_divide(F.col("own").cast("double"), "n"), F.col("naive")).alias("climatology"))


FORECASTERS = ("poisson-factor", "naive", "climatology")


def fit(panel: DataFrame, config: ModelConfig, min_history: int = 24, dense: bool | None = None) -> model.Fitted:
    """The stages for all months with enough history."""
    return model.Fitted(panel, lambda axis: model.backtest_targets(axis, min_history, config.hist_k), config, dense)


def scored(fitted: model.Fitted, config: ModelConfig, forecasters: tuple[str, ...] = FORECASTERS) -> DataFrame:
    """Rows target, entity, forecaster, p, mu, y. The model is fitted only if it is among the forecasters."""
    rows, by = baselines(fitted["panel"], fitted["targets"], fitted["axis"]), model.by_target(fitted["targets"])
    parts = {name: F.struct(F.lit(name).alias("forecaster"), numbers.occurrence(F.col(name)).alias("p"), F.col(name).alias("mu")) for name in FORECASTERS[1:]}
    if FORECASTERS[0] in forecasters:
        rows = rows.join(model.predict(fitted, config), [*by, "entity"])
        parts[FORECASTERS[0]] = F.struct(F.lit(FORECASTERS[0]).alias("forecaster"), (1 - F.col("rating")).alias("p"), F.col("expected").alias("mu"))
    return rows.select(*by, "entity", "y", F.explode(F.array(*[parts[f] for f in forecasters])).alias("x")).select(*by, "entity", "x.*", "y")


def realised(fitted: model.Fitted) -> DataFrame:
    """target and y, the total of each month."""
    return fitted["axis"].select(F.col("k").alias("target"), F.col("total").alias("y"))


def report(panel: DataFrame, config: ModelConfig, min_history: int = 24, dense: bool | None = None) -> dict[str, DataFrame]:
    """scores: a row for each forecaster, with crps and coverage of totals for the model alone; reliability: the model's curve; totals: by month."""
    fitted = fit(panel, config, min_history, dense)
    rows, drawn = scored(fitted, config), model.totals(fitted, config)
    curve = scoring.reliability(rows, ["forecaster"])
    by_month = scoring.crps(drawn, realised(fitted)).join(scoring.coverage(drawn, realised(fitted)), "target")
    whole = by_month.agg(F.avg("crps").alias("total_crps"), F.avg(F.col("covered").cast("double")).alias("total_coverage"))
    own = F.col("forecaster") == "poisson-factor"
    scores = scoring.means(rows, ["forecaster"]).join(scoring.calibration_error(curve, ["forecaster"]), "forecaster").crossJoin(F.broadcast(whole))
    scores = scores.withColumns({c: F.when(own, F.col(c)) for c in ("total_crps", "total_coverage")}).withColumn("model_name", F.when(own, config.name))
    return {"scores": scores, "reliability": curve.where(own), "totals": by_month}
