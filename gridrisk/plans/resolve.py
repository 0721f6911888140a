"""Settlement of frozen forecasts against a later panel."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NotForward, NotPublished
from ..functions import calendar, numbers
from ..operators import panel as panels, scoring
from ..sources.work import staged


def check(forecasts: DataFrame, panel: DataFrame) -> None:
    """Raises NotForward for a forecast that isn't after its training, or whose months don't parse, and NotPublished for a target beyond the panel."""
    f = forecasts.select(calendar.parse_month(F.col("target_month")).alias("t"), calendar.parse_month(F.col("train_through")).alias("h"))
    bad = f.where(F.col("t").isNull() | F.col("h").isNull() | (F.col("t") <= F.col("h"))).limit(1).count()
    if bad:
        raise NotForward("a forecast's target is not after its training, or one of them is no month")
    late = f.join(panel.select(F.col("k").alias("t")).distinct(), "t", "left_anti").limit(1).count()
    if late:
        end = panel.agg(F.max("k")).first()[0]
        raise NotPublished(f"the panel has nothing for a target; it ends with {calendar.month_text_py(end) if end is not None else 'no month'}")


def settled_cells(cells: DataFrame, panel: DataFrame) -> DataFrame:
    """tier, target, cell, p, mu and y for each forecast cell; a cell without incidents has 0, other cells' incidents aren't counted."""
    forecast = cells.select("tier", calendar.parse_month(F.col("target_month")).alias("target"), "cell", (1 - F.col("rating")).alias("p"), F.col("expected").alias("mu"))
    realised = panels.tiers(panel).select("tier", F.col("k").alias("target"), F.col("entity").alias("cell"), numbers.half_up_count(F.col("y").cast("double")).alias("y"))
    return forecast.join(realised, ["tier", "target", "cell"], "left").fillna(0, ["y"])


def resolutions(cells: DataFrame, totals: DataFrame, panel: DataFrame, source: str = "") -> DataFrame:
    """A row for each forecast and tier: mean scores, the realised total, whether it is within the 90 % interval, the reliability
    curve as rows of mean, frequency and number, and the incidents of cells that weren't forecast."""
    settled = staged(settled_cells(cells, panel), "settled")
    by = ["tier", "target"]
    curve = scoring.reliability(settled, by)
    line = F.struct("bin", numbers.round_half_up(F.col("mean_p"), 3).alias("p"), numbers.round_half_up(F.col("frequency"), 3).alias("f"), F.col("n").cast("double").alias("n"))
    matrix = curve.groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("r"))
    realised = settled.groupBy(*by).agg(F.sum("y").alias("realised_total"))
    everything = panels.tiers(panel).groupBy("tier", F.col("k").alias("target")).agg(F.sum("y").cast("long").alias("all_total"))
    out = totals.withColumn("target", calendar.parse_month(F.col("target_month")))
    for part in (scoring.means(settled, by), scoring.calibration_error(curve, by), matrix, realised):
        out = out.join(part, by)
    return out.join(everything, by, "left").select(
        "target_month",
        "tier",
        "model",
        "train_through",
        F.lit(os.path.basename(source)).alias("realised_source"),
        "n",
        "brier",
        "log_loss",
        "deviance",
        "calibration_error",
        "expected_total",
        "realised_total",
        F.col("realised_total").between(F.col("total_p5"), F.col("total_p95")).alias("in_interval"),
        (F.coalesce("all_total", F.lit(0)) - F.col("realised_total")).alias("unforecast_total"),
        F.transform("r", lambda x: F.array(x["p"], x["f"], x["n"])).alias("reliability"),
    )
