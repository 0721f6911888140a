"""Frozen forward forecasts of both tiers, a document for each target month."""

from __future__ import annotations

import datetime
import os
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TIERS, NotForward
from ..functions import calendar, numbers
from ..operators import model, panel as panels
from ..sources import documents as document_files
from ..sources.work import staged


def as_at(panel: DataFrame, through: int) -> DataFrame:
    """The rows known through a month; entities without any keep one row without month or count."""
    known = panel.where(F.col("k") <= through)
    rest = panel.select("entity").distinct().join(known.select("entity").distinct(), "entity", "left_anti")
    return known.unionByName(rest, allowMissingColumns=True)


def limits(panel: DataFrame, through: str | None = None, first: str | None = None, last: str | None = None) -> tuple[int, int, int]:
    """The last month that the model may know (by default the panel's last), and the first and last target (by default the 12 months after it).

    Raises NotForward if the first target isn't after what the model may know, and ValueError if the range is empty.
    """
    end = panel.agg(F.max("k")).first()[0] if through is None else calendar.parse_month_py(through)
    if end is None:
        raise ValueError("the panel has no months")
    a = end + 1 if first is None else calendar.parse_month_py(first)
    b = end + 12 if last is None else calendar.parse_month_py(last)
    if a <= end:
        raise NotForward(f"{calendar.month_text_py(a)} is not after {calendar.month_text_py(end)}")
    if b < a:
        raise ValueError("the last target is before the first")
    return end, a, b


def rows(panel: DataFrame, end: int, first: int, last: int, n: int = 400, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Forecasts of both tiers of a panel of entity, k, accidents, ksi, fitted together as two studies.

    Cells: target_month, train_through, tier, cell, rating, expected, p95. Totals: target_month, train_through, tier, model,
    expected_total, total_p5, total_p50, total_p95.
    """
    configs = {t: replace(c, n=n, seed=seed) for t, c in TIERS.items()}
    config = next(iter(configs.values()))  # they differ in radius and shrink only
    both = panels.tiers(panel).withColumnRenamed("tier", "study")
    fitted = model.Fitted(both, lambda axis: model.forward_targets(axis, first, last, end, config.hist_k, tuple(configs)), config, panels.is_dense(panel), end, configs)
    predicted = staged(model.predict(fitted, config), "predicted")
    by, rounded = ["study", "target"], numbers.round_half_up
    named = [calendar.month_text(F.col("target")).alias("target_month"), F.lit(calendar.month_text_py(end)).alias("train_through"), F.col("study").alias("tier")]
    cells = predicted.join(model.p95(fitted, config), [*by, "entity"])
    cells = cells.select(*named, F.col("entity").alias("cell"), rounded(F.col("rating"), 4).alias("rating"), rounded(F.col("expected"), 4).alias("expected"), "p95")
    expected = predicted.groupBy(*by).agg(rounded(F.sum("expected"), 1).alias("expected_total"))
    whole = expected.join(model.total_quantiles(model.totals(fitted, config)), by)
    names = F.coalesce(*[F.when(F.col("study") == t, F.lit(c.name)) for t, c in configs.items()])
    return cells, whole.select(*named, names.alias("model"), "expected_total", *[F.col(f"total_p{q}").cast("double").alias(f"total_p{q}") for q in (5, 50, 95)])


def head(side_km: float = 1.0, n: int = 400, seed: int = 1, source: str = "", made_at: str | None = None) -> dict[str, Column]:
    """What a document says of itself before its tiers. made_at: by default now, in UTC."""
    stamp = made_at or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {
        "made_at": F.lit(stamp), "model": F.lit("poisson-factor"), "cell_km": F.lit(float(side_km)), "n": F.lit(n).cast("long"), "seed": F.lit(seed).cast("long"),
        "train_source": F.lit(os.path.basename(source)), "settle_note": F.concat(F.lit("settle against the first panel that covers "), F.col("target_month")),
    }


def publish(
    panel: DataFrame, path: str, through: str | None = None, first: str | None = None, last: str | None = None,
    side_km: float = 1.0, n: int = 400, seed: int = 1, source: str = "", made_at: str | None = None,
) -> None:
    """Write a forecast document for each month first to last, as limits() has it."""
    end, a, b = limits(panel, through, first, last)
    document_files.write_forecasts(*rows(panel, end, a, b, n, seed), path, head(side_km, n, seed, source, made_at))
