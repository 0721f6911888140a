"""Counts by unit and month, and the dense panel with its explicit zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def by_cell(side: float = 1000.0) -> Column:
    return geo.cell_id(F.col("easting"), F.col("northing"), side)


def by_district() -> Column:
    return F.col("district")


def counts(incidents: DataFrame, unit: Column) -> DataFrame:
    """entity, k, accidents, ksi, tenths; records with an empty unit are left out."""
    return incidents.select(unit.alias("entity"), "k", "ksi", "tenths").where("entity != ''").groupBy("entity", "k").agg(F.count("*").alias("accidents"), F.count_if("ksi").alias("ksi"), F.sum("tenths").alias("tenths"))


def densify(counted: DataFrame) -> DataFrame:
    """A row for each entity and each month that any entity has (of the same study, if there are several), zeros where nothing was counted.

    Months are few and are broadcast; the counts are joined by key.
    """
    of = [c for c in ("study",) if c in counted.columns]
    values = [c for c in counted.columns if c not in (*of, "entity", "k")]
    entities, months = counted.select(*of, "entity").distinct(), F.broadcast(counted.select(*of, "k").distinct())
    axes = entities.join(months, of) if of else entities.crossJoin(months)
    return axes.join(counted, [*of, "entity", "k"], "left").fillna(0, values)


def build(incidents: DataFrame, unit: Column, axis: str = "all") -> DataFrame:
    """The dense panel. axis "all": every entity and month with an incident of any kind; "tier": with a serious one."""
    if axis == "tier":
        incidents = incidents.where("ksi")
    return densify(counts(incidents, unit))


def tiers(panel: DataFrame) -> DataFrame:
    """tier, entity, k, y: the measures of a panel one under the other, in one scan."""
    return panel.unpivot(["entity", "k"], ["accidents", "ksi"], "tier", "y")


def density(panel: DataFrame) -> DataFrame:
    """One row: rows, entities, months, repeated (entity, month) pairs, and whether the panel is dense."""
    seen = panel.groupBy("entity", "k").agg(F.count("*").alias("n"))
    d = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_distinct("entity").alias("n_entities"), F.count_distinct("k").alias("n_months"), F.count_if(F.col("n") > 1).alias("n_repeated"))
    return d.withColumn("dense", (F.col("n_repeated") == 0) & (F.col("n_rows") == F.col("n_entities") * F.col("n_months")))


def is_dense(panel: DataFrame) -> bool:
    return bool(density(panel).first()["dense"])
