"""Square cells of a plane, named i_j by the floors of their coordinates over the cell's side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell_id(easting: Column, northing: Column, side: float) -> Column:
    return F.concat_ws("_", F.floor(easting / side).cast("string"), F.floor(northing / side).cast("string"))


def cell_ij(cell: Column) -> Column:
    """struct(i, j) of a name; null unless both parts are whole numbers."""
    i, j = (F.split_part(cell, F.lit("_"), F.lit(p)) for p in (1, 2))
    return F.when(cell.rlike("^[+-]?[0-9]{1,9}_[+-]?[0-9]{1,9}$"), F.struct(i.try_cast("int").alias("i"), j.try_cast("int").alias("j")))


def cell_centroid(cell: Column, side: float) -> Column:
    """struct(easting, northing) of a cell's middle; null for a name that isn't one."""
    ij = cell_ij(cell)
    return F.when(ij.isNotNull(), F.struct(((ij["i"] + 0.5) * side).alias("easting"), ((ij["j"] + 0.5) * side).alias("northing")))


def neighbour_offsets(radius: int) -> Column:
    """Array of the (di, dj) within a Chebyshev radius, without (0, 0)."""
    return F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if (a, b) != (0, 0)])
