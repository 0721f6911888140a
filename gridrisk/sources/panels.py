"""Panel files: month, cell, accidents, ksi, weighted_days and optionally a group, one row for each cell and observed month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar, numbers
from .incidents import require_columns


def write(panel: DataFrame, path: str, csv: bool = False, groups: DataFrame | None = None) -> None:
    """Parquet for Spark, ordered by cell and month; or CSV with weights of two decimals for others. groups: entity, k and group, a further column."""
    more = []
    if groups is not None:
        panel, more = panel.join(groups, ["entity", "k"], "left"), ["group"]
    weights = F.format_string("%.2f", F.col("tenths") / 10).alias("weighted_days")
    out = panel.select(calendar.month_text(F.col("k")).alias("month"), F.col("entity").alias("cell"), "accidents", "ksi", weights, *more).orderBy("cell", "month")
    (out.write.option("header", True).csv if csv else out.write.parquet)(path)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """A panel in CSV if its file, or a file in its folder, is called so, else in Parquet."""
    if not path.endswith(".csv"):
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("path")
        if found.isEmpty():
            return spark.read.parquet(path)
    return spark.read.option("header", True).csv(path)


def parsed(spark: SparkSession, path: str, values: tuple[str, ...] = ("accidents", "ksi"), entity: str = "cell") -> DataFrame:
    """entity, k and the values of all rows of a panel, both tiers in one scan, with raw (the texts that they come from) and reason.

    reason names what doesn't parse first, "month" or a value's column, and is null for a good row.
    """
    raw = _raw(spark, path)
    require_columns(raw, "month", entity, *values)
    text = {c: F.col(c).cast("string") for c in ("month", *values)}
    p = raw.select(
        F.col(entity).cast("string").alias("entity"),
        calendar.parse_month(text["month"]).alias("k"),
        *[numbers.strict_double(text[v]).alias(v) for v in values],
        F.struct(*[t.alias(c) for c, t in text.items()]).alias("raw"),
    )
    return p.withColumn("reason", F.coalesce(*[F.when(F.col(c).isNull(), F.lit(name)) for c, name in (("k", "month"), *((v, v) for v in values))]))


def read(spark: SparkSession, path: str, values: tuple[str, ...] = ("accidents", "ksi"), entity: str = "cell") -> DataFrame:
    """entity, k and the values of the good rows of a panel; rejected() has the others."""
    return parsed(spark, path, values, entity).where("reason is null").drop("raw", "reason")


def rejected(spark: SparkSession, path: str, values: tuple[str, ...] = ("accidents", "ksi"), entity: str = "cell") -> DataFrame:
    """entity, raw and reason of the rows that read() leaves out."""
    return parsed(spark, path, values, entity).where("reason is not null").select("entity", "raw", "reason")


def groups(spark: SparkSession, path: str, group: str = "group", entity: str = "cell") -> DataFrame:
    """entity and its group: the last that isn't empty, in order of months."""
    raw = _raw(spark, path)
    require_columns(raw, "month", entity, group)
    return raw.where(F.col(group) != "").groupBy(F.col(entity).alias("entity")).agg(F.max_by(group, F.struct("month", group)).alias("group"))
