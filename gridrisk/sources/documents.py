"""Frozen forecasts and their resolutions as JSON, a document for each target month."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .work import staged

TIERS = ("accidents", "ksi")
TOTALS = ("model", "expected_total", "total_p5", "total_p50", "total_p95")
CELL = "struct<cell:string,rating:double,expected:double,p95:bigint>"
TIER = f"struct<model:string,expected_total:double,total_p5:double,total_p50:double,total_p95:double,cells:array<{CELL}>>"
FORECAST = f"target_month string, made_at string, model string, cell_km double, n bigint, seed bigint, train_through string, train_source string, settle_note string, accidents {TIER}, ksi {TIER}"


def write(documents: DataFrame, path: str, indent: bool = False) -> None:
    """One JSON text a row, in a folder for each target month."""
    text = F.to_json(F.struct(*documents.columns), {"pretty": "true"} if indent else {})
    documents.select(text.alias("value"), "target_month").write.partitionBy("target_month").text(path)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """Forecast documents; fields that a reader doesn't select aren't built."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", FORECAST).alias("d")).select("d.*")


def forecast_cells(documents: DataFrame, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """target_month, train_through, tier, cell, rating, expected, p95 of forecast documents."""
    parts = [documents.select("target_month", "train_through", F.lit(t).alias("tier"), F.explode(F.col(t)["cells"]).alias("c")).select("target_month", "train_through", "tier", "c.*") for t in tiers]
    return reduce(DataFrame.unionByName, parts)


def forecast_totals(documents: DataFrame, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """target_month, train_through, tier, model, expected_total, total_p5, total_p50, total_p95 of forecast documents."""
    parts = [documents.select("target_month", "train_through", F.lit(t).alias("tier"), *[F.col(t)[c].alias(c) for c in TOTALS]) for t in tiers]
    return reduce(DataFrame.unionByName, parts)


def write_forecasts(cells: DataFrame, totals: DataFrame, path: str, head: dict[str, Column] | None = None) -> None:
    """A forecast document for each target month, of which forecast_cells and forecast_totals give these rows, in order of the cells' names.

    head: further columns of totals by the names that they have in the document, before the tiers. A document is written line by line: its
    rows are sorted by month, part and cell, by tasks that hold a month each, and no row holds more than a cell. A tier
    without totals is null, and one without cells has an empty list.
    """
    by, totals = ["target_month", "train_through"], staged(totals, "totals")
    opened = lambda json, end: F.concat(F.expr(f"substr({json}, 1, length({json}) - 1)"), F.lit(end))  # noqa: E731  without the closing brace
    tiers = totals.select(*by, "tier", F.to_json(F.struct(*TOTALS)).alias("json"))
    tiers = tiers.groupBy(*by).pivot("tier", list(TIERS)).agg(F.first("json"))
    fields = {"target_month": F.col("target_month"), **(head or {}), "train_through": F.col("train_through")}
    header = totals.select(*by, F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("json")).groupBy(*by).agg(F.first("json").alias("json"))
    whole = header.join(tiers, by)
    lines = [F.struct(F.lit(0).alias("part"), opened("json", "").alias("line"))]
    for k, t in enumerate(TIERS):
        lines.append(F.struct(F.lit(3 * k + 1).alias("part"), F.concat(F.lit(f',"{t}":'), F.coalesce(opened(f"`{t}`", ',"cells":['), F.lit("null"))).alias("line")))
        lines.append(F.struct(F.lit(3 * k + 3).alias("part"), F.when(F.col(t).isNotNull(), "]}").otherwise("").alias("line")))
    lines.append(F.struct(F.lit(3 * len(TIERS) + 1).alias("part"), F.lit("}").alias("line")))
    frame = whole.select(*by, F.explode(F.array(*lines)).alias("x")).select(*by, "x.part", F.lit("").alias("cell"), "x.line")
    part = F.coalesce(*[F.when(F.col("tier") == t, F.lit(3 * k + 2)) for k, t in enumerate(TIERS)])
    listed = cells.join(F.broadcast(totals.select(*by, "tier").distinct()), [*by, "tier"]).select(*by, part.alias("part"), "cell", F.to_json(F.struct("cell", "rating", "expected", "p95")).alias("line"))
    w = Window.partitionBy(*by).orderBy("part", "cell")
    line = frame.unionByName(listed).withColumn("first", F.coalesce(F.lag("part").over(w) != F.col("part"), F.lit(True)))
    line = line.select("target_month", F.when((F.col("cell") == "") | F.col("first"), F.col("line")).otherwise(F.concat(F.lit(","), F.col("line"))).alias("value"))
    line.write.partitionBy("target_month").text(path)
