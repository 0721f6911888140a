"""Incident records: CSV files, and views over the order tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import BoundingBox, MissingColumns
from ..functions import calendar, numbers

EASTING, NORTHING, SEVERITY, DATE, DISTRICT = "location_easting_osgr", "location_northing_osgr", "collision_severity", "date", "local_authority_ons_district"


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, found by the header's names. A short row gets nulls and doesn't end the scan."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)


def typed(raw: DataFrame) -> DataFrame:
    """easting, northing, severity, ksi, tenths, k, district of raw records; null where a field doesn't parse."""
    require_columns(raw, EASTING, NORTHING, SEVERITY, DATE)
    district = F.coalesce(F.col(DISTRICT), F.lit("")) if DISTRICT in raw.columns else F.lit("")
    return raw.select(
        numbers.strict_double(F.col(EASTING)).alias("easting"),
        numbers.strict_double(F.col(NORTHING)).alias("northing"),
        F.col(SEVERITY).alias("severity"),
        numbers.is_serious(F.col(SEVERITY)).alias("ksi"),
        numbers.weight_tenths(F.col(SEVERITY)).alias("tenths"),
        calendar.parse_date_month(F.col(DATE)).alias("k"),
        district.alias("district"),
    )


def in_area(box: BoundingBox = BoundingBox()):
    return F.coalesce(F.col("easting").between(box.east_low, box.east_high) & F.col("northing").between(box.north_low, box.north_high), F.lit(False))


def accepted(incidents: DataFrame, box: BoundingBox = BoundingBox()) -> DataFrame:
    """The records inside the box that have a month."""
    return incidents.where(in_area(box) & F.col("k").isNotNull())


def reason(box: BoundingBox = BoundingBox()) -> Column:
    """Why a record isn't accepted: "coordinates", "outside" or "date", whichever comes first; null if it is."""
    bad = F.col("easting").isNull() | F.col("northing").isNull()
    return F.when(bad, "coordinates").when(~in_area(box), "outside").when(F.col("k").isNull(), "date")


def rejected(incidents: DataFrame, box: BoundingBox = BoundingBox()) -> DataFrame:
    """The records that accepted() leaves out, with their reason."""
    return incidents.withColumn("reason", reason(box)).where("reason is not null")


def _counts(box: BoundingBox) -> list[Column]:
    why = reason(box)
    named = {"n_bad_coordinates": "coordinates", "n_outside": "outside", "n_bad_date": "date"}
    return [F.count(F.lit(1)).alias("n_read"), *[F.count_if(F.coalesce(why == r, F.lit(False))).alias(n) for n, r in named.items()], F.count_if(why.isNull()).alias("n_accepted")]


def counters(incidents: DataFrame, box: BoundingBox = BoundingBox()) -> DataFrame:
    """One row: records read, with coordinates that don't parse, outside the area, without a month, accepted."""
    return incidents.agg(*_counts(box))


def observed(incidents: DataFrame, observation: Observation, box: BoundingBox = BoundingBox()) -> DataFrame:
    """The accepted records; what counters() has is in the observation when the job that reads them is over."""
    return accepted(incidents.observe(observation, *_counts(box)), box)


def from_orders(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """Raw records over orders and customers. dense: 130 cells of 1 km; sparse: as many as there are customers, nearly."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    east = 500_000 + (cust * 7919) % 65_000 if sparse else F.when(key % 97 == 0, 700_000).otherwise(500_000 + 1000 * (cust % 13) + key % 1000)
    north = 155_000 + (cust * 104_729) % 50_000 if sparse else 155_000 + 1000 * (F.floor(cust / 13) % 10) + F.floor(key / 7) % 1000
    return o.join(c, cust == F.col("c_custkey")).select(
        east.cast("string").alias(EASTING),
        north.cast("string").alias(NORTHING),
        F.substring("o_orderpriority", 1, 1).alias(SEVERITY),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias(DATE),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias(DISTRICT),
    )
