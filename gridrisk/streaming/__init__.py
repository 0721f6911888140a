"""Incident counts kept up to date from a stream.

A batch writes the counts of its own records alone: a run of level 0. As in a log-structured merge tree, FANOUT runs of one level that
follow each other are added up to a run of the next, so what is written for n batches is their counts some log(n) times, and a reader adds up
a few runs a level. Which runs a batch writes follows from its number alone, so a batch that is repeated writes the same again, over its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import panel

FANOUT = 4
COUNTS = ("accidents", "ksi", "tenths")
RUN = "entity string, k int, accidents bigint, ksi bigint, tenths bigint"


def runs(batches: int) -> list[tuple[int, int]]:
    """(level, first batch) of the runs that hold what the first `batches` batches counted: the digits of their number to the base FANOUT."""
    found, first, level = [], 0, 0
    while FANOUT ** (level + 1) <= batches:
        level += 1
    for at in range(level, -1, -1):
        while first + FANOUT**at <= batches:
            found.append((at, first))
            first += FANOUT**at
    return found


def _folder(path: str, level: int, first: int) -> str:
    return f"{path}/level={level}/first={first}"


def _added_up(spark: SparkSession, path: str, which: list[tuple[int, int]]) -> DataFrame:
    parts = [spark.read.schema(RUN).parquet(_folder(path, *r)) for r in which]
    return reduce(DataFrame.unionByName, parts).groupBy("entity", "k").agg(*[F.sum(c).alias(c) for c in COUNTS])


def write_batch(records: DataFrame, number: int, unit: Column, path: str) -> None:
    """What batch `number` writes: its own counts, the runs that it completes, and its number."""
    spark = records.sparkSession
    panel.counts(records, unit).write.mode("overwrite").parquet(_folder(path, 0, number))
    level = 0
    while (number + 1) % FANOUT ** (level + 1) == 0:
        first, width = number + 1 - FANOUT ** (level + 1), FANOUT**level
        _added_up(spark, path, [(level, first + k * width) for k in range(FANOUT)]).write.mode("overwrite").parquet(_folder(path, level + 1, first))
        level += 1
    spark.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{path}/done/{number:012d}")


def keep_counts(stream: DataFrame, unit: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of a stream of typed incidents below path. The stream has no state but its place in the source.

    Empty batches write empty runs. Runs that a larger one holds stay, as a batch may be repeated; they aren't read any more.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, number: write_batch(batch, number, unit, path)).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """entity, k, accidents, ksi, tenths after the last batch that is done; operators.panel.densify makes a panel of them.

    Raises AnalysisException if no batch has been done yet.
    """
    last = spark.read.option("recursiveFileLookup", True).schema("batch int").parquet(f"{path}/done").agg(F.max("batch")).first()[0]
    return _added_up(spark, path, runs(last + 1))
