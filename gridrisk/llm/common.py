"""What the operators of this subpackage share: tables, the shared work folder, splits and small text helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.work import new_folder, staged  # noqa: F401

#: Bytes of words are A-Z lowered; every byte below 0x80 that is neither a digit nor a letter separates alphanumeric words.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write df to the shared folder and return the table read back: lineage ends here, and nothing above is computed twice.

    free: have the driver collect its garbage, on which Spark drops the shuffle files of finished work.
    """
    out = staged(df, label)
    if free:
        df.sparkSession.sparkContext._jvm.System.gc()
    return out


_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]):
    """What make() gives, kept in this Python worker for later tasks; one thing is kept at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def in_arrow(df: DataFrame, run: Callable, schema: str | T.StructType, keeps: bool = False, rows: int = 1000, size: str = "16m") -> DataFrame:
    """df.mapInArrow(run, schema) by batches of at most `rows` rows and about `size` bytes, so that whole texts fit a worker.

    Spark reads these limits from the session when the plan runs, so they are set there, unless the session has smaller ones.
    Workers are used again by other stages; unless run keeps things in its worker, what an earlier stage held there goes.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)

    def alone(batches):
        release()
        yield from run(batches)
        trim()

    return df.mapInArrow(run if keeps else alone, schema)


def release() -> None:
    _held.clear()


def trim() -> None:
    """Give memory that is free again back to the system: workers wait for other stages, and beside them the JVM needs it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows (each of a few numbers or short texts), else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(n))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def filled(batches):
    """The batches that have rows."""
    return (b for b in batches if (b.num_rows if hasattr(b, "num_rows") else len(b)))
