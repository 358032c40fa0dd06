"""Helpers shared by the text operators: paths, checkpoints, folds and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import storage
from ..sources.storage import shared_dir

__all__ = ["CONTINUATION", "HOT_SHARE", "SPACE", "fold", "forget", "mapped", "partition_keys", "pieces", "released", "saved", "saved_in_place", "settings", "shared_dir", "skew_join", "small", "table", "utf8"]

#: Bytes that separate words: space and U+0009 to U+000D. ``bytes.split()`` splits at exactly these.
SPACE = b" \t\n\x0b\x0c\r"
#: UTF-8 continuation bytes; a text has as many code points as it has other bytes.
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch while a step is saved. Rows with blobs are large, and both sides hold whole batches.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """The session's settings are these while the block runs."""
    before = {name: spark.conf.get(name) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def saved(df: DataFrame, **more: str) -> DataFrame:
    """``storage.saved`` with small Arrow batches; the settings ``more`` of the session hold while the step runs."""
    with settings(df.sparkSession, **BATCHES | more):
        return storage.saved(df)


def saved_in_place(df: DataFrame) -> DataFrame:
    """``saved`` that keeps the partitioning of ``df``, so a join on its key need not shuffle it again.

    A plan under adaptive execution does not tell its partitioning; it is off while this one is planned.
    """
    return saved(df, **{"spark.sql.adaptive.enabled": "false"})


def forget(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more, and the checkpoints where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.

    Its cleaner acts when the driver collects garbage, which may be hours apart, while executors' disks fill up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """For every partition of ``repartition(parts, <long column>)`` the least number from 0 on that goes there.

    Deals numbered work evenly: the hash of consecutive numbers would give some partitions several and others none.
    """
    found: dict[int, int] = {}
    size = 16 * parts
    while len(found) < parts:
        rows = spark.range(size).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("part")).groupBy("part").agg(F.min("id").alias("least"))
        found = {r["part"]: r["least"] for r in rows.collect()}
        size *= 2
    return [found[k] for k in range(parts)]


#: Rows of a few numbers each that may be broadcast.
BROADCAST_ROWS = 500_000


def small(saved_rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Saved rows, marked for broadcast if they are few; beyond that the join shuffles."""
    return F.broadcast(saved_rows) if saved_rows.limit(most + 1).count() <= most else saved_rows


#: A value is frequent when at least one of so many rows has it; no more than this many values can be.
HOT_SHARE = 16_384


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Inner or left join of the saved ``left`` with ``right``, in which ``on`` is unique. Rows of ``left`` with a frequent value
    meet their partner in the map task; at most ``HOT_SHARE`` values can be frequent, which bounds the broadcast."""
    least = max(1_000, left.count() // HOT_SHARE)
    hot = saved(left.groupBy(on).agg(F.count("*").alias("q_n")).where(F.col("q_n") >= least).select(on))
    if not hot.limit(1).count():
        return left.join(right, on, how)
    rest = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    of_hot = right.join(F.broadcast(hot), on, "left_semi")
    return rest.unionByName(left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(of_hot), on, how))


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def mapped(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` with a state built once per task: ``make()`` returns the function for one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            yield from step(batch)
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Give freed memory back at the end of a task; workers live on and would hold it beside the next task's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in ``column``, one row at least; bounds a step's memory."""
    start, held = 0, 0
    for i, n in enumerate(_lengths(batch.column(column))):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()
