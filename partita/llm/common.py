"""Tables by name, gapless numbering, joins with hot keys, and tasks that give their memory back."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import discard, shared_dir, written  # noqa: F401

#: Rows that one numbering bucket holds on average.
ROWS_PER_BUCKET = 20_000
#: Rows of a small table that are sent to every task at most.
BROADCAST = 200_000
#: A key with more than one in so many of all rows is hot: there are no more hot keys than that.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns what this process has freed to the machine: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with the memory that it freed given back when a task ends."""

    @wraps(run)
    def careful(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return careful


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Jobs of queries made within delete their shuffle files as they end, not when the driver's memory is next
    cleaned: what later jobs need of them is in written tables. The session's own setting returns afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread_join(rows: DataFrame, keyed: DataFrame, key: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed`` (a written table, one row for each key), however hot a key is.

    ``weight`` names the column of ``keyed`` with the rows of its key. A table of up to BROADCAST rows goes to
    every task; of a larger one the hot keys do (HOT_SHARE at most), and only the others are shuffled."""
    n, total = keyed.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if n <= BROADCAST:
        return rows.join(F.broadcast(keyed), key, how)
    is_hot = F.col(weight) > float(total) / HOT_SHARE
    hot, cold = F.broadcast(keyed.where(is_hot)), keyed.where(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(keyed.where(is_hot).select(*key)), key, "left_anti").join(cold, key, how))


def gapless(df: DataFrame, group: str, order: list[Column], name: str, rows: int) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, however large a group is.

    Rows go to buckets by a hash of ``order``; a bucket starts at the number of rows in the group's
    earlier buckets, so that no task sees a whole group. ``df`` must be cheap to read twice (a written
    table) and ``group`` not null; ``rows`` is its row count."""
    buckets = max(1, rows // ROWS_PER_BUCKET)
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    within = Window.partitionBy(group, "__bucket").orderBy(*order)
    if buckets == 1:
        return df.withColumn(name, (F.row_number().over(within) - 1).cast("long")).drop("__bucket")
    starts = (
        df.groupBy(group, "__bucket")
        .count()
        .withColumn("__start", F.sum("count").over(Window.partitionBy(group).orderBy("__bucket")) - F.col("count"))
        .drop("count")
    )
    return (
        df.withColumn("__rank", F.row_number().over(within) - 1)
        .join(starts, [group, "__bucket"])
        .withColumn(name, F.col("__start") + F.col("__rank"))
        .drop("__bucket", "__rank", "__start")
    )
