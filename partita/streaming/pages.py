"""Arriving page images and playback ticks as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.tables import discard, written
from ..plans.recognize import recognize_pages
from ..sources import images

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.png", at_once: int = 64) -> DataFrame:
    """page_id, arrived, size, content of each image file that appears under ``folder``; at most ``at_once`` a batch."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).load(folder)
    return files.select(F.col("path").alias("page_id"), F.col("modificationTime").alias("arrived"), F.col("length").alias("size"), "content")


def due(ticks: DataFrame, schedule: DataFrame) -> DataFrame:
    """A stream of ticks (page_id, tick) with the scheduled notes that each of them books.

    Notes carry the tick that books them, so this is a stream-static equi-join without state."""
    return ticks.join(schedule.withColumnRenamed("batch", "tick"), ["page_id", "tick"])



def read_arrivals(files: DataFrame, out: str, checkpoint: str, read: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = recognize_pages) -> DataStreamWriter:
    """A stream that reads arriving page files (page_id, content) into scores: start it with ``.start()``.

    Each micro-batch decodes its files, recognises the good ones and writes ``notes`` and ``pages`` (a row for each
    file, with what is wrong with a bad one) under ``out``, in folders of the batch's own number. A batch that is
    run again after a failure has the same files and the same number, so it replaces what it left, and each
    page is there once."""

    def take(batch: DataFrame, number: int) -> None:
        pages = written(images.decoded(batch), "arrived")
        notes, results = read(pages.where("problem is null").drop("problem"))
        every = pages.select("page_id", "problem").join(results, "page_id", "left")
        notes.write.mode("overwrite").parquet(f"{out}/notes/batch={number}")
        every.write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        discard(pages, notes, results)

    return files.select("page_id", "content").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
