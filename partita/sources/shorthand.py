"""Scores written as compact text: ``E4 E4+C4/2 r/0.5 ...`` (pitches joined by +, beats after a slash)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import name_to_midi

BEATS = 4


def tokens(lines: DataFrame) -> DataFrame:
    """keys of ``lines`` (all columns but spec), token, pitches, duration, start: the running clock of each line."""
    keys = [c for c in lines.columns if c != "spec"]
    each = lines.select(*keys, F.posexplode(F.split(F.trim("spec"), r"\s+")).alias("token", "text")).where("text <> ''")
    length = F.split_part("text", F.lit("/"), F.lit(2))
    each = each.withColumns(
        {"pitches": F.split_part("text", F.lit("/"), F.lit(1)), "duration": F.when(length != "", length.cast("double")).otherwise(F.lit(1.0))}
    ).drop("text")
    before = Window.partitionBy(*keys).orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("start", F.coalesce(F.sum("duration").over(before), F.lit(0.0)))


def parse(lines: DataFrame) -> DataFrame:
    """keys, token, voice, midi, start, duration, measure: one row for each note; rests only move the clock."""
    keys = [c for c in lines.columns if c != "spec"]
    notes = tokens(lines).where("pitches <> 'r'").select(*keys, "token", "start", "duration", F.posexplode(F.split("pitches", r"\+")).alias("voice", "name"))
    return notes.select(*keys, "token", "voice", name_to_midi(F.col("name"), strict=True).alias("midi"), "start", "duration", F.floor(F.col("start") / BEATS).cast("int").alias("measure"))


def build(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and pieces of ``lines`` (page_id, hand, spec): a piece lasts as long as its longer hand and has a
    measure for every four beats begun; notes are numbered by start, pitch and order of writing."""
    clock = tokens(lines).groupBy("page_id").agg(F.max(F.col("start") + F.col("duration")).alias("length"))
    pieces = clock.withColumn("measures", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("length") / BEATS) - 1)), lambda m: m * BEATS))
    order = Window.partitionBy("page_id").orderBy("start", "midi", F.desc("hand"), "token", "voice")
    return parse(lines).withColumn("position", F.row_number().over(order) - 1), pieces
