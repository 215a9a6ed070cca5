"""MIDI format 0 files as relations of events and as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up

TICKS = 480
LEFT_VELOCITY, RIGHT_VELOCITY = 72, 88


def variable_length(value: Column) -> Column:
    """A whole number from 0 to 2^28 - 1 in hex: groups of seven bits, the high bit set on all but the last."""
    n = value.cast("long")
    groups = F.when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).otherwise(4)
    byte = lambda k: F.shiftright(n, 7 * k).bitwiseAND(F.lit(127)) + (128 if k else 0)
    parts = [F.when(groups > k, F.lpad(F.hex(byte(k)), 2, "0")).otherwise("") for k in (3, 2, 1, 0)]
    return F.concat(*parts)


def _byte(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("long")), 2, "0")


def events(notes: DataFrame, scores: DataFrame) -> DataFrame:
    """page_id, tick, seq, delta, data (hex): tempo and time signature, then a note-on and a note-off for each
    note. Equal ticks keep the order of emission; ``delta`` counts from the event before.

    Notes have page_id, position (the order of the score), midi, start, duration, hand; scores have
    page_id, tempo, beats, beat_type."""
    micros = half_up(F.lit(60_000_000.0) / F.col("tempo"))
    tempo = F.concat(F.lit("FF5103"), F.lpad(F.hex(micros), 6, "0"))
    meter = F.concat(F.lit("FF5804"), _byte(F.col("beats")), _byte(F.log2(F.col("beat_type"))), F.lit("1808"))
    zero = F.lit(0).cast("long")
    meta = scores.select("page_id", F.posexplode(F.array(tempo, meter)).alias("seq", "data")).select("page_id", zero.alias("tick"), F.col("seq").cast("long").alias("seq"), "data")
    left = F.col("hand") == "left"
    channel, velocity = left.cast("int"), F.when(left, LEFT_VELOCITY).otherwise(RIGHT_VELOCITY)
    on = F.struct(half_up(F.col("start") * TICKS).alias("tick"), F.lit(0).alias("k"), F.concat(_byte(144 + channel), _byte(F.col("midi")), _byte(velocity)).alias("data"))
    off = F.struct(half_up((F.col("start") + F.col("duration")) * TICKS).alias("tick"), F.lit(1).alias("k"), F.concat(_byte(128 + channel), _byte(F.col("midi")), F.lit("00")).alias("data"))
    sounding = notes.select("page_id", "position", F.explode(F.array(on, off)).alias("e"))
    sounding = sounding.select("page_id", "e.tick", (2 + 2 * F.col("position") + F.col("e.k")).cast("long").alias("seq"), "e.data")
    order = Window.partitionBy("page_id").orderBy("tick", "seq")
    return meta.unionByName(sounding).withColumn("delta", F.col("tick") - F.coalesce(F.lag("tick").over(order), zero))


def files(events_: DataFrame) -> DataFrame:
    """page_id, bytes: the whole file of each page. A page's events are joined in order; pages spread over tasks."""
    item = F.struct("tick", "seq", F.concat(variable_length(F.col("delta")), F.col("data")).alias("hex"))
    track = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda e: e["hex"]), "")
    body = events_.groupBy("page_id").agg(F.concat(track, F.lit("00FF2F00")).alias("track"))
    size = F.lpad(F.hex((F.length("track") / 2).cast("long")), 8, "0")
    header = f"4D546864{6:08X}{0:04X}{1:04X}{TICKS:04X}4D54726B"
    return body.select("page_id", F.unhex(F.concat(F.lit(header), size, F.col("track"))).alias("bytes"))


def file_name(title: Column) -> Column:
    """A title as a file name: runs of other than word characters become a hyphen."""
    return F.concat(F.lower(F.regexp_replace(title, r"\W+", "-")), F.lit(".mid"))
