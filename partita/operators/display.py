"""The relations that a screen of a score reads: keyboard, roll, page overlay, library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import is_black

WHITE_WIDTH, BLACK_WIDTH = 100.0, 60.0


def keyboard(ranges: DataFrame) -> DataFrame:
    """page_id, midi, black, x: the keys of each range (low, high), widened to white keys at both ends."""
    low = F.when(is_black(F.col("low")) & (F.col("low") > 21), F.col("low") - 1).otherwise(F.col("low"))
    high = F.when(is_black(F.col("high")) & (F.col("high") < 108), F.col("high") + 1).otherwise(F.col("high"))
    keys = ranges.select("page_id", F.explode(F.sequence(low, high)).alias("midi")).withColumn("black", is_black(F.col("midi")))
    before = Window.partitionBy("page_id").orderBy("midi").rowsBetween(Window.unboundedPreceding, -1)
    whites = F.coalesce(F.sum((~F.col("black")).cast("int")).over(before), F.lit(0)).cast("double")
    return keys.withColumn("x", whites * WHITE_WIDTH - F.when(F.col("black"), BLACK_WIDTH / 2).otherwise(0.0))


def hit_test(notes: DataFrame, clicks: DataFrame) -> DataFrame:
    """``clicks`` (page_id, click_id, midi, beat) with the first note at that pitch whose span, from a tenth of
    a beat before its start to its end, holds the beat; id is null where none does."""
    wide = notes.select("page_id", "midi", F.col("id").alias("id"), "start", "duration", "emit_seq", F.explode(F.sequence(F.floor(F.col("start") - 0.1), F.floor(F.col("start") + F.col("duration")))).alias("__b"))
    hit = (F.col("start") - 0.1 <= F.col("beat")) & (F.col("beat") <= F.col("start") + F.col("duration"))
    order = Window.partitionBy("page_id", "click_id").orderBy("start", "midi", "emit_seq")
    found = clicks.withColumn("__b", F.floor("beat")).join(wide, ["page_id", "midi", "__b"]).where(hit)
    found = found.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("page_id", "click_id", "id")
    return clicks.join(found, ["page_id", "click_id"], "left")


def overlay(detections: DataFrame, notes: DataFrame, beat: Column) -> DataFrame:
    """Detections with their note's pitch and whether it is live; a repeated note id counts once, the last one."""
    last = Window.partitionBy("page_id", "id").orderBy(F.desc("emit_seq"))
    one = notes.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    joined = detections.join(one.withColumnRenamed("id", "note_id"), ["page_id", "note_id"])
    return joined.withColumn("live", (F.col("start") <= beat) & (beat < F.col("start") + F.col("duration")))


def roll(notes: DataFrame, first: Column, last: Column, beat: Column) -> DataFrame:
    """Notes that show between two beats, with live (no epsilon) and unsure (0 < confidence < 0.8)."""
    end = F.col("start") + F.col("duration")
    shown = notes.where((end >= first) & (F.col("start") <= last))
    return shown.withColumns({"live": (F.col("start") <= beat) & (beat < end), "unsure": (F.col("confidence") > 0) & (F.col("confidence") < 0.8)})


def effective_tempo(tempo: Column, speed: Column) -> Column:
    return F.floor(tempo * speed / 100 + 0.5).cast("int")


def bar_label(beat: Column, beats: Column, bars: Column) -> Column:
    """The bar number that is shown: one more than the bar the beat is in, the number of bars at most."""
    return F.least(F.floor(beat / beats) + 1, bars)


def at_playhead(midi: Column, beat: Column) -> list[Column]:
    """start (quarter-beat grid) and hand of a note that is added while playing."""
    return [(F.floor(beat * 4 + 0.5) / 4).alias("start"), F.when(midi < 60, "left").otherwise("right").alias("hand")]


def tempo_clamped(tempo: Column) -> Column:
    return F.least(F.lit(220), F.greatest(F.lit(30), tempo))


def start_moved(start: Column, steps: Column) -> Column:
    """A note's start, moved by quarter beats and not before the score's."""
    return F.greatest(F.lit(0.0), start + steps * 0.25)


# The colours of keys at rest (black, white), played by the learner (left, right), and played
# by the application (left, right; on black keys, on white keys).
REST = ("#1b2029", "#e9ecf1")
YOURS = ("#38bdf8", "#7dd3fc")
PLAYED_BLACK = ("#b07a12", "#fcd34d")
PLAYED_WHITE = ("#d99a1f", "#fbbf24")


def key_tint(black: Column, hand: Column, yours: Column) -> Column:
    """A key's colour; ``hand`` is null where nothing holds it down."""
    by_hand = lambda pair: F.when(hand == "right", pair[1]).otherwise(pair[0])
    at_rest = F.when(black, REST[0]).otherwise(REST[1])
    return F.when(hand.isNull(), at_rest).when(yours, by_hand(YOURS)).when(black, by_hand(PLAYED_BLACK)).otherwise(by_hand(PLAYED_WHITE))


def roll_bounds(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages`` with low and high: two keys beyond the notes on each side, on the piano; 48 to 72 without notes."""
    own = notes.groupBy("page_id").agg(F.min("midi").alias("__low"), F.max("midi").alias("__high"))
    low, high = F.greatest(F.lit(21), F.col("__low") - 2), F.least(F.lit(108), F.col("__high") + 2)
    both = {"low": F.when(F.col("__low").isNull(), 48).otherwise(low), "high": F.when(F.col("__high").isNull(), 72).otherwise(high)}
    return pages.join(own, "page_id", "left").withColumns(both).drop("__low", "__high")


def beat_grid(pages: DataFrame, length: Column, beats: Column) -> DataFrame:
    """page_id, beat, bar: a line on each beat to the end of the bar behind the last one, and whether it is a bar line."""
    last = ((F.ceil(length / beats) + 1) * beats).cast("long")
    lines = pages.select("page_id", beats.alias("__beats"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("beat"))
    return lines.select("page_id", "beat", (F.pmod(F.col("beat"), F.col("__beats")) == 0).alias("bar"))


def library_list(pieces: DataFrame) -> DataFrame:
    """owner, place, title, label, saved: what a list of saved pieces shows."""
    return pieces.select("owner", "place", "title", F.concat(F.col("notes").cast("string"), F.lit(" notes")).alias("label"), F.to_date(F.timestamp_millis("created_at")).cast("string").alias("saved"))
