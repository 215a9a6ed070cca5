"""Playing scores as data: what sounds when, schedules, clicks and loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6
LOOK_AHEAD = 0.15
TICK = 0.025


def sounding_at(notes: DataFrame, beats: DataFrame) -> DataFrame:
    """``beats`` (page_id, beat) with the notes that sound: start - epsilon <= beat < start + duration.

    Notes are exploded over the whole beats they cover, so that an equi-join on page and whole beat finds
    the pairs; the exact condition follows."""
    first, last = F.floor(F.col("start") - EPSILON), F.floor(F.col("start") + F.col("duration"))
    spread = notes.withColumn("__b", F.explode(F.sequence(first, last)))
    asked = beats.withColumn("__b", F.floor("beat"))
    hit = (F.col("beat") >= F.col("start") - EPSILON) & (F.col("beat") < F.col("start") + F.col("duration"))
    return asked.join(spread, ["page_id", "__b"]).where(hit).drop("__b")


def sounding_changes(sounding: DataFrame) -> DataFrame:
    """page_id, beat, keys: the sounding set wherever it differs from the beat before (sampled beats)."""
    sets = sounding.groupBy("page_id", "beat").agg(F.array_join(F.array_sort(F.collect_set("midi")), ",").alias("keys"))
    before = F.lag("keys").over(Window.partitionBy("page_id").orderBy("beat"))
    return sets.withColumn("__before", before).where(~F.col("keys").eqNullSafe(F.col("__before"))).drop("__before")


def schedule(notes: DataFrame, tempo: Column, start: Column, end: Column, muted: list[str], origin: float = 0.06) -> DataFrame:
    """Notes from ``start`` (less epsilon) until before ``end`` with when, until, velocity and the tick in
    which the look-ahead books them. Muted hands are left out."""
    beat = 60 / tempo
    when = origin + (F.col("start") - start) * beat
    playing = notes.where((F.col("start") >= start - EPSILON) & (F.col("start") < end) & ~F.col("hand").isin(muted))
    return playing.withColumns(
        {
            "when": when,
            "until": when + F.greatest(F.lit(0.12), F.col("duration") * beat * 0.94),
            "velocity": F.when(F.col("hand") == "left", 0.62).otherwise(0.78),
            "batch": F.greatest(F.lit(0), F.ceil((when - LOOK_AHEAD) / TICK)).cast("long"),
        }
    )


def clicks(pages: DataFrame, tempo: Column, start: Column, end: Column, beats_per_measure: Column, count_in: Column, origin: float = 0.06) -> DataFrame:
    """page_id, kind, n, at, accent: count-in clicks before the start, then one on each whole beat before ``end``."""
    beat = 60 / tempo
    zero = origin + count_in * beat
    counts = pages.withColumn("n", F.explode(F.when(count_in > 0, F.sequence(F.lit(0), (count_in - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    counts = counts.select("page_id", F.lit("count-in").alias("kind"), F.col("n").cast("long").alias("n"), (zero - (count_in - F.col("n")) * beat).alias("at"), (F.col("n") == 0).alias("accent"))
    first, last = F.ceil(start - EPSILON), F.ceil(end) - 1
    metronome = pages.withColumn("n", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return counts.unionByName(
        metronome.select("page_id", F.lit("beat").alias("kind"), "n", (zero + (F.col("n") - start) * beat).alias("at"), (F.pmod(F.col("n"), beats_per_measure) == 0).alias("accent"))
    )


def looped(notes: DataFrame, loop_start: Column, loop_end: Column, times: int) -> DataFrame:
    """Notes inside the loop once for each repetition, with ``pass`` and ``at`` (beats from the first pass's start)."""
    inside = notes.where((F.col("start") >= loop_start - EPSILON) & (F.col("start") < loop_end))
    each = inside.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return each.withColumn("at", F.col("pass") * (loop_end - loop_start) + F.col("start") - loop_start)


def position(origin_beat: Column, elapsed: Column, tempo: Column) -> Column:
    return origin_beat + elapsed * tempo / 60


def beats_of(notes: DataFrame, step: float = 0.5) -> DataFrame:
    """page_id, beat: a grid over each page up to the end of its last note."""
    ends = notes.groupBy("page_id").agg(F.ceil(F.max(F.col("start") + F.col("duration")) / step).alias("__n"))
    return ends.select("page_id", F.explode(F.sequence(F.lit(0), F.col("__n"))).alias("__i")).select("page_id", (F.col("__i") * step).alias("beat"))


def stops_at(notes: DataFrame, tempo: Column, start: Column, origin: float = 0.06) -> DataFrame:
    """page_id, at: playing ends when the last note has rung for 0.35 s (``tempo`` is a column of ``notes``)."""
    end = F.max(origin + (F.col("start") + F.col("duration") - start) * 60 / tempo)
    return notes.groupBy("page_id").agg((end + 0.35).alias("at"))


def loop_at(bar: Column, bars: Column, beats: Column, length: Column) -> tuple[Column, Column]:
    """Start and end of a new loop: two bars from the one being played (counted from 0), within the score."""
    start = F.least(bar, bars - 1) * beats
    return start, F.least(start + beats * 2, length)


def loop_from(bar: Column, beats: Column, end: Column) -> tuple[Column, Column]:
    """The loop once its first bar (counted from 1) is set: a bar long at least."""
    start = (bar - 1) * beats
    return start, F.greatest(end, start + beats)


def loop_to(bar: Column, beats: Column, start: Column) -> tuple[Column, Column]:
    """The loop once its last bar (counted from 1) is set: a bar long at least."""
    end = bar * beats
    return F.least(start, end - beats), end


def starts_from(position: Column, end: Column, loop_start: Column) -> Column:
    """The beat that playing starts from: at the end, the loop's start (null without a loop: 0)."""
    return F.when(position >= end - EPSILON, F.coalesce(loop_start, F.lit(0.0))).otherwise(position)
