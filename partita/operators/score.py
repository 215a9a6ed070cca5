"""Editing scores: many scores at once, every operation gives new relations.

Notes: page_id, id, midi, start, duration, hand, confidence, measure, diatonic, explicit_alter.
Scores: page_id, measures (count), beats, and whatever else; detections: page_id, note_id and a box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music
from ..functions.rounding import half_up

NOTE = ["page_id", "id", "midi", "start", "duration", "hand", "confidence", "measure", "diatonic", "explicit_alter"]


def ordered(notes: DataFrame) -> DataFrame:
    """``notes`` with ``position``: the place by start, then pitch, then ``emit_seq`` (stable)."""
    return notes.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy("start", "midi", "emit_seq")) - 1)


def lengths(notes: DataFrame, scores: DataFrame) -> DataFrame:
    """``scores`` with ``length``: the last note's end, or the measures' end if that is later."""
    ends = notes.groupBy("page_id").agg(F.max(F.col("start") + F.col("duration")).alias("__end"))
    length = F.greatest(F.coalesce("__end", F.lit(0.0)), F.col("measures") * F.col("beats"))
    return scores.join(ends, "page_id", "left").withColumn("length", length.cast("double")).drop("__end")


def patch(notes: DataFrame, patches: DataFrame) -> DataFrame:
    """Non-null fields of ``patches`` (page_id, id, ...) replace a note's; a patched note is certain.

    ``measure`` stays even where the start moves, unless the patch names it."""
    fields = [c for c in patches.columns if c not in ("page_id", "id")]
    new = patches.select("page_id", "id", F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in fields))
    joined = notes.join(new, ["page_id", "id"], "left")
    hit = F.col("__hit").isNotNull()
    changed = {c: F.coalesce(f"__{c}", c) for c in fields} | {"confidence": F.when(hit, F.lit(1.0)).otherwise(F.col("confidence"))}
    return joined.withColumns(changed).select(*notes.columns)


def delete(notes: DataFrame, detections: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and detections without the given (page_id, id)."""
    return notes.join(ids, ["page_id", "id"], "left_anti"), detections.join(ids.withColumnRenamed("id", "note_id"), ["page_id", "note_id"], "left_anti")


def add(notes: DataFrame, added: DataFrame, beats: Column) -> DataFrame:
    """``added`` (page_id, id, midi, start, hand) becomes notes of one beat, certain and in their measure."""
    none = F.lit(None).cast("int")
    made = added.select(
        "page_id", "id", "midi", "start", F.lit(1.0).alias("duration"), "hand", F.lit(1.0).alias("confidence"),
        F.floor(F.col("start") / beats).cast("int").alias("measure"), none.alias("diatonic"), none.alias("explicit_alter"),
    )
    return notes.select(*NOTE).unionByName(made)


def nudge(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (page_id, id, semitones) within the keyboard; a moved note loses its spelling and is certain."""
    joined = notes.join(moves, ["page_id", "id"], "left")
    hit, none = F.col("semitones").isNotNull(), F.lit(None).cast("int")
    midi = F.least(F.lit(music.HIGHEST), F.greatest(F.lit(music.LOWEST), F.col("midi") + F.col("semitones")))
    return joined.withColumns(
        {
            "midi": F.when(hit, midi.cast("int")).otherwise(F.col("midi")),
            "diatonic": F.when(hit, none).otherwise(F.col("diatonic")),
            "explicit_alter": F.when(hit, none).otherwise(F.col("explicit_alter")),
            "confidence": F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")),
        }
    ).select(*notes.columns)


def rekey(notes: DataFrame, fifths: Column) -> DataFrame:
    """Notes read off the staff without a written accidental take the new key's alteration; others stay."""
    moves = F.col("diatonic").isNotNull() & F.col("explicit_alter").isNull()
    midi = music.diatonic_to_midi(F.col("diatonic"), music.key_alteration(fifths, music.letter_of(F.col("diatonic"))))
    return notes.withColumn("midi", F.when(moves, midi).otherwise(F.col("midi")))


def pitch_range(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, low, high: the pitches with a margin, two octaves at least, within the keyboard; 48..84 if empty."""
    found = notes.groupBy("page_id").agg(F.min("midi").alias("lo"), F.max("midi").alias("hi"))
    pad = F.greatest(F.lit(0), 24 - (F.col("hi") - F.col("lo"))) / 2
    low = F.greatest(F.lit(music.LOWEST), half_up(F.col("lo") - pad - 2))
    high = F.least(F.lit(music.HIGHEST), half_up(F.col("hi") + pad + 2))
    empty = F.col("lo").isNull()
    bounds = [F.when(empty, none).otherwise(v).cast("int").alias(c) for c, v, none in (("low", low, 48), ("high", high, 84))]
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", *bounds)
