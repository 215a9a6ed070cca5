"""Partials of piano tones in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.music import midi_to_hz

PARTIALS = 7
STIFFNESS = 0.00035


def partials(notes: DataFrame, velocity: Column, sample_rate: float = 44_100.0) -> DataFrame:
    """``notes`` (midi, ...) exploded into partials: n, hz, level, decay, cents. Partials too high to sample are left out."""
    bright = F.least(F.lit(1.0), F.greatest(F.lit(0.25), 1.1 - (F.col("midi") - 21) / 120))
    n = F.col("n")
    hz = n * F.sqrt(1 + STIFFNESS * n * n) * midi_to_hz(F.col("midi"))
    level = velocity * F.pow(n.cast("double"), F.lit(-1.6)) * F.when(n == 1, 1.0).otherwise(bright) / 1.6
    decay = (1.2 + 26 * F.pow(F.lit(2.0), -(F.col("midi") - 21) / 16)) / F.pow(n.cast("double"), F.lit(0.62))
    cents = F.when(n == 1, 0.0).otherwise(F.when(n % 2 == 1, 1.5).otherwise(-1.5) * bright)
    each = notes.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(PARTIALS))))
    return each.withColumns({"hz": hz, "level": level, "decay": decay, "cents": cents}).where(F.col("hz") <= sample_rate / 2.2)


def strikes(notes: DataFrame, when: Column, until: Column, velocity: Column) -> DataFrame:
    """``notes`` with the times and levels of a struck key besides its partials.

    A partial rises until attack_until and falls from there with a quarter of its decay; at release_at, 30 ms
    after the strike at the earliest, it is damped with the constant release. The hammer is band-passed noise
    that fades out by hammer_until."""
    midi = F.col("midi")
    bright = F.least(F.lit(1.0), F.greatest(F.lit(0.25), 1.1 - (midi - 21) / 120))
    return notes.withColumns(
        {
            "attack_until": when + 0.004,
            "release_at": F.greatest(until, when + 0.03),
            "release": F.lit(0.08),
            "stop_at": when + 1.2 + 26 * F.pow(F.lit(2.0), -(midi - 21) / 16) + 0.4,
            "hammer_hz": F.least(4 * midi_to_hz(midi), F.lit(5200.0)),
            "hammer_level": velocity * 0.09 * bright,
            "hammer_until": when + 0.07,
        }
    )


def click_sounds(clicks: DataFrame) -> DataFrame:
    """``clicks`` (at, accent) with hz, level and until: square waves, higher and louder on an accent."""
    return clicks.withColumns(
        {"hz": F.when(F.col("accent"), 1600).otherwise(1100), "level": F.when(F.col("accent"), 0.13).otherwise(0.07), "until": F.col("at") + 0.045}
    )
