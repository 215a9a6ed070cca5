"""Blobs read as clefs, accidentals, barlines and rests, joined with their staves by page.

Blobs: page_id, blob_id, x0, y0, x1, y1 (inclusive), width, height, area. Staves: page_id, staff, top,
bottom, left, right, lines (array), index_in_system. ``space`` is the page's staff unit, a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import spaced


def centre(blobs: DataFrame) -> DataFrame:
    return blobs.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def nearest_staff(blobs: DataFrame, staves: DataFrame) -> DataFrame:
    """Each blob with the staves that no other staff of the page is closer to; ties keep both.

    Distances are vertical and taken to all staves of the page before the reach (4.5 spaces up or down, 2
    beyond the ends) is asked for."""
    off = F.when(F.col("cy") < F.col("top"), F.col("top") - F.col("cy")).when(F.col("cy") > F.col("bottom"), F.col("cy") - F.col("bottom")).otherwise(0.0)
    both = centre(blobs).join(staves, "page_id").withColumn("distance", off)
    both = both.withColumn("__r", F.rank().over(Window.partitionBy("page_id", "blob_id").orderBy("distance")))
    near = (F.col("distance") <= F.col("space") * 4.5) & F.col("cx").between(F.col("left") - F.col("space") * 2, F.col("right") + F.col("space") * 2)
    return both.where((F.col("__r") == 1) & near).drop("__r")


def fill(blobs: DataFrame) -> Column:
    return blobs["area"] / (blobs["width"] * blobs["height"])


def barlines(blobs: DataFrame, staves: DataFrame) -> DataFrame:
    """page_id, staff, x: tall thin full blobs across a staff, those too close to the last kept left out."""
    both = centre(blobs).join(staves, "page_id")
    tall = (
        (F.col("width") <= F.col("space") * 0.5)
        & (F.col("height") >= (F.col("bottom") - F.col("top")) * 0.82)
        & (F.col("y0") <= F.col("top") + F.col("space"))
        & (F.col("y1") >= F.col("bottom") - F.col("space"))
        & (F.col("area") / (F.col("width") * F.col("height")) >= 0.6)
    )
    return merged(both.where(tall).select("page_id", "staff", F.col("cx").alias("x"), "space"))


def merged(lines: DataFrame) -> DataFrame:
    """page_id, staff, x without those closer than 1.2 spaces to the last x kept."""
    kept = lines.groupBy("page_id", "staff").agg(spaced(F.array_sort(F.collect_list(F.col("x").cast("double"))), F.first("space") * 1.2).alias("xs"))
    return kept.select("page_id", "staff", F.explode("xs").alias("x"))


def clefs(blobs: DataFrame, staves: DataFrame) -> DataFrame:
    """page_id, staff, clef, clef_blob, header_end (of the clef alone): the tallest candidate, the leftmost on ties."""
    both = staves.join(blobs, "page_id")
    overlap = F.least(F.col("y1"), F.col("bottom")) - F.greatest(F.col("y0"), F.col("top"))
    candidate = (F.col("x0") >= F.col("left") - F.col("space")) & (F.col("x0") < F.col("left") + F.col("space") * 4.5) & (F.col("height") > F.col("space") * 1.8) & (overlap > F.col("space") * 1.4)
    order = Window.partitionBy("page_id", "staff").orderBy(F.desc("height"), "x0", "blob_id")
    best = both.where(candidate).withColumn("__n", F.row_number().over(order)).where("__n = 1").select("page_id", "staff", "blob_id", "height", "x1", "y0")
    joined = staves.join(best, ["page_id", "staff"], "left")
    default = F.when(F.col("index_in_system") == 0, "treble").otherwise("bass")
    shape = F.when(F.col("height") > F.col("space") * 5, "treble").when((F.col("height") < F.col("space") * 4.4) & (F.col("y0") < F.col("top") + F.col("space") * 1.5), "bass")
    return joined.select("page_id", "staff", F.coalesce(shape, default).alias("clef"), F.col("blob_id").alias("clef_blob"), F.coalesce(F.col("x1"), F.col("left") + F.col("space")).cast("double").alias("clef_end"))


def header_ends(blobs: DataFrame, staves: DataFrame, found: DataFrame) -> DataFrame:
    """page_id, staff, header_end: from the clef on over closely packed blobs of the page, wherever they stand.

    The chain is a fold over the page's blobs right of the clef: a gap over 1.1 spaces ends it, low blobs
    are passed over; the end is capped at 26 % of the staff."""
    cap = F.col("left") + (F.col("right") - F.col("left")) * 0.26
    both = staves.join(found, ["page_id", "staff"]).withColumn("cap", cap)
    right = both.join(blobs, "page_id").where((F.col("clef_blob").isNotNull()) & (F.col("x0") > F.col("clef_end")) & (F.col("x0") < F.col("cap")))
    item = F.struct(F.col("x0").cast("double").alias("x0"), "blob_id", F.col("x1").cast("double").alias("x1"), F.col("height").cast("double").alias("height"))
    chains = right.groupBy("page_id", "staff").agg(F.array_sort(F.collect_list(item)).alias("chain"))
    joined = both.join(chains, ["page_id", "staff"], "left")

    def step(acc: Column, b: Column) -> Column:
        over = acc["over"] | (b["x0"] - acc["end"] > F.col("space") * 1.1)
        grows = ~over & (b["height"] >= F.col("space") * 1.2)
        return F.struct(F.when(grows, F.greatest(acc["end"], b["x1"])).otherwise(acc["end"]).alias("end"), over.alias("over"))

    start = F.struct(F.col("clef_end").alias("end"), F.lit(False).alias("over"))
    end = F.aggregate(F.coalesce("chain", F.array().cast("array<struct<x0:double,blob_id:bigint,x1:double,height:double>>")), start, step, lambda acc: acc["end"])
    header = F.when(F.col("clef_blob").isNull(), F.col("clef_end")).otherwise(F.least(end + F.col("space") * 0.3, F.col("cap")))
    return joined.select("page_id", "staff", header.alias("header_end"))


def rests(blobs: DataFrame, staves: DataFrame, used: DataFrame, on: tuple[str, ...] = ("page_id",), key: tuple[str, ...] = ("page_id", "blob_id")) -> DataFrame:
    """page_id, staff, blob_id, cx, cy, base: blobs without noteheads (``used`` names those with, by ``key``), by size
    and place; the first rule wins."""
    both = centre(blobs.join(used, list(key), "left_anti")).join(staves, list(on))
    both = both.where(F.col("cy").between(F.col("top") - F.col("space"), F.col("bottom") + F.col("space")))
    w, h, full = F.col("width") / F.col("space"), F.col("height") / F.col("space"), F.col("area") / (F.col("width") * F.col("height"))
    within = lambda v, a, b: (v > a) & (v < b)
    to_whole = F.abs(F.col("cy") - (F.col("lines")[1] + F.col("space") * 0.25))
    to_half = F.abs(F.col("cy") - (F.col("lines")[2] - F.col("space") * 0.25))
    base = (
        F.when(within(w, 0.7, 2.2) & within(h, 0.22, 0.8) & (full > 0.7), F.when(to_whole <= to_half, 4.0).otherwise(2.0))
        .when(within(w, 0.4, 1.5) & within(h, 1.9, 3.4) & within(full, 0.2, 0.7), 1.0)
        .when(within(w, 0.4, 1.4) & within(h, 0.9, 1.9) & (full > 0.3), 0.5)
    )
    return both.withColumn("base", base).where("base is not null").select("page_id", "staff", "blob_id", "cx", "cy", "base")


def accidental_kind(width: Column, height: Column, top_width: Column, foot_width: Column, foot_centre: Column) -> Column:
    """sharp, flat or natural by the silhouette's top and foot; null for other proportions."""
    aspect = width / height
    kind = F.when((top_width > 0.7) & (foot_width > 0.7), "sharp").when(foot_centre < 0.5, "flat").otherwise("natural")
    return F.when(aspect.between(0.12, 0.75), kind)


def silhouette(ink: DataFrame, blobs: DataFrame) -> DataFrame:
    """page_id, blob_id, top_width, top_centre, foot_width, foot_centre: the relative width and centre of the
    ink in the top and bottom 14 % of each blob. ``ink`` has page_id, blob_id, x, y in blob coordinates."""
    both = ink.join(blobs.select("page_id", "blob_id", "width", "height"), ["page_id", "blob_id"])
    top, foot = F.col("y") < F.ceil(F.col("height") * 0.14), F.col("y") >= F.floor(F.col("height") * 0.86)
    edge = lambda f, rows: f(F.when(rows, F.col("x")))
    found = both.groupBy("page_id", "blob_id").agg(
        F.first("width").alias("w"), *(edge(f, r).alias(n) for n, f, r in (("tl", F.min, top), ("tr", F.max, top), ("fl", F.min, foot), ("fr", F.max, foot)))
    )
    wide = lambda a, b: F.coalesce((F.col(b) - F.col(a) + 1) / F.col("w"), F.lit(0.0))
    mid = lambda a, b: F.coalesce((F.col(a) + F.col(b)) / 2 / F.greatest(F.lit(1), F.col("w") - 1), F.lit(0.5))
    return found.select("page_id", "blob_id", wide("tl", "tr").alias("top_width"), mid("tl", "tr").alias("top_centre"), wide("fl", "fr").alias("foot_width"), mid("fl", "fr").alias("foot_centre"))


def accidentals(heads: DataFrame, blobs: DataFrame, on: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``heads`` (page_id, head_id, cx, cy, space) with ``kind``: the nearest accidental to the left, the
    smaller blob_id on ties, or null. ``blobs`` carry their kind."""
    b = blobs.where("kind is not null").select(*on, "blob_id", "x1", "y0", "y1", "width", "height", "kind")
    gap, off = F.col("cx") - F.col("x1"), F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("cy"))
    fits = gap.between(F.col("space") * 0.1, F.col("space") * 1.9) & F.col("height").between(F.col("space") * 1.2, F.col("space") * 3.2) & (F.col("width") <= F.col("space") * 1.05) & (off <= F.col("space") * 1.2)
    order = Window.partitionBy("page_id", "head_id").orderBy(gap, "blob_id")
    best = heads.join(b, list(on)).where(fits).withColumn("__n", F.row_number().over(order)).where("__n = 1").select("page_id", "head_id", "blob_id", "kind")
    return heads.join(best, ["page_id", "head_id"], "left")
