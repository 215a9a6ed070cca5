"""Noteheads, stems, beams and dots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from .components import clipped, window_fill


def suppressed(hits: DataFrame, keys: tuple[str, ...] = ("page_id", "blob_id")) -> DataFrame:
    """``keys``, cx, cy, score, rank: hits that no better kept hit of the same keys (a blob, or a staff's view of
    it) is close to.

    Hits go by score, then from top to bottom and left to right; a hit is close within 0.8 spaces across and
    0.6 down. What was itself blocked blocks nothing, so this is a fold over the blob's sorted hits. ``shaped``
    is asked for after the clash, so a hit that fails it blocks nothing either."""
    item = F.struct((-F.col("score")).alias("o"), "cy", "cx", "shaped")
    start = F.array().cast("array<struct<o:double,cy:double,cx:double>>")
    S = F.col("space")

    def step(acc: Column, h: Column) -> Column:
        clash = F.exists(acc, lambda k: (F.abs(k["cx"] - h["cx"]) < S * 0.8) & (F.abs(k["cy"] - h["cy"]) < S * 0.6))
        return F.when(clash | ~h["shaped"], acc).otherwise(F.concat(acc, F.array(F.struct(h["o"].alias("o"), h["cy"].alias("cy"), h["cx"].alias("cx")))))

    grouped = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"), F.first("space").alias("space"))
    kept = grouped.select(*keys, F.posexplode(F.aggregate("all", start, step)).alias("rank", "k"))
    return kept.select(*keys, "k.cx", "k.cy", (-F.col("k.o")).alias("score"), "rank")


def _span(factor: float, least: int = 0) -> Column:
    """A length in staff spaces as whole pixels, ``least`` at least."""
    return F.greatest(F.lit(least), half_up(F.col("space") * factor)).cast("int")


def _fills(probes: DataFrame, totals: DataFrame, w: Column, h: Column, name: str) -> DataFrame:
    """``probes`` (page_id, blob_id, window_id, px, py in page coordinates, x0, y0, width, height) with the sum,
    area and fill of a window around each, clipped to its blob."""
    # The centre is rounded with the window in page coordinates, as blobs start at whole pixels.
    box = clipped(F.col("px") - F.col("x0"), F.col("py") - F.col("y0"), w, h, F.col("width"), F.col("height"))
    found = window_fill(probes.withColumns(box), totals, ("page_id", "blob_id"))
    return found.drop("wx0", "wy0", "wx1", "wy1").withColumnsRenamed({"sum": f"{name}_sum", "area": f"{name}_area", "fill": f"{name}_fill"})


def candidates(blobs: DataFrame, totals: DataFrame) -> DataFrame:
    """``blobs`` (with space, y_min, y_max) opened into centres whose ring is inked: px, py, score, filled.

    The ring is an outer window less an inner one; centres keep half an outer window from the blob's box."""
    ow, oh, iw, ih = _span(0.95, 3), _span(0.68, 2), _span(0.42, 1), _span(0.26, 1)
    half_w, half_h = F.floor(ow / 2), F.floor(oh / 2)
    ends = {
        "ya": F.greatest(F.col("y0") + half_h, half_up(F.col("y_min"))), "yb": F.least(F.col("y1") - half_h, half_up(F.col("y_max"))),
        "xa": F.col("x0") + half_w, "xb": F.col("x1") - half_w,
    }
    room = blobs.withColumns(ends).where("ya <= yb and xa <= xb")
    each = room.withColumn("py", F.explode(F.sequence("ya", "yb"))).withColumn("px", F.explode(F.sequence("xa", "xb"))).drop(*ends)
    each = each.withColumn("window_id", F.col("py") * 100_000 + F.col("px"))
    both = _fills(_fills(each, totals, ow, oh, "outer"), totals, iw, ih, "inner")
    ring = F.col("outer_area") - F.col("inner_area")
    both = both.where((F.col("outer_area") > 0) & (ring > 0)).withColumn("score", (F.col("outer_sum") - F.col("inner_sum")) / ring)
    filled = F.when(F.col("inner_area") == 0, True).otherwise(F.col("inner_fill") > 0.6)
    return both.where(F.col("score") >= 0.72).withColumn("filled", filled).drop(*(f"{n}_{c}" for n in ("outer", "inner") for c in ("sum", "area", "fill")))


def shaped(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with ``shaped``: a filled one is about a head wide, a hollow one has ink on both sides of its hole."""
    key = ["page_id", "blob_id", "window_id"]
    limit = _span(2.3)
    sides = found.where("filled").withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("d", F.explode(F.sequence(F.lit(1), limit)))
    walk = sides.withColumns({"px": F.col("px") + F.col("side") * F.col("d"), "centre": F.col("window_id"), "window_id": F.col("window_id") * 1000 + F.col("d") * 2 + (F.col("side") > 0).cast("int")})
    walk = _fills(walk, totals, F.lit(1), _span(0.5, 1), "column").groupBy("page_id", "blob_id", "centre", "side", "space").agg(F.min(F.when(F.col("column_fill") < 0.6, F.col("d"))).alias("stop"))
    wide = walk.groupBy("page_id", "blob_id", F.col("centre").alias("window_id"), "space").agg((1 + F.sum(F.coalesce("stop", limit + 1) - 1)).alias("extent"))
    wide = wide.select(*key, F.col("extent").between(F.col("space") * 0.85, F.col("space") * 2.0).alias("wide"))
    rims = found.where("not filled").withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    rims = rims.withColumns({"px": F.col("px") + F.col("side") * F.col("space") * 0.42, "centre": F.col("window_id"), "window_id": F.col("window_id") * 2 + (F.col("side") > 0).cast("int")})
    rims = _fills(rims, totals, _span(0.14, 1), _span(0.26, 1), "rim").groupBy("page_id", "blob_id", F.col("centre").alias("window_id")).agg(F.min((F.col("rim_fill") > 0.6).cast("int")).alias("rim"))
    both = found.join(wide, key, "left").join(rims, key, "left")
    return both.withColumn("shaped", F.when(F.col("filled"), F.coalesce("wide", F.lit(False))).otherwise(F.coalesce(F.col("rim") == 1, F.lit(False)))).drop("wide", "rim")


def _column_ink(windows: DataFrame, ink: DataFrame, keys: list[str]) -> DataFrame:
    """Ink pixels inside ``windows`` (page_id, xa, xb, ya, yb inclusive): windows are opened into their columns, so
    page and column are an equi-join and the rows a range within it."""
    opened = windows.where("xa <= xb").withColumn("x", F.explode(F.sequence(F.col("xa").cast("int"), F.col("xb").cast("int"))))
    return opened.join(ink, ["page_id", "x"]).where(F.col("y").between(F.col("ya"), F.col("yb"))).select("page_id", *keys, "x", "y")


def stems(heads: DataFrame, ink: DataFrame) -> DataFrame:
    """page_id, head_id, stem (up, down or null), stem_x, tip: the longer of the stems on either side.

    Up leaves on the right, down on the left: the first column with the most ink from 0.3 to four spaces off
    the centre counts if it holds 1.9 spaces. The tip is walked to over gaps of 0.4 spaces. Ties go up."""
    S, cx, cy, near, reach = F.col("space"), F.col("cx"), F.col("cy"), _span(0.3), _span(4.0)
    up = F.struct(F.lit("up").alias("stem"), F.lit(-1).alias("step"), half_up(cx + S * 0.25).alias("xa"), half_up(cx + S * 0.85).alias("xb"), (cy - reach).alias("ya"), (cy - near).alias("yb"))
    down = F.struct(F.lit("down").alias("stem"), F.lit(1).alias("step"), half_up(cx - S * 0.85).alias("xa"), half_up(cx - S * 0.25).alias("xb"), (cy + near).alias("ya"), (cy + reach).alias("yb"))
    windows = heads.select("page_id", "head_id", "space", "cy", F.explode(F.array(up, down)).alias("w")).select("page_id", "head_id", "space", "cy", "w.*")
    key = ["head_id", "stem", "step", "space", "cy"]
    columns = _column_ink(windows, ink, key).groupBy("page_id", *key, "x").agg(F.count("*").alias("n"))
    order = Window.partitionBy("page_id", "head_id", "stem").orderBy(F.desc("n"), "x")
    best = columns.withColumn("__n", F.row_number().over(order)).where("__n = 1").where(F.col("n") >= S * 1.9).drop("__n", "n")
    rows = best.join(ink, ["page_id", "x"]).withColumn("d", (F.col("y") - F.col("cy")) * F.col("step")).where("d >= 0")
    along = Window.partitionBy("page_id", "head_id", "stem").orderBy("d")
    gap = F.col("d") - F.coalesce(F.lag("d").over(along), F.lit(-1)) - 1
    rows = rows.withColumn("gap", gap).withColumn("broken", F.sum((F.col("gap") > _span(0.4, 2)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    tips = best.join(rows.where("broken = 0").groupBy("page_id", "head_id", "stem").agg(F.max("d").alias("d")), ["page_id", "head_id", "stem"], "left")
    tips = tips.withColumn("d", F.coalesce("d", F.lit(0)))
    longest = Window.partitionBy("page_id", "head_id").orderBy(F.desc("d"), "step")
    chosen = tips.withColumn("__n", F.row_number().over(longest)).where("__n = 1")
    chosen = chosen.select("page_id", "head_id", "stem", F.col("x").alias("stem_x"), (F.col("cy") + F.col("step") * F.col("d")).alias("tip"))
    return heads.select("page_id", "head_id").join(chosen, ["page_id", "head_id"], "left")


def beams(found: DataFrame, ink: DataFrame) -> DataFrame:
    """page_id, head_id, beams of ``found`` (stems with space): on the stem's fuller side (right on ties), bands of
    rows that are inked over 0.55 of the width."""
    S = F.col("space")
    up = F.col("stem") == "up"
    rows = {"ya": F.when(up, F.col("tip") - _span(0.25)).otherwise(F.col("tip") - _span(2.6)), "yb": F.when(up, F.col("tip") + _span(2.6)).otherwise(F.col("tip") + _span(0.25))}
    stemmed = found.where("stem is not null").withColumns(rows).withColumn("sign", F.explode(F.array(F.lit(1), F.lit(-1))))
    at = lambda f: F.col("stem_x") + F.col("sign") * _span(f)
    wide = stemmed.withColumns({"xa": F.least(at(0.3), at(1.1)), "xb": F.greatest(at(0.3), at(1.1))})
    sides = _column_ink(wide, ink, ["head_id", "sign"]).groupBy("page_id", "head_id", "sign").agg(F.count("*").alias("n"))
    order = Window.partitionBy("page_id", "head_id").orderBy(F.desc(F.coalesce("n", F.lit(0))), F.desc("sign"))
    side = wide.join(sides, ["page_id", "head_id", "sign"], "left").withColumn("__n", F.row_number().over(order)).where("__n = 1")
    side = side.withColumns({"xa": F.least(at(0.3), at(1.0)), "xb": F.greatest(at(0.3), at(1.0))}).withColumn("w", F.col("xb") - F.col("xa") + 1)
    inked = _column_ink(side, ink, ["head_id", "space", "w"]).groupBy("page_id", "head_id", "space", "w", "y").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("w") * 0.55)
    return found.select("page_id", "head_id").join(beam_bands(inked), ["page_id", "head_id"], "left").select("page_id", "head_id", F.coalesce("beams", F.lit(0)).alias("beams"))


def dotted(heads: DataFrame, totals: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, head_id of the heads with a dot: some point right of the head is solid in a small window and not
    in a larger one. Windows count their whole area, page or not; ``totals`` is the page's summed-area table."""
    half = _span(0.14, 1)
    around = F.greatest(half + 2, _span(0.45)).cast("int")
    points = heads.join(pages.select("page_id", F.col("width").alias("pw"), F.col("height").alias("ph")), "page_id")
    points = points.withColumn("px", F.explode(F.sequence(half_up(F.col("cx") + F.col("space") * 0.7), half_up(F.col("cx") + F.col("space") * 1.8))))
    points = points.withColumn("dy", F.explode(F.sequence(-_span(0.62), _span(0.62)))).withColumn("py", F.col("cy") + F.col("dy"))
    points = points.withColumn("window_id", (F.col("head_id") * 1_000_000 + F.col("px")) * 1000 + F.col("dy") + 500)


    def share(frame: DataFrame, r: Column, name: str) -> DataFrame:
        hold = lambda v, most: F.least(most, F.greatest(F.lit(0), v)).cast("int")
        box = {"wx0": hold(F.col("px") - r, F.col("pw")), "wx1": hold(F.col("px") + r + 1, F.col("pw")), "wy0": hold(F.col("py") - r, F.col("ph")), "wy1": hold(F.col("py") + r + 1, F.col("ph"))}
        out = window_fill(frame.withColumns(box), totals).withColumn(name, F.col("sum") / F.pow(2 * r + 1, F.lit(2)))
        return out.drop("wx0", "wx1", "wy0", "wy1", "sum", "area", "fill")

    solid = share(points, half, "small").where("small >= 0.75")
    return share(solid, around, "large").where("large < 0.5").select("page_id", "head_id").distinct()


def beam_bands(rows: DataFrame) -> DataFrame:
    """page_id, head_id, beams: bands of enough inked rows (0.22 spaces, a row at least), four at most.

    ``rows`` are the rows beside a stem that are inked over 0.55 of the width: page_id, head_id, y, space."""
    island = rows.withColumn("__i", F.col("y") - F.row_number().over(Window.partitionBy("page_id", "head_id").orderBy("y")))
    found = island.groupBy("page_id", "head_id", "__i").agg(F.count("*").alias("n"), F.first("space").alias("space"))
    thick = F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("space") * 0.22 + 0.5))
    return found.groupBy("page_id", "head_id").agg(F.least(F.lit(4), F.sum(thick.cast("int"))).cast("int").alias("beams"))
