"""Connected symbols: labelling over horizontal runs, boxes, and window statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .pixels import ink_runs
from .tables import written


def labelled_runs(ink: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, fixed (the row), from, to, first: runs with the smallest pixel number of their 8-connected symbol.

    ``ink`` is pixels."""
    return labelled(ink_runs(ink, "x"), pages)


def labelled(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """``labelled_runs`` of runs along rows (page_id, fixed, from, to, length).

    Runs are the vertices, far fewer than pixels; a run touches those of the next row within one column.
    Vertices of all pages go through one labelling; a vertex is named by its page and first pixel."""
    pixel = (F.col("fixed") * F.col("width") + F.col("from")).cast("long")
    runs = runs.join(pages.select("page_id", "width"), "page_id").withColumn("id", F.struct("page_id", pixel.alias("pixel")))
    runs = written(runs, "runs")
    below = runs.select("page_id", (F.col("fixed") - 1).alias("fixed"), F.col("from").alias("f"), F.col("to").alias("t"), F.col("id").alias("b"))
    touching = runs.join(below, ["page_id", "fixed"]).where((F.col("f") <= F.col("to") + 1) & (F.col("t") >= F.col("from") - 1))
    label = components(touching.select(F.col("id").alias("a"), "b"))
    joined = runs.join(label, "id", "left")
    return joined.select("page_id", "fixed", "from", "to", "length", F.coalesce("component", "id")["pixel"].alias("first"))


def blobs(runs: DataFrame, smallest: Column | None = None) -> DataFrame:
    """page_id, blob_id, first, x0, y0, x1, y1 (inclusive), width, height, area.

    Ids follow the raster order of the first pixels; symbols under ``smallest`` use up an id and are left out."""
    found = runs.groupBy("page_id", "first").agg(
        F.min("from").alias("x0"), F.min("fixed").alias("y0"), F.max("to").alias("x1"), F.max("fixed").alias("y1"), F.sum("length").alias("area")
    )
    found = found.withColumns(
        {
            "blob_id": (F.row_number().over(Window.partitionBy("page_id").orderBy("first")) - 1).cast("long"),
            "width": F.col("x1") - F.col("x0") + 1,
            "height": F.col("y1") - F.col("y0") + 1,
        }
    )
    return found if smallest is None else found.where(F.col("area") >= smallest)


def smallest_area(space: Column) -> Column:
    return F.greatest(F.lit(4), F.floor(space * space * 0.06 + 0.5))


def mask_totals(ink: DataFrame, blobs: DataFrame) -> DataFrame:
    """page_id, blob_id, x, y, total: each blob's own summed-area table, in blob coordinates.

    ``ink`` has page_id, blob_id, x, y in page coordinates."""
    boxes = blobs.select("page_id", "blob_id", "x0", "y0", F.explode(F.sequence(F.lit(0), (F.col("width") - 1).cast("int"))).alias("x"), "height")
    grid = boxes.select("page_id", "blob_id", "x0", "y0", "x", F.explode(F.sequence(F.lit(0), (F.col("height") - 1).cast("int"))).alias("y"))
    own = ink.join(blobs.select("page_id", "blob_id", "x0", "y0"), ["page_id", "blob_id"]).select("page_id", "blob_id", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), F.lit(1).alias("v"))
    dense = grid.join(own, ["page_id", "blob_id", "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    upto = (Window.unboundedPreceding, 0)
    across = F.sum("v").over(Window.partitionBy("page_id", "blob_id", "y").orderBy("x").rowsBetween(*upto))
    total = F.sum("__row").over(Window.partitionBy("page_id", "blob_id", "x").orderBy("y").rowsBetween(*upto))
    return dense.withColumn("__row", across).withColumn("total", total).select("page_id", "blob_id", "x", "y", "total")


def symbol_ink(runs: DataFrame, blobs: DataFrame) -> DataFrame:
    """page_id, blob_id, x, y: the ink of each symbol, opened from its runs."""
    own = runs.join(blobs.select("page_id", "first", "blob_id"), ["page_id", "first"])
    return own.select("page_id", "blob_id", F.explode(F.sequence("from", "to")).alias("x"), F.col("fixed").alias("y"))


def clipped(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """The half-open window of size w by h around a centre, edges rounded half up and held within the area."""
    edge = lambda c, half, most: F.least(most, F.greatest(F.lit(0), F.floor(c + half + 0.5))).cast("int")
    return {"wx0": edge(cx, -w / 2, width), "wy0": edge(cy, -h / 2, height), "wx1": edge(cx, w / 2, width), "wy1": edge(cy, h / 2, height)}


def window_fill(windows: DataFrame, totals: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``windows`` (keys, window_id, wx0, wy0, wx1, wy1 half-open, clipped) with sum, area and fill.

    Four equi-joined corners of the summed-area table (keys, x, y, total); an empty window is 0."""
    corner = lambda n, x, y: F.struct(F.lit(n).alias("sign"), (x - 1).alias("x"), (y - 1).alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("wx0", "wy0", "wx1", "wy1"))
    corners = windows.select(*keys, "window_id", F.explode(F.array(corner(1, x1, y1), corner(-1, x0, y1), corner(-1, x1, y0), corner(1, x0, y0))).alias("c"))
    sums = corners.select(*keys, "window_id", "c.sign", "c.x", "c.y").join(totals.select(*keys, "x", "y", "total"), [*keys, "x", "y"])
    sums = sums.groupBy(*keys, "window_id").agg(F.sum(F.col("sign") * F.col("total")).alias("sum"))
    area = F.greatest(F.lit(0), x1 - x0) * F.greatest(F.lit(0), y1 - y0)
    out = windows.join(sums, [*keys, "window_id"], "left").withColumn("area", area)
    out = out.withColumn("sum", F.when(F.col("area") > 0, F.coalesce("sum", F.lit(0))).otherwise(F.lit(0)))
    return out.withColumn("fill", F.coalesce(F.col("sum") / F.nullif("area", F.lit(0)), F.lit(0.0)))
