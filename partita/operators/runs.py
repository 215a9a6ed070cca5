"""Staff lines on runs of ink: row counts and line erasure as joins of intervals, without a row for any pixel.

Runs: page_id, fixed, from, to, length; along rows (``across``, fixed is y) or columns (``down``, fixed is x).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up

PIXEL_RUNS = "page_id", "fixed", "from", "to"


def scale(down: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, line_thickness, staff_space from the runs of ink down the columns; ``pixels.scale`` says the rules.

    White runs are the gaps between a column's runs of ink and the one above the first; a column without ink is
    white down to its end, which doesn't count."""
    column = Window.partitionBy("page_id", "fixed").orderBy("from")
    white = F.col("from") - F.coalesce(F.lag("to").over(column), F.lit(-1)) - 1
    each = down.withColumn("white", white).select("page_id", F.explode(F.array(F.struct(F.lit(1).alias("value"), F.col("length").cast("int").alias("length")), F.struct(F.lit(0).alias("value"), F.col("white").cast("int").alias("length")))).alias("r"))
    each = each.select("page_id", "r.*").where("length > 0 and length < case value when 1 then 64 else 128 end")
    histogram = each.groupBy("page_id", "value", "length").agg(F.count("*").alias("n"))
    best = lambda rows: rows.groupBy("page_id").agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("m"))
    thickness = pages.select("page_id").join(best(histogram.where("value = 1")), "page_id", "left").select("page_id", F.coalesce("m", F.lit(1)).cast("int").alias("line_thickness"))
    floor = F.greatest(F.lit(3), F.col("line_thickness") + 1)
    space = best(histogram.where("value = 0").join(thickness, "page_id").where(F.col("length") >= floor))
    return thickness.join(space, "page_id", "left").select("page_id", "line_thickness", F.coalesce("m", floor).cast("int").alias("staff_space"))


def row_projection(down: DataFrame, scale: DataFrame) -> DataFrame:
    """page_id, y, count, left, right of the ink in runs down the columns of at most 2.5 line thicknesses.

    Such a run meets few rows, a handful by the condition itself, so it is opened into them."""
    thin = down.join(scale, "page_id").where(F.col("length") <= F.col("line_thickness") * 2.5)
    rows = thin.select("page_id", F.col("fixed").alias("x"), F.explode(F.sequence("from", "to")).alias("y"))
    return rows.groupBy("page_id", "y").agg(F.count("*").alias("count"), F.min("x").alias("left"), F.max("x").alias("right"))


def without_lines(across: DataFrame, down: DataFrame, staves: DataFrame, scale: DataFrame) -> DataFrame:
    """Runs along rows less the staff lines: of a long run in the rows of a line only the columns stay whose own
    run is long. Both runs are those of the page as it was."""
    reach = F.greatest(F.lit(1), half_up(F.col("line_thickness") * 0.8))
    lines = staves.join(scale, "page_id").select("page_id", "line_thickness", "space", reach.alias("reach"), F.explode("lines").alias("line"))
    near = F.sequence(half_up(F.col("line") - F.col("reach")).cast("int"), half_up(F.col("line") + F.col("reach")).cast("int"))
    rows = lines.select("page_id", "line_thickness", "space", F.explode(near).alias("fixed")).groupBy("page_id", "fixed").agg(F.first("line_thickness").alias("line_thickness"), F.min("space").alias("space"))
    both = across.join(rows, ["page_id", "fixed"], "left")
    on_line = F.col("space").isNotNull() & (F.col("length") >= F.col("space") * 1.2)
    kept = both.where(~F.coalesce(on_line, F.lit(False))).select(*PIXEL_RUNS)
    long = both.where(on_line).select(*PIXEL_RUNS)
    # Columns that cross a line: their long runs, opened on the rows of lines alone.
    crossing = down.withColumnsRenamed({"fixed": "x", "from": "top", "to": "low"}).join(scale.select("page_id", "line_thickness"), "page_id").where(F.col("length") > F.col("line_thickness") * 2 + 1)
    crossing = crossing.select("page_id", "x", F.explode(F.sequence("top", "low")).alias("fixed")).join(rows.select("page_id", "fixed"), ["page_id", "fixed"])
    stay = long.join(crossing, ["page_id", "fixed"]).where(F.col("x").between(F.col("from"), F.col("to")))
    island = stay.withColumn("__i", F.col("x") - F.row_number().over(Window.partitionBy("page_id", "fixed", "from").orderBy("x")))
    rest = island.groupBy("page_id", "fixed", F.col("from").alias("of"), "__i").agg(F.min("x").alias("from"), F.max("x").alias("to"))
    return kept.unionByName(rest.select(*PIXEL_RUNS)).withColumn("length", F.col("to") - F.col("from") + 1)


def ink(across: DataFrame) -> DataFrame:
    """page_id, x, y of the pixels in runs along rows."""
    return across.select("page_id", F.explode(F.sequence("from", "to")).alias("x"), F.col("fixed").alias("y"))
