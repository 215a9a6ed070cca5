"""Staff lines, staves and systems from ink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from .pixels import with_run_length


def row_projection(ink: DataFrame, scale: DataFrame) -> DataFrame:
    """page_id, y, count, left, right of the ink whose vertical run is at most 2.5 line thicknesses."""
    thin = with_run_length(ink, "y", "run").join(scale, "page_id").where(F.col("run") <= F.col("line_thickness") * 2.5)
    return thin.groupBy("page_id", "y").agg(F.count("*").alias("count"), F.min("x").alias("left"), F.max("x").alias("right"))


def bands(projection: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, band, center, thickness, ink, left, right: runs of rows with enough ink, a third of the page's
    fullest row and 15 % of its width at least."""
    full = F.greatest(F.max("count").over(Window.partitionBy("page_id")) * 0.33, F.col("width") * 0.15)
    rows = projection.join(pages, "page_id").withColumn("__f", full).where(F.col("count") >= F.col("__f"))
    rows = rows.withColumn("__i", F.col("y") - F.row_number().over(Window.partitionBy("page_id").orderBy("y")))
    grouped = rows.groupBy("page_id", "__i").agg(
        (F.sum(F.col("y") * F.col("count")) / F.sum("count")).alias("center"), F.count("*").alias("thickness"), F.avg("count").alias("ink"),
        F.min("left").alias("left"), F.max("right").alias("right"),
    )
    return grouped.withColumn("band", F.row_number().over(Window.partitionBy("page_id").orderBy("center")) - 1).drop("__i")


def five_lines(found: DataFrame, scale: DataFrame) -> DataFrame:
    """page_id, staff, lines, top, bottom, left, right, space: greedy groups of five evenly spaced bands.

    Whether a band can start a staff is a window; which starts are taken is a fold over the page's bands
    (a start that is taken passes over the four bands after it)."""
    order = Window.partitionBy("page_id").orderBy("band")
    nexts = [F.lead("center", k).over(order) for k in range(1, 5)]
    wide = found.withColumns({f"c{k}": c for k, c in enumerate(nexts, 1)} | {"l": F.least("left", *(F.lead("left", k).over(order) for k in range(1, 5))), "r": F.greatest("right", *(F.lead("right", k).over(order) for k in range(1, 5)))})
    mean = (F.col("c4") - F.col("center")) / 4
    gaps = [F.col("c1") - F.col("center"), *(F.col(f"c{k}") - F.col(f"c{k - 1}") for k in range(2, 5))]
    even = F.lit(True)
    for g in gaps:
        even = even & (F.abs(g - mean) < mean * 0.35)
    joined = wide.join(scale, "page_id")
    good = F.coalesce(even & (mean > F.col("staff_space") * 0.55) & (mean < F.col("staff_space") * 2.2), F.lit(False))
    joined = joined.withColumn("__good", good)
    starts = F.transform(F.filter(F.array_sort(F.collect_list(F.struct("band", "__good"))), lambda b: b["__good"]), lambda b: b["band"])

    def step(acc: Column, band: Column) -> Column:
        return F.when((F.size(acc) > 0) & (band < F.element_at(acc, -1) + 5), acc).otherwise(F.concat(acc, F.array(band)))

    chosen = joined.groupBy("page_id").agg(starts.alias("__s")).select("page_id", F.posexplode(F.aggregate("__s", F.array().cast("array<int>"), step)).alias("staff", "band"))
    lines = F.array("center", "c1", "c2", "c3", "c4")
    return joined.join(chosen, ["page_id", "band"]).select(
        "page_id", "staff", lines.alias("lines"), F.col("center").alias("top"), F.col("c4").alias("bottom"), F.col("l").alias("left"), F.col("r").alias("right"), mean.alias("space")
    )


def systems(staves: DataFrame) -> DataFrame:
    """``staves`` with ``system`` and ``index_in_system``: two staves at most, parted where the gap is wide.

    The page's dividing gap: nine spaces if there is one gap; half way between its smallest and largest if
    they differ enough; none otherwise. Pairing depends on how full the system is, so it is a fold."""
    order = Window.partitionBy("page_id").orderBy("staff")
    gaps = staves.withColumn("gap", F.col("top") - F.lag("bottom").over(order))
    page = gaps.groupBy("page_id").agg(
        F.count("gap").alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.first("space").alias("s"),
        F.array_sort(F.collect_list(F.struct("staff", "gap"))).alias("all"),
    )
    split = F.when(F.col("n") == 1, F.col("s") * 9).when((F.col("n") > 1) & (F.col("hi") > F.col("lo") * 1.6), (F.col("lo") + F.col("hi")) / 2).otherwise(F.lit(float("inf")))
    start = F.struct(F.lit(-1).alias("system"), F.lit(2).alias("held"), F.array().cast("array<struct<staff:int,system:int,index:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = (acc["held"] >= 2) | (s["gap"] > F.col("split"))
        system = acc["system"] + new.cast("int")
        index = F.when(new, 0).otherwise(acc["held"])
        return F.struct(system.alias("system"), (index + 1).alias("held"), F.concat(acc["out"], F.array(F.struct(s["staff"].alias("staff"), system.alias("system"), index.alias("index")))).alias("out"))

    placed = page.withColumn("split", split).select("page_id", F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("e"))
    return staves.join(placed.select("page_id", "e.staff", "e.system", F.col("e.index").alias("index_in_system")), ["page_id", "staff"])


def without_lines(ink: DataFrame, staves: DataFrame, scale: DataFrame) -> DataFrame:
    """Ink less the staff lines: in the rows of a line, pixels of short vertical and long horizontal runs go.

    Both runs are those of the page as it was."""
    long = with_run_length(with_run_length(ink, "y", "down"), "x", "along")
    reach = F.greatest(F.lit(1), half_up(F.col("line_thickness") * 0.8))
    rows = staves.join(scale, "page_id").select("page_id", "line_thickness", "space", reach.alias("reach"), F.explode("lines").alias("line"))
    near = F.sequence(half_up(F.col("line") - F.col("reach")).cast("int"), half_up(F.col("line") + F.col("reach")).cast("int"))
    rows = rows.select("page_id", "line_thickness", "space", F.explode(near).alias("y"))
    gone = (F.col("down") <= F.col("line_thickness") * 2 + 1) & (F.col("along") >= F.col("space") * 1.2)
    erased = long.join(rows, ["page_id", "y"]).where(gone).select("page_id", "x", "y").distinct()
    return ink.join(erased, ["page_id", "x", "y"], "left_anti")
