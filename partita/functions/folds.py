"""Anchored grouping: choices that depend on what was kept last, which windows can't express.

Each is a fold over one page's sorted array, inside the JVM. A page's arrays are small (tens to
hundreds of items); the work is spread by page.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def anchored_groups(sorted_items: Column, x: str, limit: Column, item_type: str) -> Column:
    """Array of structs (g, item): a new group starts where x is ``limit`` or more past its group's first x."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("g"), F.array().cast(f"array<struct<g:int,item:{item_type}>>").alias("out"))

    def step(acc: Column, item: Column) -> Column:
        new = acc["anchor"].isNull() | (item[x] - acc["anchor"] >= limit)
        g = acc["g"] + new.cast("int")
        anchor = F.when(new, item[x].cast("double")).otherwise(acc["anchor"])
        return F.struct(anchor.alias("anchor"), g.alias("g"), F.concat(acc["out"], F.array(F.struct(g.alias("g"), item.alias("item")))).alias("out"))

    return F.aggregate(sorted_items, start, step, lambda acc: acc["out"])


def spaced(sorted_xs: Column, limit: Column) -> Column:
    """The values that are ``limit`` or more past the last one kept; the first is kept."""
    start = F.array().cast("array<double>")
    return F.aggregate(sorted_xs, start, lambda acc, x: F.when((F.size(acc) > 0) & (x - F.element_at(acc, -1) < limit), acc).otherwise(F.concat(acc, F.array(x))))
