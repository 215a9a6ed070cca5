"""Connected components on tables in the shared folder: alternating large and small stars, or one task where the
links are few by count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, written


#: Links that one task joins by itself (16 bytes each); of more, every round is a shuffle.
TOGETHER = 500_000


def _joined(batches):
    """id, component of all links of one task, each link once."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([np.concatenate(c) for c in zip(*parts, strict=True)])
    ids, place = np.unique(ends, return_inverse=True)
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # Places follow the order of ids, so the smaller root is the smaller id.
    for u, v in zip(*place.reshape(2, -1).tolist(), strict=True):
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[[find(i) for i in range(len(ids))]])], names=["id", "component"])


def _least(edges: DataFrame) -> DataFrame:
    """u, least: the smallest of u and its neighbours (partial minima first, so a hub is no hot key)."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in ``links`` (columns a, b of any type that
    sorts), as a written table.

    Up to TOGETHER links of numbers go to one task. Of more, stars are joined with their minima rather than gathered, so that the join of a hub can be split.
    The rounds grow with the logarithm of the longest shortest path."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    if edges.schema["u"].dataType.simpleString() == "bigint" and edges.count() <= TOGETHER:
        found = written(edges.coalesce(1).mapInArrow(_joined, "id long, component long"), "components")
        discard(edges)
        return found
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        large = written(large, "cc-large")
        least = _least(large)
        small = large.join(least, "u")
        small = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        before, edges = edges, written(small.where("u <> v").distinct(), "cc-small")
        discard(before, large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    found = written(ids.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    discard(edges)
    return found
