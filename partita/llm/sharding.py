"""K-d tree sharding: documents fall into shards of near equal bytes by recursive weighted median cuts.

A point is a distinct text, weighted by the bytes of all its copies, so that equal texts share a shard. Its
dimensions are metadata: size, language and source. A value's coordinate is its place in the order of all
values, by weight: the bytes of all smaller values before it, over all bytes. Points of one value are spread
over that value's part by a hash of their text, which only breaks ties between points of one value.

A node is cut across its widest dimension. Widths are compared on one scale, on which a dimension's values
over the whole table lie between 0 and 1: the logarithm of the size between the least and the greatest one,
the middle of its part for a language or a source. A width is the standard deviation of a node's values, by
weight; hashes have no say in it, and equal widths go to the first of size, language and source. The cut is
where the bytes on the left reach the left side's share; medians come from histograms that Spark sums,
refined twice.

Every text of up to a whole shard is a point of the tree. Those of more than a hundredth of a shard (at most
100 for each shard, a proven bound) are too coarse for equal sides: the cut sends them to their sides, and
the cut of the others moves along the same dimension until the sides are equal. Where the others are too few
for that, heavy texts nearest to the cut change sides. Only a text whose copies outweigh a whole shard (there
are fewer than shards) is spread over several, without a cut.

Defined cases: a null text has size 1 and is equal to the empty text; null languages and sources come
before all others; copies that differ in language or source have the least of each; repeated rows are
separate rows with the same place in the order; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, gapless, spread_join, written

BINS = 1024
REFINEMENTS = 2
HEAVY = 0.01
DIMS = ["size", "lang", "source"]


@dataclass
class Node:
    first: int  # its first shard
    leaves: int
    light: float = 0.0  # bytes of its light points
    heavy: list[int] = field(default_factory=list)  # its heavy points
    atoms: list[tuple[float, int]] = field(default_factory=list)  # pieces of texts above a shard: (bytes, index), heaviest first


def _deal(node: Node, weight: dict[int, float]) -> tuple[Node, Node, float]:
    """Two children with the pieces dealt, and the bytes of points that make the left side's share up."""
    left = node.leaves // 2
    points = node.light + sum(weight[i] for i in node.heavy)
    total = points + sum(w for w, _ in node.atoms)
    room = [total * left / node.leaves, total * (node.leaves - left) / node.leaves]
    sides: list[list[tuple[float, int]]] = [[], []]
    for w, i in node.atoms:
        side = 0 if room[0] >= room[1] else 1
        sides[side].append((w, i))
        room[side] -= w
    children = Node(node.first, left, atoms=sides[0]), Node(node.first + left, node.leaves - left, atoms=sides[1])
    return *children, max(0.0, min(points, room[0]))


def heavy_sides(places: list[tuple[float, float]], cut: float, target: float, light: float) -> tuple[list[bool], float]:
    """Which heavy points, as (coordinate, bytes), go left, and the light bytes that make ``target`` up.

    The cut decides; where ``light`` bytes can't make the rest up, points nearest to the cut change sides as long as
    that brings the left side nearer to its target."""
    left = [at < cut for at, _ in places]
    need = target - sum(w for (_, w), x in zip(places, left, strict=True) if x)
    for i in sorted(range(len(places)), key=lambda i: (abs(places[i][0] - cut), i)):
        w = places[i][1]
        if left[i] and need < 0 and w < -2 * need:
            left[i], need = False, need + w
        elif not left[i] and need > light and w < 2 * (need - light):
            left[i], need = True, need - w
    return left, max(0.0, min(light, need))


def _places(points: DataFrame, column: str, total: float) -> DataFrame:
    """value, n, start, share: each value's points and its part of 0..1, in the order of the values (nulls first).

    The values are sorted by range over all tasks; a task's values start where the tasks before it end."""
    values = points.groupBy(F.col(column).alias("value")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    values = written(values.orderBy(F.asc_nulls_first("value")).withColumn("task", F.spark_partition_id()), "shard-values")
    tasks = values.groupBy("task").agg(F.sum("weight").alias("w")).withColumn("before", F.sum("w").over(Window.orderBy("task")) - F.col("w"))
    within = F.sum("weight").over(Window.partitionBy("task").orderBy(F.asc_nulls_first("value"))) - F.col("weight")
    placed = values.withColumn("within", within).join(F.broadcast(tasks.select("task", "before")), "task")
    share = lambda c: c.cast("double") / F.lit(total)
    placed = written(placed.select("value", "n", share(F.col("before") + F.col("within")).alias("start"), share(F.col("weight")).alias("share")), "shard-places")
    discard(values)
    return placed


def _located(groups: DataFrame, total: float) -> DataFrame:
    """key, weight, n, at, pos: the points with their coordinates and their values on the scale of widths, written."""
    tie = F.xxhash64("key").cast("double") / (2.0**64) + 0.5
    least, most = groups.agg(F.min("size"), F.max("size")).first()
    low, extent = math.log(least or 1), math.log((most or 1) / (least or 1)) or 1.0
    points, used = groups.withColumns({"at": F.array().cast("array<double>"), "pos": F.array().cast("array<double>")}), []
    for d in DIMS:
        places = _places(groups, d, total)
        used.append(places)
        # A null value has no key to join on, and is told by a column of its own.
        keyed = places.select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("v"), F.col("value").isNull().alias("none"), F.col("n").alias("m"), "start", "share")
        points = points.withColumns({"v": F.coalesce(F.col(d).cast("string"), F.lit("")), "none": F.col(d).isNull()})
        value = (F.log("size") - low) / extent if d == "size" else F.col("start") + F.col("share") / 2
        points = spread_join(points, keyed, ["v", "none"], "m").withColumns({"at": F.concat("at", F.array(F.col("start") + F.col("share") * tie)), "pos": F.concat("pos", F.array(value))})
        points = points.drop("v", "none", "m", "start", "share")
    points = written(points.select("key", "weight", "n", "at", "pos"), "shard-points")
    discard(*used)
    return points


def _widest(points: DataFrame) -> list[tuple[int, int, float, float]]:
    """node, its widest dimension (from 1), and the least and greatest coordinate there; one row for each node."""
    each = range(len(DIMS))
    x = [F.col("pos")[d] for d in each]
    mean = [F.sum(x[d] * F.col("weight")) / F.sum("weight") for d in each]
    boxes = points.groupBy("node").agg(
        F.array(*(F.round(F.sum(x[d] * x[d] * F.col("weight")) / F.sum("weight") - mean[d] * mean[d], 12) for d in each)).alias("w"),
        *(e(F.col("at")[d]).alias(f"{c}{d}") for d in each for e, c in ((F.min, "lo"), (F.max, "hi"))),
    )
    dim = F.array_position("w", F.array_max("w")).cast("int")
    return [tuple(r) for r in boxes.select("node", dim.alias("dim"), *(F.element_at(F.array(*(F.col(f"{c}{d}") for d in each)), dim) for c in ("lo", "hi"))).collect()]


def _cuts(points: DataFrame, asked: list[tuple[int, int, float, float, float]]) -> dict[int, float]:
    """The cut of each node of ``asked``, as (node, dimension, least, greatest, target), that has points.

    A cut is where the bytes before it reach the target."""
    spark = points.sparkSession
    schema = "node int, dim int, lo double, hi double, target double, before double"
    known = {x[0]: (*x, 0.0) for x in asked}
    for _ in range(REFINEMENTS):
        ranges = spark.createDataFrame(list(known.values()), schema)
        step = (F.col("hi") - F.col("lo")) / BINS
        bins = (
            points.join(F.broadcast(ranges), "node")
            .withColumn("x", F.element_at("at", F.col("dim")))
            .where(F.col("x").between(F.col("lo"), F.col("hi")))
            .withColumn("bin", F.coalesce(F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("lo")) / F.nullif(step, F.lit(0.0)))), F.lit(0)))
            .groupBy("node", "dim", "lo", "hi", "target", "before", "bin")
            .agg(F.sum("weight").alias("weight"))
        )
        order = Window.partitionBy("node").orderBy("bin")
        upto = F.col("before") + F.sum("weight").over(order)
        # The bin in which the target falls: the last one that starts at or below it.
        found = (
            bins.withColumn("start", upto - F.col("weight"))
            .where(F.col("start") <= F.col("target"))
            .groupBy("node", "dim", "target")
            .agg(F.max_by(F.struct((F.col("lo") + F.col("bin") * step).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * step).alias("hi"), "start"), "bin").alias("x"))
            .select("node", "dim", "x.lo", "x.hi", "target", F.col("x.start").alias("before"))
        )
        known |= {r["node"]: tuple(r) for r in found.collect()}
    return {node: hi if target > before else lo for node, _, lo, hi, target, before in known.values()}


def kd_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row of ``docs`` in one of ``shards`` shards.

    ``slot`` numbers a shard's rows from 0 without gaps. What comes to the driver is one row for each
    node of the tree, for each heavy text and for each text above a shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.unhex(F.md5(text)).alias("key"),
            "lang",
            "source",
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.sum("size").alias("weight"), F.first("size").alias("size"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.count("*").alias("n"))
    groups = written(groups, "shard-texts")
    total, n_rows = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    leaf = total / shards
    giants = groups.where(F.col("weight") > leaf).select("key", "weight", "n").orderBy(F.desc("weight"), "key").collect() if total else []
    # A text that outweighs a shard falls into pieces of an eighth of it, or single rows.
    pieces = [min(-(-8 * int(w) // max(1, int(leaf))), n) for _, w, n in giants]
    atoms = sorted(((w / k, i) for i, ((_, w, _), k) in enumerate(zip(giants, pieces, strict=True)) for _ in range(k)), key=lambda x: (-x[0], x[1]))
    points = _located(groups.where(F.col("weight") <= leaf), max(1.0, float(total)))
    coarse = points.where(F.col("weight") > leaf * HEAVY).orderBy("key").collect()
    weight, at = {i: float(r["weight"]) for i, r in enumerate(coarse)}, {i: r["at"] for i, r in enumerate(coarse)}
    light = written(points.where(F.col("weight") <= leaf * HEAVY).withColumn("node", F.lit(0)), "shard-nodes")
    level = {0: Node(0, shards, total - sum(weight.values()) - sum(w for w, _ in atoms), list(weight), atoms)}
    done: list[tuple[int, Node]] = []
    while any(n.leaves > 1 for n in level.values()):
        done += [(i, n) for i, n in level.items() if n.leaves == 1]
        level = {i: n for i, n in level.items() if n.leaves > 1}
        split = {i: _deal(n, weight) for i, n in level.items()}
        heavies = [(*coarse[h], i) for i, n in level.items() for h in n.heavy]
        every = light.unionByName(spark.createDataFrame(heavies, light.schema)) if heavies else light
        widest = {i: x for i, *x in _widest(every.where(F.col("node").isin(list(level))))}
        cuts = _cuts(every, [(i, *x, split[i][2]) for i, x in widest.items()])
        asked = []
        for i, (a, b, target) in split.items():
            need = target
            if i in cuts and level[i].heavy:
                goes, need = heavy_sides([(at[h][widest[i][0] - 1], weight[h]) for h in level[i].heavy], cuts[i], target, level[i].light)
                for h, x in zip(level[i].heavy, goes, strict=True):
                    (a if x else b).heavy.append(h)
            a.light = min(level[i].light, need)
            b.light = level[i].light - a.light
            if i in widest:
                asked.append((i, *widest[i], a.light))
        # Heavy texts have their sides; the others are cut again where they make the sides equal.
        if heavies:
            cuts |= _cuts(light, asked)
        cut = spark.createDataFrame([(i, widest[i][0], c) for i, c in cuts.items()], "node int, dim int, cut double")
        right = F.element_at("at", F.col("dim")) >= F.col("cut")
        before, light = light, written(
            light.join(F.broadcast(cut), "node", "left").select(
                "key", "weight", "n", "at", "pos",
                F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + 1 + right.cast("int")).alias("node"),
            ),
            "shard-nodes",
        )
        discard(before)
        level = {2 * i + 1 + side: n for i, both in split.items() for side, n in enumerate(both[:2])}
    done += level.items()
    leaves = spark.createDataFrame([(i, n.first) for i, n in done], "node int, shard int")
    where = light.join(F.broadcast(leaves), "node").select("key", "shard")
    # The rows of heavy texts meet a table of their own, so that no text with many copies is a key of a shuffle.
    table = [(bytearray(k), -1, []) for k, _, _ in giants] + [(coarse[h]["key"], h, [n.first]) for _, n in done for h in n.heavy]
    apart = F.broadcast(spark.createDataFrame(table, "key binary, text int, shards array<int>"))
    placed = rows.join(apart, "key", "left_anti").join(where, "key")
    placed = placed.unionByName(rows.join(apart.where("text >= 0"), "key").withColumn("shard", F.col("shards")[0]).drop("text", "shards"))
    if giants:
        dealt: dict[int, list[int]] = {}
        for _, n in done:
            for _, i in n.atoms:
                dealt.setdefault(i, []).append(n.first)
        table = F.broadcast(spark.createDataFrame([(bytearray(k), i, sorted(dealt[i])) for i, (k, _, _) in enumerate(giants)], "key binary, text int, shards array<int>"))
        spread = written(rows.join(table, "key"), "shard-hot")
        order = [F.col("doc_id"), F.col("source"), F.col("lang")]
        nth = gapless(spread, "text", order, "nth", sum(n for _, _, n in giants))
        nth = nth.withColumn("shard", F.get("shards", F.pmod("nth", F.size("shards")).cast("int"))).drop("text", "shards", "nth")
        placed = placed.unionByName(nth)
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard"), "shard-placed")
    discard(rows, groups, light)
    return gapless(placed, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", n_rows)
