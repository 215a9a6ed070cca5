"""Mixing overlapping sources to target weights by min-cost flow.

Sources overlap where equal texts stand in several of them. A text's membership pattern is the set of its
sources; texts are aggregated by pattern. A pattern of several sources offers its texts' words once at no
cost, a second time at cost 1 and so on (convex costs of repetition), whichever of its sources takes them;
a source takes them through its own row of the text, each row at most MAX_USES times. Further copies of a
text within one source are repetitions from their first use on. Sources ask for their quotas. The cheapest
flow therefore serves a text to the source that needs it before any text is used twice. What flows from a
pattern to a source becomes whole uses of all its rows there plus a part that seeded hashes select; the
sources of a pattern select from adjoining parts of the hashes, so that they take different texts.

The flow's graph has one node for each pattern and one edge for each of its sources. Patterns come to the
driver, MAX_PATTERNS of them with the most words; texts of rarer patterns count as their sources' own, which
may repeat one of them earlier than need be, but drops nothing. Documents never come to the driver.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, last in
order; rows that repeat a doc_id, text and source share their fate; an empty table gives an empty result;
further columns are ignored, whatever their names; a document of several sources stands in one row for each.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, spread_join, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_USES = 3
WEIGHTS = (5.0, 2.0, 1.0)
BINS = 1 << 16
#: Hashes of texts and documents lie on a circle of this length.
CIRCLE = 1 << 48
#: Rounds that fill what the documents chosen so far leave open, each with documents that still fit.
ROUNDS = 6
MAX_PATTERNS = 100_000
#: Patterns of rows: the source's own texts, and further copies of a text within a source.
OWN, COPIES = 0, -1


def quotas(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, budget: float | None = None, most: int = MAX_USES) -> dict[str | None, float]:
    """Each source's target: its share of ``budget`` (all words) by weight, at most ``most`` times its
    size; what exceeds that is shared again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left = float(sum(sizes.values()) if budget is None else budget)
    target: dict[str | None, float] = {}
    open_ = list(order)
    while open_:
        per = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if per * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: per * weight[s] for s in open_}
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


class Supply(NamedTuple):
    """What rows of one pattern offer: words at each cost, and the most that each source can take."""

    levels: list[tuple[int, int]]  # (cost of a word, words), costs ascend
    most: dict  # source -> words


def route(supplies: list[Supply], room: dict) -> list[dict]:
    """The words that go from each supply to each source in a cheapest flow that fills what can be filled.

    As costs lie on the supplies alone, what they can give together is a polymatroid: opening one cost after
    the other and augmenting the flow to its maximum each time is optimal. Each maximum is found by blocking
    flows on layered graphs (Dinic), so the work hardly grows with the capacities."""
    room = dict(room)
    flow: list[dict] = [dict.fromkeys(s.most, 0) for s in supplies]
    takers: dict = {}
    for i, s in enumerate(supplies):
        for k in s.most:
            takers.setdefault(k, []).append(i)
    spare = [0] * len(supplies)
    for cost in sorted({c for s in supplies for c, _ in s.levels}):
        for i, s in enumerate(supplies):
            spare[i] += sum(n for c, n in s.levels if c == cost)
        while _augmented(supplies, flow, takers, spare, room):
            pass
    return flow


def _augmented(supplies: list[Supply], flow: list[dict], takers: dict, spare: list[int], room: dict) -> bool:
    """One blocking flow from supplies with words to spare to sources with room; whether there was any."""
    depth: dict[tuple, int] = {(0, i): 0 for i, n in enumerate(spare) if n > 0}
    queue, nearest = deque(depth), None
    while queue:
        kind, x = node = queue.popleft()
        if nearest is not None and depth[node] >= nearest:
            break
        if kind == 0:
            near = [(1, k) for k, n in supplies[x].most.items() if flow[x][k] < n]
        else:
            if room[x] > 0:
                nearest = depth[node]
                continue
            near = [(0, i) for i in takers[x] if flow[i][x] > 0]
        for y in near:
            if y not in depth:
                depth[y] = depth[node] + 1
                queue.append(y)
    if nearest is None:
        return False
    after = {n: iter([(1, k) for k in supplies[n[1]].most] if n[0] == 0 else [(0, i) for i in takers[n[1]]]) for n in depth}
    for start in [n for n, d in depth.items() if d == 0]:
        path = [start]
        while path and spare[start[1]] > 0:
            kind, x = path[-1]
            if kind == 1 and depth[path[-1]] == nearest and room[x] > 0:
                steps = list(zip(path[:-1], path[1:], strict=True))
                width = min([spare[start[1]], room[x], *(supplies[a].most[b] - flow[a][b] if u == 0 else flow[b][a] for (u, a), (_, b) in steps)])
                for (u, a), (_, b) in steps:
                    if u == 0:
                        flow[a][b] += width
                    else:
                        flow[b][a] -= width
                spare[start[1]] -= width
                room[x] -= width
                path = [start]
                after[start] = iter([(1, k) for k in supplies[start[1]].most])
                continue
            for y in after[path[-1]]:
                open_ = supplies[x].most[y[1]] - flow[x][y[1]] if kind == 0 else flow[y[1]][x]
                if open_ > 0 and depth.get(y) == depth[path[-1]] + 1 and depth[y] <= nearest:
                    path.append(y)
                    break
            else:
                depth[path.pop()] = -1
    return True


class Plan(NamedTuple):
    """How rows are told apart and what each cell (source label, pattern) of them gives."""

    repeated: DataFrame  # key, label, pattern, first, n: texts that stand in several rows
    cells: list[tuple]  # label, pattern, source_size, target, base, offset, cuts, pick
    seed: int


def _label(source: str) -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source)))


def _measures(source: str) -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {
        "doc_id": F.col("doc_id").cast("long"),
        "key": F.unhex(F.md5(text)),
        "label": _label(source),
        "size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"),
    }


def _placed(rows: DataFrame, plan_repeated: DataFrame, seed: int) -> DataFrame:
    """``rows`` (a struct ``m`` of _measures) with pattern and hash: which cell a row is in, and its place on the circle."""
    on = [F.col("m.key").alias("key"), F.col("m.label").alias("label")]
    known = spread_join(rows.select("*", *on), plan_repeated, ["key", "label"], "n", "left")
    first = F.col("first").isNull() | F.col("m.doc_id").eqNullSafe(F.col("first"))
    pattern = F.when(first, F.coalesce("pattern", F.lit(OWN))).otherwise(F.lit(COPIES))
    spot = F.when(first, F.xxhash64(F.lit(seed), "key")).otherwise(F.xxhash64(F.lit(seed), "m.doc_id"))
    return known.select(*rows.columns, pattern.alias("pattern"), F.pmod(spot, F.lit(CIRCLE)).alias("spot"))


def _bin(ticket: str = "ticket") -> Column:
    return F.floor(F.col(ticket) / (CIRCLE // BINS))


def _within(cuts: str, size: str, ticket: str) -> Column:
    """True where a row falls under one of its cell's cuts (largest size, first bin that stays out)."""
    return F.exists(cuts, lambda c: (F.col(size) <= c["most"]) & (_bin(ticket) < c["bin"]))


CELL = "label string, pattern int, __left long, __cuts array<struct<most: long, bin: long>>, __offset long"


def _select(rows: DataFrame, asked: dict[tuple, tuple[int, int]]) -> tuple[dict, dict, dict]:
    """The cuts, the pick and the words chosen of each cell, for ``asked`` words beyond an offset on the circle.

    The first round takes rows by ticket as long as they fit; each further round does so with the rows that
    are small enough for what is left. At last one ticket more is picked where going over by it comes nearer
    than stopping short. One row for each cell comes to the driver."""
    spark = rows.sparkSession
    cuts: dict = {c: [] for c in asked}
    left = {c: n for c, (n, _) in asked.items()}
    others = None
    for turn in range(ROUNDS):
        state = [(*c, left[c], cuts[c], asked[c][1]) for c in asked if left[c] > 0]
        if not state:
            break
        table = F.broadcast(spark.createDataFrame(state, CELL))
        ticket = F.pmod(F.col("spot") - F.col("__offset"), F.lit(CIRCLE)).alias("ticket")
        others = rows.where("size > 0").join(table, ["label", "pattern"]).select("label", "pattern", "size", "__left", "__cuts", ticket).where(~_within("__cuts", "size", "ticket"))
        now = others if turn == 0 else others.where(F.col("size") <= F.col("__left"))
        binned = now.groupBy("label", "pattern", "__left", _bin().alias("bin")).agg(F.sum("size").alias("size"))
        upto = F.sum("size").over(Window.partitionBy("label", "pattern").orderBy("bin"))
        fit = binned.withColumn("upto", upto).groupBy("label", "pattern", "__left").agg(
            F.coalesce(F.min(F.when(F.col("upto") > F.col("__left"), F.col("bin"))), F.lit(BINS)).alias("bin"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("__left"), F.col("upto"))), F.lit(0)).alias("got"),
        )
        before, grown = dict(left), False
        for r in fit.collect():
            c = (r["label"], r["pattern"])
            # A row that was chosen can't be met again: its cut covers it.
            cuts[c].append((1 << 62 if turn == 0 else before[c], r["bin"]))
            left[c] -= r["got"]
            grown |= r["got"] > 0
        if turn and not grown:
            break
    picks: dict = {}
    state = [(*c, n, cuts[c], asked[c][1]) for c, n in left.items() if n > 0]
    if state:
        table = F.broadcast(spark.createDataFrame(state, CELL))
        ticket = F.pmod(F.col("spot") - F.col("__offset"), F.lit(CIRCLE)).alias("ticket")
        open_ = rows.where("size > 0").join(table, ["label", "pattern"]).select("label", "pattern", "size", "__left", "__cuts", ticket).where(~_within("__cuts", "size", "ticket"))
        # Rows of one ticket are chosen together, so they count together.
        over = open_.groupBy("label", "pattern", "__left", "ticket").agg(F.sum("size").alias("size")).where("size < 2 * __left")
        near = over.groupBy("label", "pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("__left")).alias("gap"), "ticket", "size")).alias("x"))
        for r in near.collect():
            c = (r["label"], r["pattern"])
            picks[c] = r["x"]["ticket"]
            left[c] -= r["x"]["size"]
    return cuts, picks, {c: n - left[c] for c, (n, _) in asked.items()}


def _plan(rows: DataFrame, max_patterns: int, seed: int) -> tuple[Plan, DataFrame]:
    """The plan, from a written table of rows (a struct ``m`` of _measures); and the rows with their cells, written."""
    spark = rows.sparkSession
    flat = rows.select("m.*")
    held = flat.groupBy("key", "label").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.max("size").alias("size"))
    held = written(held, "mix-texts")
    texts = held.groupBy("key").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.sum("n").alias("rows"), F.max("size").alias("size")).where("rows > 1")
    texts = written(texts, "mix-repeated")
    found = texts.where(F.size("labels") > 1).groupBy("labels").agg(F.sum("size").alias("words")).orderBy(F.desc("words"), "labels").limit(max_patterns).collect()
    patterns = [tuple(r["labels"]) for r in found]  # pattern i + 1
    ids = F.broadcast(spark.createDataFrame([(list(p), i + 1) for i, p in enumerate(patterns)], "labels array<string>, pattern int"))
    repeated = held.join(texts.select("key", "labels"), "key").join(ids, "labels", "left")
    repeated = written(repeated.select("key", "label", F.coalesce("pattern", F.lit(OWN)).alias("pattern"), "first", "n"), "mix-copies")
    placed = written(_placed(rows, repeated, seed), "mix-placed")
    discard(held, texts)
    words = {(r["label"], r["pattern"]): r["size"] for r in placed.groupBy("m.label", "pattern").agg(F.sum("m.size").alias("size")).collect()}
    sizes: dict = {}
    for (label, _), n in words.items():
        sizes[label] = sizes.get(label, 0) + n
    name = lambda label: None if label == "n" else label[1:]
    target = quotas({name(s): n for s, n in sizes.items()})
    cells, flow = _flow(words, patterns, {s: round(target[name(s)]) for s in sizes})
    # Cells of patterns and copies select first; the sources' own texts make up for what whole documents miss there.
    small = placed.select("m.label", "m.size", "pattern", "spot")
    given: dict = {}
    base = {c: min(MAX_USES, flow[c] // words[c]) if words[c] else 0 for c in cells}
    asked = {c: (flow[c] - base[c] * words[c], offset) for c, offset in cells.items() if c[1] != OWN and base[c] < MAX_USES and flow[c] > base[c] * words[c]}
    cuts, picks, got = _select(small, asked)
    for c in cells:
        if c[1] != OWN:
            given[c[0]] = given.get(c[0], 0) + base[c] * words[c] + got.get(c, 0)
    asked = {}
    for c, offset in cells.items():
        if c[1] == OWN:
            want = max(0, min(MAX_USES * words[c], round(target[name(c[0])]) - given.get(c[0], 0)))
            base[c] = min(MAX_USES, want // words[c]) if words[c] else 0
            if want > base[c] * words[c]:
                asked[c] = (want - base[c] * words[c], offset)
    more = _select(small, asked)
    cuts, picks = cuts | more[0], picks | more[1]
    full = [(*c, sizes[c[0]], float(target[name(c[0])]), int(base[c]), offset, cuts.get(c, []), picks.get(c)) for c, offset in cells.items()]
    return Plan(repeated, full, seed), placed


def _flow(words: dict[tuple, int], patterns: list[tuple], room: dict) -> tuple[dict[tuple, int], dict[tuple, int]]:
    """The offset on the circle and the flow of each cell (label, pattern)."""
    supplies, of = [], []
    for (label, pattern), n in words.items():
        if pattern <= OWN:
            start = 0 if pattern == OWN else 1
            supplies.append(Supply([(start + k, n) for k in range(MAX_USES)], {label: MAX_USES * n}))
            of.append(pattern)
    for i, labels in enumerate(patterns):
        own = {s: words.get((s, i + 1), 0) for s in labels}
        once = max(own.values())
        supplies.append(Supply([(k, once) for k in range(MAX_USES * len(labels))], {s: MAX_USES * n for s, n in own.items()}))
        of.append(i + 1)
    cells, flow = {}, {}
    for pattern, supply, routed in zip(of, supplies, route(supplies, room), strict=True):
        at = 0.0
        for label, n in routed.items():
            if (label, pattern) in words:
                cells[label, pattern] = int(at % 1 * CIRCLE)
                flow[label, pattern] = n
                at += n / words[label, pattern] if words[label, pattern] else 0
    return cells, flow


def _with_uses(placed: DataFrame, plan: Plan) -> DataFrame:
    """``placed`` with source_size, target and uses; cells are at most one for each source and pattern."""
    spark = placed.sparkSession
    schema = "label string, pattern int, source_size long, target double, base int, offset long, cuts array<struct<most: long, bin: long>>, pick long"
    cells = F.broadcast(spark.createDataFrame(plan.cells, schema))
    joined = placed.withColumn("label", F.col("m.label")).join(cells, ["label", "pattern"], "left")
    joined = joined.withColumn("ticket", F.pmod(F.col("spot") - F.col("offset"), F.lit(CIRCLE))).withColumn("__size", F.col("m.size"))
    chosen = _within("cuts", "__size", "ticket") | F.coalesce(F.col("ticket") == F.col("pick"), F.lit(False))
    return joined.withColumn("uses", F.when(F.col("m.size") > 0, F.col("base") + chosen.cast("int")).otherwise(0).cast("int"))


def planned(docs: DataFrame, source: str = "source", seed: int = 7, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """row (a struct of all columns of ``docs``) and uses: how often the mix takes each row.

    The plan is made from a written table of sizes. Documents are shuffled only if more than BROADCAST texts
    stand in several rows, and then only by their texts' keys."""
    rows = written(docs.select(F.struct(*(c.alias(n) for n, c in _measures(source).items())).alias("m")), "mix-rows")
    plan, placed = _plan(rows, max_patterns, seed)
    discard(rows, placed)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*(c.alias(n) for n, c in _measures(source).items())).alias("m"))
    return _with_uses(_placed(whole, plan.repeated, seed), plan).select("row", "uses")


def mixed(docs: DataFrame, source: str = "source", seed: int = 7) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    taken = planned(docs, source, seed).where("uses > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("uses")))).select("row.*")


def mix(docs: DataFrame, source: str = "source", seed: int = 7, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, size, source_size, target, uses, taken: every row, how often the mix takes it and the words it takes."""
    rows = written(docs.select(F.struct(*(c.alias(n) for n, c in _measures(source).items())).alias("m")), "mix-rows")
    plan, placed = _plan(rows, max_patterns, seed)
    discard(rows)
    return _with_uses(placed, plan).select("m.doc_id", "m.size", "source_size", "target", "uses", (F.col("m.size") * F.col("uses")).alias("taken"))
