"""Nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

Vectors are scaled into the unit ball and get one more component that puts them on the sphere, so the
largest inner product is the smallest angle. A table turns them by fast Hadamard pseudo-rotations
(three rounds of random signs and a Walsh-Hadamard transform) and takes the nearest signed axis; once the
rows outnumber the axes, a second rotation's first axes refine the code, so that a bucket holds about
BUCKET vectors at any size. A query probes each table's nearest codes. Whatever shares a bucket with a
probe is compared exactly, in double precision, inside the bucket's task, and only each query's best
leave it.

Equal vectors are one entry with the smallest of their ids (one more than are asked for, which is all
that can ever be returned). Buckets with more than BLOCK entries or probes are dealt over several tasks,
each block of probes meeting each block of entries, so nothing is capped.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do those whose length is not the commonest; null ids take no part; rows that repeat an id and its vector
count once; ties go to the smaller id; with fewer candidates than asked for all are returned; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, written
from .near_dedup import _groups as whole_groups

TABLES = 16
#: Recall that the number of probes is chosen for, on SAMPLE queries whose true neighbours are searched
#: exhaustively; no more than MOST_PROBES codes of a table are ranked.
TARGET = 0.96
SAMPLE = 64
MOST_PROBES = 1 << 15
BUCKET = 48
BLOCK = 4096
NEAREST = 20
#: Rows that a task keeps before it leaves out those that can't be among a query's nearest.
HELD = 1 << 20
#: Queries of a group that are multiplied at once.
SLICE = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hashing:
    """The rotations of all tables and how codes are formed, from the vectors' length, number and longest norm."""

    def __init__(self, dim: int, rows: int, longest: float, tables: int = TABLES, bucket: int = BUCKET, seed: int = 5):
        self.dim, self.longest, self.tables = dim, longest, tables
        self.width = 1 << max(1, int(dim).bit_length())  # room for one more component
        codes = max(2, rows // bucket)
        self.first = min(self.width, max(1, codes // 2))  # axes that the first rotation offers
        self.second = min(self.width, -(-codes // (4 * self.width))) if codes > 2 * self.width else 0
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 2, 3, self.width))

    def lift(self, v: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(v), self.width))
        out[:, : self.dim] = v / (np.linalg.norm(v, axis=1, keepdims=True) if query else self.longest)
        if not query:
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (out**2).sum(axis=1)))
        return out

    def turned(self, x: np.ndarray, table: int, part: int) -> np.ndarray:
        for signs in self.signs[table, part]:
            x = hadamard(x * signs)
        return x

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The ``n`` nearest codes of each lifted row, nearest first (-1: there are no more)."""
        a = self.turned(x, table, 0)[:, : self.first]
        a = np.concatenate([a, -a], axis=1)
        top = min(n, a.shape[1])
        best = np.argsort(-a, axis=1, kind="stable")[:, :top]
        if not self.second:
            return np.pad(best, ((0, 0), (0, n - top)), constant_values=-1)
        b = self.turned(x, table, 1)[:, : self.second]
        b = np.concatenate([b, -b], axis=1)
        both = np.take_along_axis(a, best, 1)[:, :, None] + b[:, None, :]
        code = best[:, :, None] * b.shape[1] + np.arange(b.shape[1])
        order = np.argsort(-both.reshape(len(x), -1), axis=1, kind="stable")[:, :n]
        code = np.take_along_axis(code.reshape(len(x), -1), order, 1)
        return np.pad(code, ((0, 0), (0, n - code.shape[1])), constant_values=-1)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _codes(entries: DataFrame, hashing: Hashing, query: bool, probes: int) -> DataFrame:
    """key (table and code), id, v: an entry in its bucket of each table, or a query in its probes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                x = hashing.lift(_vectors(part.column("v"), hashing.dim), query)
                for t in range(hashing.tables):
                    code = hashing.probes(x, t, probes)
                    row, _ = np.nonzero(code >= 0)
                    keys = code[code >= 0].astype(np.int64) + (t << 40)
                    at_row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("id").take(at_row), part.column("v").take(at_row)], names=["key", "id", "v"])

    return entries.select("id", "v").mapInArrow(frugal(run), "key long, id long, v binary")


def _compared(members: DataFrame, dim: int, k: int) -> DataFrame:
    """q, id, score: each query's ``k`` best entries of the buckets of each task, by exact inner products."""

    def best_of(parts: list) -> tuple:
        q, e, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((e, -score, q))
        q, e, score = q[order], e[order], score[order]
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (e[1:] != e[:-1])])
        q, e, score = q[new], e[new], score[new]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(q)]])))
        keep = place < k
        return q[keep], e[keep], score[keep]

    def run(batches):
        parts, held = [], 0
        for table in whole_groups(batches):
            path = table.column("path").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])).tolist() + [len(path)]
            ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy()
            v = _vectors(table.column("v"), dim)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = int(asks[a:b].sum())
                if n == 0 or n == b - a:
                    continue
                entry, top = v[a : b - n], min(k, b - a - n)
                for s in range(b - n, b, SLICE):
                    query = v[s : min(s + SLICE, b)]
                    score = query @ entry.T
                    best = np.argpartition(-score, top - 1, axis=1)[:, :top]
                    q = np.repeat(np.arange(len(query)), top)
                    e = best.ravel()
                    exact = (query[q] * entry[e]).sum(axis=1)
                    parts.append((ids[s + q], ids[a : b - n][e], exact))
                    held += len(q)
                    if held > HELD:
                        parts = [best_of(parts)]
                        held = len(parts[0][0])
                        if 2 * held > HELD:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], names=["q", "id", "score"])
                            parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best_of(parts)], names=["q", "id", "score"])

    return members.select("path", "asks", "id", "v").repartition("path").sortWithinPartitions("path", "asks", "id").mapInArrow(frugal(run), "q long, id long, score double")


def entries(vectors: DataFrame, keep: int, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """id (the smallest), ids (the ``keep`` smallest), v, norm of each distinct vector that takes part; their length.

    Copies are thinned in each batch and merged in two steps, so no group of copies is ever gathered."""
    e = F.col(embedding)
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e")).where(F.col("vec_id").isNotNull() & usable)
    size = rows.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = size[0]["n"] if size else 1

    def thin(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            v = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) + 0.0  # no negative zeros
            ids = batch.column(0).to_numpy()
            held: dict[bytes, list[int]] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                own = held.setdefault(v[i].tobytes(), [])
                if len(own) < keep and (not own or own[-1] != ids[i]):
                    own.append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["v", "ids"])

    first = lambda c: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))), 1, keep)
    merged = rows.where(F.size("e") == dim).mapInArrow(frugal(thin), "v binary, ids array<long>")
    merged = merged.groupBy("v", F.pmod(F.xxhash64("ids"), F.lit(64)).alias("salt")).agg(first("ids").alias("ids"))
    merged = merged.groupBy("v").agg(first("ids").alias("ids"))
    return written(merged.select(F.col("ids")[0].alias("id"), "ids", "v"), "entries"), dim


def _probes_needed(known: DataFrame, asking: DataFrame, hashing: Hashing, k: int, target: float, sample: int) -> int:
    """The fewest probes that find ``target`` of the true neighbours of ``sample`` queries."""
    some = [(r["id"], bytes(r["v"])) for r in asking.dropDuplicates(["id"]).orderBy(F.xxhash64("id")).limit(sample).select("id", "v").collect()]
    if not some:
        return 1
    query = np.frombuffer(b"".join(v for _, v in some), np.float64).reshape(-1, hashing.dim)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            score = query @ _vectors(batch.column("v"), hashing.dim).T
            top = min(k, batch.num_rows)
            best = np.argpartition(-score, top - 1, axis=1)[:, :top]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(query)), top)), batch.column("id").take(pa.array(best.ravel())), pa.array(np.take_along_axis(score, best, 1).ravel())],
                names=["q", "id", "score"],
            )

    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = known.select("id", "v").mapInArrow(frugal(run), "q long, id long, score double").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
    found = known.select("id", "v").join(F.broadcast(found.select("q", "id")), "id").collect()  # at most sample * k rows
    near = hashing.lift(np.frombuffer(b"".join(bytes(r["v"]) for r in found), np.float64).reshape(-1, hashing.dim), False)
    ask, q = hashing.lift(query, True), np.array([r["q"] for r in found])
    most = min(MOST_PROBES, max(1, 2 * hashing.first * max(1, 2 * hashing.second)))
    rank = np.full(len(found), most)
    for t in range(hashing.tables):
        order, code = hashing.probes(ask, t, most), hashing.probes(near, t, 1)
        for i in range(len(ask)):
            own = np.flatnonzero(q == i)
            hit = order[i] == code[own]
            rank[own] = np.minimum(rank[own], np.where(hit.any(axis=1), hit.argmax(axis=1), most))
    return min(most, int(np.sort(rank)[min(len(rank) - 1, int(target * len(rank)))]) + 1)


def nearest(vectors: DataFrame, asks: Column, k: int = NEAREST, tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose ``vec_id`` fulfils ``asks``."""
    known, dim = entries(vectors, k + 1)

    def norms(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.linalg.norm(_vectors(batch.column(0), dim), axis=1))], names=["norm"])

    longest, rows = known.select("v").mapInArrow(frugal(norms), "norm double").agg(F.max("norm"), F.count("*")).first()
    hashing = Hashing(dim, rows, longest or 1.0, tables)
    asking = vectors.where(asks).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("e")).where("query_id is not null and e is not null").distinct()
    # A query's entry is found by its vector, as its id may not be among the entry's smallest.
    packed = _packed(asking, dim)
    asking = written(packed.join(known.select("id", "v"), "v").select("query_id", "id", "v"), "asking")
    probes = _probes_needed(known, asking, hashing, k + 1, target, SAMPLE)
    index = _codes(known, hashing, False, 1)
    queries = _codes(asking.select("id", "v").dropDuplicates(["id"]), hashing, True, probes)
    index = written(index, "index")
    blocks = lambda rows, name: rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias(name))
    hot = blocks(index, "entry_blocks").join(blocks(queries, "query_blocks"), "key", "full")
    own = lambda name: F.pmod(F.xxhash64("id"), F.coalesce(name, F.lit(1))).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.coalesce(name, F.lit(1)) - 1))
    index = index.join(hot, "key", "left").select("key", "id", "v", own("entry_blocks").alias("e"), every("query_blocks").alias("b"))
    queries = queries.join(hot, "key", "left").select("key", "id", "v", every("entry_blocks").alias("e"), own("query_blocks").alias("b"))
    place = F.xxhash64("key", "e", "b").alias("path")
    index, queries = index.select(place, F.lit(0).alias("asks"), "id", "v"), queries.select(place, F.lit(1).alias("asks"), "id", "v")
    found = _compared(index.unionByName(queries), dim, k + 1).distinct()
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    spread = found.join(known.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    spread = spread.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    spread = asking.select("query_id", F.col("id").alias("q")).join(spread, "q")
    kept = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return spread.select("query_id", F.posexplode(kept).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _packed(rows: DataFrame, dim: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            full = [x is not None and len(x) == dim and None not in x for x in batch.column(1).to_pylist()]
            part = batch.filter(pa.array(full, pa.bool_()))
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in v], pa.binary())], names=["query_id", "v"])

    return rows.mapInArrow(frugal(run), "query_id long, v binary")
