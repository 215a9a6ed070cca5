"""Near-duplicates by a chosen-path set similarity join.

A document is its set of distinct 5-word shingles. Equal sets are one vertex from the start. Vertices
branch into tree nodes by selected minwise tokens: in each of TREES independent trees a node splits its
members by BRANCHES of their minwise values. Nodes of up to SMALL members are compared exhaustively:
first on sketches, then, for members with some promising partner, on the full sets. Larger nodes branch
again, unless a branch keeps most of their members together or DEPTH is reached; those are compared block
by block, so no partner is ever dropped; members of a node's largest component meet the others alone,
and before that a look at random parts joins what is alike throughout a large node. Before that, each vertex is tried with its most likely partner;
a node whose members are all of one component says nothing new and is left, and only members of
different components are compared, which is what keeps large groups of copies cheap.

A pair at the threshold meets in a first-level node but with a probability of 0.25 ** (TREES * BRANCHES)
(6e-8) and passes the filter but with a probability of about 4e-5 (four standard deviations).

Defined cases: a null text, an empty one or one without words has an empty set, is linked with nothing
and is its own component; fewer than five words are one shingle; rows that share a doc_id are one vertex
of the graph; a row without a doc_id is kept as it is, with a null component; an empty table gives an
empty result; further columns are ignored; texts of any length count whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import discard, frugal, spread_join, written
from .words import encode, hashes, mix

SHINGLE = 5
PERCENT = 75
TREES, BRANCHES = 6, 2
SKETCH = 128
#: Sketches must agree in this share for a pair to be confirmed.
FILTER = 0.60
SMALL = 256
#: A node whose branch keeps more than this share of it together is compared rather than branched on.
DENSE = 0.5
DEPTH = 7
BLOCK = 512
#: Ids (8 bytes each) that are sent to every task at most.
BROADCAST = 2_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int = SHINGLE):
    """The sorted distinct 64-bit shingle hashes of each text, in order."""
    for part in encode(texts):
        words = mix(hashes(part.vocabulary).view(np.uint64))[part.codes] if len(part.codes) else np.empty(0, np.uint64)
        n = len(words) - width + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for k in range(width if n > 0 else 0):
            rolled = rolled * PRIME + words[k : k + n]
        rolled = mix(rolled)
        ends = part.offsets.tolist()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                h = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    h = h * PRIME + w
                yield mix(h)
            else:
                yield np.empty(0, np.uint64)


def _sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1, k2 (a 128-bit key of the set), paths (first-level nodes), sketch."""
    rng = np.random.default_rng(11)
    mult = (rng.integers(0, 1 << 31, SKETCH, dtype=np.int64) * 2 + 1).astype(np.uint32)
    add = rng.integers(0, 1 << 32, SKETCH, dtype=np.int64).astype(np.uint32)
    salts = rng.integers(0, 1 << 62, TREES * BRANCHES, dtype=np.int64).astype(np.uint64)

    def one(s: np.ndarray) -> tuple:
        x = (s >> np.uint64(32)).astype(np.uint32)
        low, at = None, None
        for i in range(0, len(x), 2048):
            v = x[None, i : i + 2048] * mult[:, None] + add[:, None]
            least = v.min(axis=1)
            arg = v[: len(salts)].argmin(axis=1) + i
            if low is None:
                low, at = least, arg
            else:
                at = np.where(least[: len(salts)] < low[: len(salts)], arg, at)
                low = np.minimum(low, least)
        low = (low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)
        paths = mix(s[at] + salts).view(np.int64)
        return len(s), int(s.sum().view(np.int64)), int(mix(s ^ PRIME).sum().view(np.int64)), paths.tobytes(), (low >> np.uint32(24)).astype(np.uint8).tobytes()

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("paths", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = [one(s) if len(s) else (0, 0, 0, b"", b"") for s in shingle_sets(batch.column(1))]
            if rows:
                cols = [batch.column(0), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "doc_id long, n_shingles long, k1 long, k2 long, paths binary, sketch binary")


def _full_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "whole"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(frugal(run), "id long, whole binary")


def _groups(batches):
    """Tables of whole nodes from batches that are sorted by path."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        path = table.column("path").to_numpy()
        cut = int(np.flatnonzero(path != path[-1])[-1]) + 1 if len(path) and (path != path[-1]).any() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    return tuple(table.column(c).to_numpy() for c in ("path", "id", "label", "size")) + (sketch,)


def _opened(batches):
    """path, id: a row for each first-level node of each vertex."""
    for batch in batches:
        paths = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        ids = batch.column(0).take(pa.array(np.arange(len(paths)) // (TREES * BRANCHES)))
        yield pa.RecordBatch.from_arrays([pa.array(paths), ids], names=["path", "id"])


def _with_nodes(now: DataFrame) -> DataFrame:
    """``now`` with ``nodes``: all nodes in which the member is compared at this level, in order."""
    lists = now.select("id", "node").distinct().groupBy("id").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    return now.join(lists, "id")


def _node_table(table: pa.Table) -> np.ndarray:
    """The members' nodes as rows of equal width; the padding comes last and is never the first match."""
    column = table.column("nodes").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy().astype(np.int64)
    n = np.diff(ends)
    out = np.full((len(n), int(n.max())), np.iinfo(np.int64).max)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], n)] = column.flatten().to_numpy()
    return out


def _may_link(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sets of such sizes can reach the similarity at all."""
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _cross(table: pa.Table, top: bool):
    """Pairs (a, b, like) of row numbers within a node, of different labels, whose sizes and sketches allow the
    similarity: one batch for the nodes of each size, a few MB at a time. At the top level a pair is only
    taken in the first of the nodes that both are in."""
    path, _, label, n, sketch = _columns(table)
    if top:
        own, node = _node_table(table), table.column("node").to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(path)]]))
    for size in np.unique(sizes[sizes > 1]).tolist():
        first = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        step = max(1, 250_000 // len(i))
        for at in range(0, len(first), step):
            base = first[at : at + step, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            keep = (label[a] != label[b]) & _may_link(n[a], n[b])
            a, b = a[keep], b[keep]
            if top and len(a):
                keep = np.concatenate([_is_first(own[a[k : k + 50_000]], own[b[k : k + 50_000]], node[a[k : k + 50_000]]) for k in range(0, len(a), 50_000)])
                a, b = a[keep], b[keep]
            like = np.concatenate([np.empty(0, np.int64), *((sketch[a[k : k + 100_000]] == sketch[b[k : k + 100_000]]).sum(axis=1) for k in range(0, len(a), 100_000))])
            keep = like >= FILTER * SKETCH
            if keep.any():
                yield a[keep], b[keep], like[keep]


def _is_first(x: np.ndarray, y: np.ndarray, node: np.ndarray) -> np.ndarray:
    first = (x[:, :, None] == y[:, None, :]).any(axis=2).argmax(axis=1)
    return x[np.arange(len(x)), first] == node


def _ordered(members: DataFrame, *more: str) -> DataFrame:
    return members.select("path", "node", "id", "label", "size", "sketch", "nodes", *more).repartition("path").sortWithinPartitions("path", "id")


def _best_partners(members: DataFrame, top: bool = True) -> DataFrame:
    """a, b: for each id the member before it (by id) that is most like it, over all its nodes.

    A node gives a row for each member at most; these pairs join most of what belongs together."""

    def run(batches):
        for table in _groups(batches):
            ids = table.column("id").to_numpy()
            for a, b, like in _cross(table, top):
                order = np.lexsort((a, -like, b))
                a, b, like = a[order], b[order], like[order]
                keep = np.concatenate([[True], b[1:] != b[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[keep]]), pa.array(ids[b[keep]]), pa.array(like[keep].astype(np.int32))], names=["a", "b", "like"])

    found = _ordered(members).mapInArrow(frugal(run), "a long, b long, like int")
    return found.groupBy("b").agg(F.max_by("a", F.struct("like", -F.col("a"))).alias("a")).select("a", "b")


def _promising(members: DataFrame, top: bool) -> DataFrame:
    """path, id: the members of a node that may be similar to some member of another label."""

    def run(batches):
        for table in _groups(batches):
            hit = np.zeros(table.num_rows, bool)
            for a, b, _ in _cross(table, top):
                hit[a] = hit[b] = True
            if hit.any():
                yield from table.select(["path", "id"]).filter(pa.array(hit)).to_batches()

    return _ordered(members).mapInArrow(frugal(run), "path long, id long")


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    n = len(x) + len(y)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
    return n > 0 and 100 * both >= PERCENT * (n - both)


def _links(members: DataFrame, top: bool) -> DataFrame:
    """a, b: links between members of different labels, confirmed on the full sets that the members carry.

    Likely pairs come first, and what a link has joined is not asked again, so a node gives fewer links
    than it has members."""

    def run(batches):
        for table in _groups(batches):
            ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
            # Offsets of 64 bits: a node's sets may be more than 2 GB.
            whole = pa.concat_arrays(table.column("whole").cast(pa.large_binary()).chunks)
            sets = lambda i: np.frombuffer(whole[i].as_buffer(), np.uint64)  # noqa: B023, E731 (a view, no copy)
            path = table.column("path").to_numpy()
            joined: dict[tuple[int, int], tuple[int, int]] = {}

            def root(i: int) -> tuple[int, int]:
                k = (int(path[i]), int(label[i]))
                while k in joined:
                    k = joined[k]
                return k

            out = []
            for a, b, like in _cross(table, top):
                for k in np.argsort(-like, kind="stable").tolist():
                    i, j = int(a[k]), int(b[k])
                    r, s = root(i), root(j)
                    if r != s and _similar(sets(i), sets(j)):
                        joined[max(r, s)] = min(r, s)
                        out.append((int(ids[i]), int(ids[j])))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return _ordered(members, "whole").mapInArrow(frugal(run), "a long, b long").distinct()


def _children(members: DataFrame) -> DataFrame:
    """path, id, parent, branch: members of a node by BRANCHES of their minwise values, chosen by the node."""
    kids = []
    for k in range(BRANCHES):
        at = F.pmod(F.xxhash64("path", F.lit(k)), F.lit(SKETCH)).cast("int")
        kids.append(F.struct(F.xxhash64("path", at, F.substring("sketch", at + 1, F.lit(1))).alias("path"), F.lit(k).alias("branch")))
    return members.select("id", F.col("path").alias("parent"), F.explode(F.array(*kids)).alias("c")).select("c.path", "id", "parent", "c.branch")


def _blocks(level: DataFrame) -> DataFrame:
    """Members of large nodes (path, id, label, n) meet in pairs of blocks of about BLOCK members: exhaustive,
    without a task for a whole node.

    The members of a node's largest component are compared with the others alone, never among themselves, so
    a member of it is copied once for each block of others."""
    counts = level.groupBy("path", "label").agg(F.count("*").alias("c"))
    top = counts.groupBy("path").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("most"), F.sum("c").alias("rows"))
    top = written(top, "largest")
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    known = spread_join(level.select("path", "id", "label"), top, ["path"], "rows")
    known = known.select("path", "id", "label", (F.col("label") == F.col("top")).alias("main"), of(F.col("most")).alias("m"), of(F.col("rows") - F.col("most")).alias("o"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("m")).otherwise(F.col("o"))).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # Blocks of the others are numbered from 0; those of the largest component follow them.
    mates = F.when(F.col("main"), every(F.col("o"))).otherwise(F.concat(every(F.col("o")), F.transform(every(F.col("m")), lambda i: i + F.col("o"))))
    place = own + F.when(F.col("main"), F.col("o")).otherwise(0)
    both = known.select("path", "id", "label", place.alias("i"), F.explode(mates).alias("j"))
    return both.select(F.xxhash64("path", F.least("i", "j"), F.greatest("i", "j")).alias("path"), F.col("path").alias("node"), "id", "label")


def _dealt(level: DataFrame) -> DataFrame:
    """Large nodes dealt at random into parts of about BLOCK members, in another way than _compact deals them."""
    part = F.pmod(F.xxhash64(F.lit("again"), "id"), F.ceil(F.col("n") / BLOCK))
    return level.select(F.xxhash64("path", F.lit("again"), part).alias("path"), F.col("path").alias("node"), "id", "label", F.array("path").alias("nodes"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            sets_ = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            keep = [_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets_]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("whole").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("whole").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(frugal(run), "a long, b long")


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """path, id, label, n, written: nodes of two members at least that are not of one component already."""
    if labels is None:
        nodes = nodes.withColumn("label", F.col("id"))
    else:
        nodes = nodes.join(labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    mixed = nodes.groupBy("path").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    mixed = written(mixed.select("path", "n"), "mixed")
    level = written(spread_join(nodes.select("path", "id", "label"), mixed, ["path"], "n"), "level")
    discard(mixed)
    return level


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """The components of what is joined already and the links found now."""
    if found.isEmpty():
        return labels
    return components(found if labels is None else found.unionByName(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def _compact(level: DataFrame) -> DataFrame:
    """Large nodes dealt into parts of SMALL members on average: enough for a first look for partners."""
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / SMALL))
    return level.select(F.when(F.col("n") > SMALL, F.xxhash64("path", part)).otherwise(F.col("path")).alias("path"), F.col("path").alias("node"), "id", "label")


def _sets_of(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """id, whole: the full sets of ``ids``, made from the texts when they are asked for, so that neither all
    sets nor all texts are ever moved. Up to BROADCAST ids travel to the documents; more are joined."""
    ids = written(ids.distinct().withColumnRenamed("id", "doc_id"), "ids")
    if ids.count() <= BROADCAST:
        ids = F.broadcast(ids)
    sets = _full_sets(docs.join(ids, "doc_id", "left_semi"))
    return sets.dropDuplicates(["id", "whole"]) if repeated else sets


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``docs``."""
    rows = written(_sketches(docs), "sketches")
    keys = rows.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    keys = written(keys, "vertices")
    n, distinct = rows.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    repeated = n > distinct
    own = rows.select("doc_id", "n_shingles", "k1", "k2", "paths").join(
        keys.select(F.col("rep").alias("doc_id"), "n_shingles", "k1", "k2"), ["doc_id", "n_shingles", "k1", "k2"], "left_semi"
    )
    # First level: only nodes with company go on, before any sketch is moved.
    nodes = own.select(F.col("doc_id").alias("id"), F.col("paths")).mapInArrow(frugal(_opened), "path long, id long").distinct()
    first = _labelled(nodes, None)
    nodes = first.select("path", "id")
    ids = written(nodes.select("id").distinct(), "ids")
    sketches = rows.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), "sketch").where("size > 0")
    sketches = written(sketches.join(ids, "id", "left_semi").dropDuplicates(), "members")
    pairs = written(_best_partners(_with_nodes(_compact(first)).join(sketches, "id")), "pairs")

    def found(now: DataFrame, top: bool) -> DataFrame:
        """The links within the parts of ``now``, confirmed on the full sets of those that look alike; written."""
        members = written(now.join(_promising(now.join(sketches, "id"), top), ["path", "id"]), "promising")
        sets = _sets_of(docs, members.select("id"), repeated)
        links = written(_links(members.join(sketches, "id").join(sets, "id"), top), "links")
        discard(members)
        return links

    labels = None
    if not pairs.isEmpty():
        asked = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
        labels = _merged(labels, written(_confirmed(pairs, written(_sets_of(docs, asked, repeated), "sets")), "links"))
        # Parts of large nodes were looked at alone so far. A look at parts that are dealt anew joins what is
        # alike throughout a node, so that few members are left to meet all others.
        wide = _labelled(nodes, labels)
        large = wide.where(F.col("n") > SMALL)
        if not large.isEmpty():
            links = found(_dealt(large), False)
            labels = _merged(labels, links)
            discard(links)
        discard(wide)
        for depth in range(DEPTH + 1):
            level, kids, large = _labelled(nodes, labels), None, None
            if level.isEmpty():
                break
            # Large nodes branch, unless a branch keeps most of them together: those are compared now.
            now, nodes = level.where(F.col("n") <= SMALL).select("path", F.col("path").alias("node"), "id", "label"), None
            wide = level.where(F.col("n") > SMALL)
            if not wide.isEmpty():
                kids = written(_children(wide.join(sketches.select("id", "sketch").dropDuplicates(["id"]), "id")), "children")
                sizes = kids.groupBy("parent", "branch", "path").agg(F.count("*").alias("m")).groupBy(F.col("parent").alias("path")).agg(F.max("m").alias("m"), F.sum("m").alias("rows"))
                sizes = written(sizes, "branches")
                large = written(spread_join(wide, sizes, ["path"], "rows").withColumn("dense", (F.col("m") > DENSE * F.col("n")) | F.lit(depth == DEPTH)), "large")
                now = now.unionByName(_blocks(large.where("dense")))
                parents = large.where("not dense").select(F.col("path").alias("parent")).distinct()
                nodes = kids.join(parents, "parent", "left_semi").select("path", "id").distinct()
            links = found(_with_nodes(now), depth == 0)
            labels = _merged(labels, links)
            nodes = None if nodes is None else written(nodes, "nodes")
            discard(level, kids, large, links)
            if nodes is None:
                break
    # Components are named for each distinct set, and only then handed to its copies, which may be a third of all rows.
    if labels is not None:
        keys = keys.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep")).drop("component")
        keys = written(keys, "components-of-sets")
    out = spread_join(rows.select("doc_id", "n_shingles", "k1", "k2"), keys, ["n_shingles", "k1", "k2"], "copies", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, with all its columns; rows without a doc_id stay."""
    found = written(near_duplicates(docs), "near-dups")
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    if dropped.count() <= BROADCAST:
        dropped = F.broadcast(dropped)
    kept = docs.join(dropped, "doc_id", "left_anti")
    n, distinct = found.where("kept and doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n > distinct:  # rows that repeat a doc_id
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)
