"""Audit of sources: how far each source's use of words is from other sources' and from its language's.

Terms are runs of letters (ASCII letters, lower-cased, and everything outside ASCII). A language keeps the
terms of at least ``LEAST_DOCS`` of its documents. Every (language, source) group and every language gives a
kept term the share p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), N being the group's count of all kept
terms and V their number; two shares differ by f = floor((p - q)^2 / (p + q)). All arithmetic is in integers.

Leading terms by count cells: f depends on a term only through its count in the group and in the language,
so terms are counted by that pair of counts, f is evaluated once for each cell, cells of equal value are
merged and ranked by the number of terms in and before them, and only the cells that reach the first
``TOP`` ranks are expanded to terms, in UTF-8 order.

Distances of sources: f is symmetric and sums over terms, so the terms of a language are dealt into blocks
and its sources into tiles; a task holds two tiles' shares of one block as a matrix and adds up f for each
pair of sources, and the blocks' sums are added in a shuffle. No pair of rows is ever a row.

Defined cases: a null text, language or source counts as empty; a text without terms still makes its group
occur; a language without kept terms has shares of 1 and distances 0; repeated rows are documents of their
own; a lone source of a language has no pairs; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, frugal, spread_join, written
from .words import chunks

LEAST_DOCS = 10
TOP = 10
#: What ends a term: ASCII but letters.
BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are held as terms at once (a longer text stands alone).
CHUNK_BYTES = 8 << 20
#: Terms of a block (about) and sources of a tile: a task's matrices have no more than twice so many shares.
BLOCK, TILE = 8192, 64
GROUP = ["lang", "source"]


def _counted(batches):
    for batch in batches:
        for start, part in chunks(batch.column(0), CHUNK_BYTES):
            lists = pc.split_pattern_regex(pc.ascii_lower(part), BREAK)
            coded = pc.dictionary_encode(lists.flatten())
            lang, source = (pc.dictionary_encode(pc.fill_null(batch.column(i).slice(start, len(part)), "")) for i in (1, 2))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            code, n = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
            # A row's terms are counted first, so that a group's documents are counted with its occurrences.
            row = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
            own, times = np.unique(row * n + code, return_counts=True)
            key, at = np.unique(group[own // n] * n + own % n, return_inverse=True)
            c = np.bincount(at, weights=times, minlength=len(key)).astype(np.int64)
            docs = np.bincount(at, minlength=len(key)).astype(np.int64)
            g = key // n
            columns = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), coded.dictionary.take(pa.array(key % n))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(c), pa.array(docs)], names=[*GROUP, "term", "c", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, c (occurrences), docs of each group's terms, as a written table.

    Splitting leaves at least one string of each text, an empty one if need be, so every group is in the table."""
    counted = docs.select("text", "lang", "source").mapInArrow(frugal(_counted), "lang string, source string, term string, c long, docs long")
    return written(counted.groupBy(*GROUP, "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")), "terms")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (n + 2 * v)), exactly; 1 where there is nothing to divide by."""
    whole = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    parts = (n + 2 * v).cast("decimal(20,0)")
    return F.when(v > 0, F.call_function("div", whole, parts) + 1).otherwise(F.lit(1)).cast("long")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over the terms of one block, for each pair of sources of two tiles (or of one, with itself), of f less
    what it is for a term that both lack."""
    lang, _, a, b = (k.as_py() for k in key)
    place, p, p0 = (table.column(c).to_numpy() for c in ("place", "p", "p0"))
    term = pc.dictionary_encode(table.column("term")).combine_chunks()
    code = pc.fill_null(term.indices, -1).to_numpy()
    rows, first, at = np.unique(place, return_index=True, return_inverse=True)
    shares = np.repeat(p0[first][:, None], len(term.dictionary), axis=1)
    shares[at[code >= 0], code[code >= 0]] = p[code >= 0]
    left = np.flatnonzero(rows // TILE == a)
    out: list[tuple[np.ndarray, ...]] = []
    for i in left:
        j = np.flatnonzero((rows // TILE == b) & (rows > rows[i]))
        if len(j):
            apart, lack = shares[j] - shares[i], p0[first[j]] - p0[first[i]]
            lacking = lack * lack // (p0[first[j]] + p0[first[i]])
            out.append((np.full(len(j), rows[i]), rows[j], (apart * apart // (shares[j] + shares[i])).sum(axis=1) - len(term.dictionary) * lacking))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"lang": pa.array([lang] * len(columns[0]), pa.string()), **{name: pa.array(c.astype(np.int64)) for name, c in zip(("i", "j", "value"), columns, strict=True)}})


def pair_distances(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the language), value."""
    of_lang = Window.partitionBy("lang")
    sources = groups.withColumn("place", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long"))
    sources = sources.withColumns({"p0": share(F.lit(0), F.col("n"), F.col("v")), "blocks": F.ceil(F.greatest(F.col("v"), F.lit(1)) / BLOCK), "tiles": F.floor(F.max("place").over(of_lang) / TILE) + 1})
    sources = written(sources, "sources")
    own = spread_join(kept, sources.drop("n_lang"), GROUP, "terms")
    own = own.select("lang", "place", "term", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), "p0", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "tiles")
    # Every source meets every block, so that terms that only one of a pair has are counted too.
    absent = sources.select("lang", "place", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "p0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "tiles")
    tile = F.floor(F.col("place") / TILE)
    met = own.unionByName(absent).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = met.select("lang", "block", F.least(tile, "other").alias("a"), F.greatest(tile, "other").alias("b"), "place", "term", "p", "p0")
    sums = met.groupBy("lang", "block", "a", "b").applyInArrow(_pair_sums, "lang string, i long, j long, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    ends = [sources.select("lang", F.col("place").alias(i), F.col("source").alias(x), F.col("p0").alias(p), *more) for i, x, p, more in (("i", "s", "p", ["v"]), ("j", "t", "q", []))]
    both = sums.join(ends[0], ["lang", "i"]).join(ends[1], ["lang", "j"])
    both = both.withColumn("value", F.col("value") + F.col("v") * difference(F.col("p"), F.col("q")))
    ways = F.array(*(F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("s", "t"), ("t", "s"))))
    return both.select("lang", F.explode(ways).alias("x"), "value").select("lang", "x.source", "x.item", "value")


def leading_terms(kept: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item (term), value, rank of the ``top`` terms that a group uses more than its language does."""
    cells = kept.groupBy(*GROUP, "c", "of_lang").agg(F.count("*").alias("m"))
    cells = spread_join(cells, groups, GROUP, "terms").withColumns({"p": share(F.col("c"), F.col("n"), F.col("v")), "q": share(F.col("of_lang"), F.col("n_lang"), F.col("v"))})
    cells = written(cells.where("p > q").select(*GROUP, "c", "of_lang", "m", difference(F.col("p"), F.col("q")).alias("value")), "cells")
    values = cells.groupBy(*GROUP, "value").agg(F.sum("m").alias("m"))
    # A value stands for one term at least, so as many values as there are ranks hold them all.
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    first = values.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)
    reached = first.withColumn("before", F.sum("m").over(order) - F.col("m")).where(F.col("before") < top).groupBy(*GROUP).agg(F.min("value").alias("least"))
    chosen = written(cells.join(reached, GROUP).where("value >= least").drop("least"), "chosen-cells")
    terms = spread_join(kept, chosen, [*GROUP, "c", "of_lang"], "m")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "term"))
    return terms.withColumn("rank", rank).where(F.col("rank") <= top).select(*GROUP, F.col("term").alias("item"), "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank (from 1 per group and part)."""
    counts = term_counts(docs)
    of_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("c").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(counts.where("term <> ''").select(*GROUP, "term", "c").join(of_lang, ["lang", "term"]), "kept-terms")
    known = kept.groupBy(*GROUP).agg(F.sum("c").alias("n"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang", "term").agg(F.first("of_lang").alias("of_lang")).groupBy("lang").agg(F.sum("of_lang").alias("n_lang"), F.count("*").alias("v"))
    groups = counts.select(*GROUP).distinct().join(known, GROUP, "left").join(langs, "lang", "left")
    groups = written(groups.na.fill(0, ["n", "terms", "n_lang", "v"]), "groups")
    discard(counts)
    pairs = pair_distances(kept, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    parts = [df.withColumn("part", F.lit(part)) for part, df in (("pair", pairs), ("term", leading_terms(kept, groups, top)))]
    return parts[0].unionByName(parts[1]).select(*GROUP, "part", "item", "value", "rank")
