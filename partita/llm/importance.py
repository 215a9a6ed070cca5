"""Importance resampling towards a target: hashed n-gram features, log ratios of buckets, a seeded draw.

Features are runs of 1 to n consecutive words, repeats counted; a feature's bucket is its CRC-32 modulo the
number of buckets. Both corpora's histograms have as many rows as there are buckets, whatever the corpora
hold, so the gains of buckets are the only thing that travels to the driver and back. A document's weight is
its features' mean gain, and a Gumbel variate seeded by its id is added, so that the highest scores are a
draw without replacement in proportion to the weights' exponentials.

CRCs are computed for the distinct features of a chunk of text, grouped by equal length into matrices of
bytes: one column of a matrix is folded into all of its rows' CRCs at a time, and the buckets are scattered
back to the features in text order.

Ranks need no sort of all rows: scores are integers, so a histogram of scores (as many rows as there are
values, which the gains bound) gives the score of the last document drawn, and only rows from there on are
sorted, by ranges.

Defined cases: a null or empty text has no features and weight 0; a null id is hashed as an empty one and ranks
first among ties; repeated rows are documents of their own; equal scores and ids have ranks in any order; a
word of any length is a feature; empty tables give an empty result, or gains of the other corpus's buckets
alone; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, written
from .words import chunks

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
#: Documents drawn of a hundred.
PERCENT = 10
#: What ends a word, once A-Z is lower-cased: ASCII but digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that are held as words at once (a longer text stands alone), and of one matrix.
CHUNK_BYTES = 4 << 20
MATRIX_BYTES = 4 << 20
#: The reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320


def _table() -> np.ndarray:
    """The CRC-32 of each byte."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1).astype(np.uint32)
    return crc


def crc32s(features: pa.Array) -> np.ndarray:
    """The unsigned CRC-32 of each string's UTF-8 bytes, as int64."""
    if not len(features):
        return np.zeros(0, np.int64)
    features = features.cast(pa.large_string())
    offsets = np.frombuffer(features.buffers()[1], np.int64)[features.offset : features.offset + len(features) + 1]
    data = np.frombuffer(features.buffers()[2] or b"", np.uint8)
    lengths, table, out = np.diff(offsets), _table(), np.zeros(len(features), np.int64)
    order = np.argsort(lengths, kind="stable")
    sizes, starts = np.unique(lengths[order], return_index=True)
    for size, group in zip(sizes.tolist(), np.split(order, starts[1:]), strict=True):
        step = max(1, MATRIX_BYTES // max(size, 1))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            if len(part) == 1:
                rows = data[offsets[part[0]] : offsets[part[0]] + size].reshape(1, size)
            else:
                rows = data[offsets[part][:, None] + np.arange(size)]
            for column in np.ascontiguousarray(rows.T):
                crc = table[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
            out[part] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and where each text's words end up: rows + 1 offsets."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[ends]


def features(texts: pa.Array, most: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk of rows: its first row, their number, each row's words, and the features' rows and buckets."""
    for start, part in chunks(texts, CHUNK_BYTES):
        words, ends = _words(part)
        row = np.repeat(np.arange(len(part)), np.diff(ends))
        rows, found, runs = [], [], words
        for n in range(1, most + 1):
            if n > 1:
                runs = pc.binary_join_element_wise(runs[:-1], words[n - 1 :], " ")
            inside = row[: len(row) - n + 1] == row[n - 1 :]
            coded = pc.dictionary_encode(runs.filter(pa.array(inside)))
            rows.append(row[: len(row) - n + 1][inside])
            found.append((crc32s(coded.dictionary) % buckets)[coded.indices.to_numpy(zero_copy_only=False)])
            if len(words) <= n:
                break
        yield start, len(part), np.diff(ends), np.concatenate(rows), np.concatenate(found)


def histogram(texts: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of the one text column in each bucket; a task gives no more than ``buckets`` rows."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, found in features(batch.column(0), most, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return texts.mapInArrow(frugal(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain, in thousandths of a nat, from two histograms (bounded by ``buckets`` rows)."""
    s, t = ({r["bucket"]: r["n"] for r in h.collect()} for h in (raw, target))
    of_s, of_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * of_s / ((s.get(b, 0) + 1) * of_t))) for b in range(buckets)]


def gumbel(doc_id: object, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], most: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document."""

    def run(batches):
        own = np.array(gain, np.int64)
        for batch in batches:
            for start, rows, words, row, found in features(batch.column(1), most, len(own)):
                ids = batch.column(0).slice(start, rows)
                n = np.bincount(row, minlength=rows)
                # A cumulative sum of integers stays exact, which weights of bincount would not.
                order = np.argsort(row, kind="stable") if most > 1 else slice(None)
                upto, ends = np.concatenate([[0], np.cumsum(own[found][order])]), np.concatenate([[0], np.cumsum(n)])
                weight = (upto[ends[1:]] - upto[ends[:-1]]) // np.maximum(n, 1)
                noise = np.array([gumbel(d, seed) for d in ids.to_pylist()], np.int64)
                columns = [ids, pa.array(words), pa.array(n.astype(np.int64)), pa.array(weight), pa.array(weight + noise)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long"
    return docs.select("doc_id", "text").mapInArrow(frugal(run), schema)


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``rank`` is null where it is not drawn.

    ``docs`` has doc_id and text, ``target`` text: what the draw should look like."""
    gain = gains(histogram(docs.select("text"), most, buckets), histogram(target.select("text"), most, buckets), buckets)
    rows = written(scored(docs, gain, most, seed), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    rest = lambda df: df.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if not drawn:
        return rest(rows)
    by_score = able.groupBy("score").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("score")))
    last = by_score.withColumn("before", upto - F.col("n")).where(F.col("before") < drawn).agg(F.min("score")).first()[0]
    in_draw = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    order = [F.desc("score"), F.asc("doc_id")]
    # Ranges are sorted apart and numbered within; a range starts after the rows of the ranges before it.
    place = F.monotonically_increasing_id()
    ordered = written(rows.where(in_draw).repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.shiftright(place, 33).alias("__range"), place.bitwiseAND((1 << 33) - 1).alias("__place")), "ordered")
    held = ordered.groupBy("__range").agg(F.count("*").alias("n"))
    starts = held.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__start"))
    rank = F.col("__start") + F.col("__place") + 1
    ranked = ordered.join(F.broadcast(starts), "__range").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    return ranked.unionByName(rest(rows.where(~in_draw)))
