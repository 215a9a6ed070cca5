"""Best-fit packing: a configuration linear program over the length histogram.

Documents become token ids and one end id; longer ones than a sequence are cut. The histogram of lengths
(at most one bin for each length) is all that the driver sees. A configuration is a multiset of lengths
that fits a sequence. The covering program over configurations is solved by multiplicative weights: a
knapsack dynamic program prices configurations by dual weights, the fractional solution is the mean over
the rounds, and the weights give a bound that no packing can beat. It is rounded within the copies there
are; pieces left over go best fit by decreasing length. Pieces then find their places by their rank among
pieces of equal length.

Defined cases: a null or empty text is the end id alone; repeated rows are separate documents; ties in
length are ordered by doc_id and piece; an empty table gives an empty result; further columns are
ignored; a text of any length is encoded whole.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, gapless, written
from .words import chunks

LENGTH = 4096
END_ID = 1
#: Rounds of the multiplicative weights, and pricings in each.
EPOCHS, TURNS = 6, 12
#: How fast dual weights follow the coverage, and the power of a length that they start from.
RATE = 0.1
DEAR = 2.0
#: The most of a sequence that a priced configuration may leave unused.
SLACK = 1 / 1024
TINY = 1e-9
#: The share of each length's copies that are left to fill the gaps of the rounding's rest.
SPARE = 0.1
#: Bytes of remembered strings and ids in a task (those of one chunk are always held), and of text in a chunk.
REMEMBERED = 12 << 20
CHUNK = 2 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of whole texts by a tokenizer that splits at spaces, lower-cases and marks the ends of words.

    Such a tokenizer ends a token at every space and between a letter and the punctuation after it, so a
    text is taken apart there and each distinct string is encoded once (as long as it is remembered).
    Strings of lower-case letters need no splitting: many are encoded in one call by the same model, and
    the end-of-word mark tells them apart again. Strings and their ids are remembered as two Arrow columns;
    when these are full, those of the present chunk stay."""

    #: Letters that stay letters in lower case, before marks that no special token's string holds.
    CUT = (r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([.,;:!?#$%&*])", r"\1 \2")

    def __init__(self, path: str, keep: int = REMEMBERED):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, mark = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        if not mark:
            raise ValueError("a tokenizer that marks the ends of words is needed")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        self.words, self.coded = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _learn(self, words: pa.Array) -> None:
        """Encodes strings that are not remembered and remembers them."""
        ascii_only = pc.ascii_is_alpha(words)
        plain, others = words.filter(ascii_only).to_pylist(), []
        for w in words.filter(pc.invert(ascii_only)).to_pylist():
            (plain if w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w) else others).append(w)
        raw, sizes = [], []
        for i in range(0, len(plain), 512):
            found = self.plain.encode_batch_fast([" ".join(plain[i : i + 512])], add_special_tokens=False)
            ids = np.array(found[0].ids, dtype="<u4")
            raw.append(ids.tobytes())
            sizes.append(np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        for i in range(0, len(others), 1024):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(others[i : i + 1024], add_special_tokens=False)]
            raw.append(np.array([k for ids in found for k in ids], dtype="<u4").tobytes())
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        ends = 4 * np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(raw))])
        self.words, self.coded = pa.concat_arrays([self.words, pa.array(plain + others, pa.string())]), pa.concat_arrays([self.coded, coded])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids end up: rows + 1 offsets."""
        apart = pc.replace_substring_regex(pc.ascii_lower(texts), *self.CUT)
        lists = pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        found = pc.dictionary_encode(flat)
        words = found.dictionary
        at = pc.index_in(words, self.words)
        if self.words.nbytes + self.coded.nbytes + words.nbytes > self.keep:
            self.words, self.coded = words.filter(at.is_valid()), self.coded.take(at.drop_null())
        if at.null_count:
            self._learn(words.filter(at.is_null()))
        own = self.coded.take(pc.index_in(words, self.words)).take(found.indices)
        upto = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, 8 * own.offset) // 4 if len(own) else np.zeros(1, np.int64)
        ids = np.frombuffer(own.buffers()[2], "<u4", upto[-1]) if upto[-1] else np.empty(0, "<u4")
        return ids, upto[ends - ends[0]]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32. Only documents over ``length`` are cut."""

    def run(batches):
        encoder, end = Encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for first, texts in chunks(batch.column(1), CHUNK):
                ids, ends = encoder.ids(texts)
                out: list[tuple] = []
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                doc_ids = batch.column(0).slice(first, len(texts)).to_pylist()
                for d, a, b in zip(doc_ids, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    n = b - a + 1
                    for k, s in enumerate(range(0, n, length)):
                        m = min(length, n - s)
                        body = raw[4 * (a + s) : 4 * min(b, a + s + m)]
                        crc = zlib.crc32(body)
                        out.append((d, k, s, m, zlib.crc32(end, crc) if s + m == n else crc))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), PIECES)


class Knapsack:
    """The most valuable configurations of a sequence, with no more copies of a length than there are.

    ``lengths`` ascend; the copies of a length are dealt into items of 1, 2, 4, ... of them, so that every
    number up to ``copies`` can be taken."""

    def __init__(self, lengths: np.ndarray, value: np.ndarray, copies: np.ndarray, length: int):
        self.length, self.items = length, []
        for at, (k, n) in enumerate(zip(lengths.tolist(), np.minimum(copies, length // lengths).tolist(), strict=True)):
            size = 1
            while n:
                self.items.append((at, min(size, n), min(size, n) * k))
                n -= min(size, n)
                size *= 2
        #: By item and room: the item itself or the last one before it that its best filling takes (-1: none).
        self.last = np.full((len(self.items), length + 1), -1, dtype=np.int16 if len(self.items) < 1 << 15 else np.int32)
        #: By item: the value of the best filling whose last item it is.
        self.worth = np.empty(len(self.items))
        best = np.zeros(length + 1)
        for i, (at, n, weight) in enumerate(self.items):
            if i:
                self.last[i] = self.last[i - 1]
            gains = best[: length + 1 - weight] + n * value[at]
            self.worth[i] = gains[-1]
            self.last[i, weight:][gains > best[weight:]] = i
            np.maximum(best[weight:], gains, out=best[weight:])

    def filling(self, i: int) -> dict[int, int]:
        """Copies by place in ``lengths`` of the best configuration whose last item is ``i``."""
        out: dict[int, int] = {}
        room = self.length
        while i >= 0:
            at, n, weight = self.items[i]
            out[at] = out.get(at, 0) + n
            room -= weight
            i = int(self.last[i - 1, room]) if i else -1
        return out


class Program(NamedTuple):
    """A fractional solution of the configuration program, and how good any solution can be."""

    lengths: np.ndarray  # ascending
    demand: np.ndarray  # pieces of each length
    amounts: dict[tuple[tuple[int, int], ...], float]  # configuration ((place in lengths, copies), ...) -> sequences
    covered: np.ndarray  # share of each length's pieces that the amounts hold
    bound: float  # dual: no packing has fewer sequences


def program(counts: dict[int, int], length: int = LENGTH, epochs: int = EPOCHS, turns: int = TURNS) -> Program:
    """The covering program min sum(x) with every length covered, by multiplicative weights.

    In each epoch the oracle spends as many sequences as the bound so far on the configurations that the dual
    weights price highest: the knapsack prices them within the copies that the epoch has left, in turns, each
    with a lower least price; one that leaves more than SLACK of a sequence unused is not taken. A length's
    weight is then multiplied by how far its coverage lags behind the tokens' as a whole. The solution is the
    mean over the epochs. Any weights w give a bound, sum(w * demand) over the highest price; the bound is the
    largest of those of the epochs and of the lengths themselves."""
    lengths = np.array(sorted(k for k, n in counts.items() if n > 0), dtype=np.int64)
    demand = np.array([counts[k] for k in lengths.tolist()], dtype=np.int64)
    tokens = lengths * demand
    bound = float(tokens.sum() / length)
    weight = (lengths / length) ** DEAR  # few configurations hold a long piece: it starts dear
    amounts: dict[tuple, float] = {}
    covered = np.zeros(len(lengths))
    for _ in range(epochs if len(lengths) else 0):
        left, room = demand.astype(float), bound
        for turn in range(turns):
            on = np.flatnonzero(left > TINY)
            if not len(on) or room <= TINY:
                break
            sack = Knapsack(lengths[on], weight[on], np.ceil(left[on] - TINY).astype(np.int64), length)
            best = sack.worth.max()
            if turn == 0:
                bound = max(bound, float(weight @ demand) / best)
            for i in np.argsort(-sack.worth, kind="stable").tolist():
                if sack.worth[i] < (1 - (turn + 1) / turns) * best or room <= TINY:
                    break
                if left[on[sack.items[i][0]]] <= TINY:
                    continue
                filling = sack.filling(i)
                places, n = on[list(filling)], np.fromiter(filling.values(), np.int64, len(filling))
                times = min(room, float((left[places] / n).min()))
                if times <= TINY or length - int(lengths[places] @ n) > length * SLACK:
                    continue
                left[places] -= times * n
                room -= times
                key = tuple(zip(places.tolist(), n.tolist(), strict=True))
                amounts[key] = amounts.get(key, 0.0) + times / epochs
        share = 1 - left / demand
        covered += share / epochs
        weight = weight * np.exp(RATE * ((share * tokens).sum() / tokens.sum() - share))
    return Program(lengths, demand, amounts, covered, bound)


def rounded(found: Program) -> tuple[Counter, dict[int, int]]:
    """Configurations (lengths, descending) with whole times, and the copies of each length that are left over.

    Amounts are rounded down first, then up in the order of their fractions (the latest weights' first where
    equal), always within the copies left. SPARE of the copies are left over on purpose."""
    spare = (found.demand * SPARE).astype(np.int64)
    left, used = (found.demand - spare).tolist(), Counter()
    whole = [(key, int(x + TINY)) for key, x in found.amounts.items()]
    order = sorted(enumerate(found.amounts.items()), key=lambda e: (-round(e[1][1] % 1, 6), -e[0]))
    for key, times in [*whole, *((key, 1) for _, (key, _) in order)]:
        times = min([times, *(left[at] // n for at, n in key)])
        if times > 0:
            for at, n in key:
                left[at] -= times * n
            used[tuple(sorted((int(found.lengths[at]) for at, n in key for _ in range(n)), reverse=True))] += times
    left = (np.array(left, dtype=np.int64) + spare).tolist()
    return used, {int(k): n for k, n in zip(found.lengths, left, strict=True) if n}


def configurations(counts: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): sequences that hold every counted piece exactly once: rounded ones, then the rest's best fit."""
    used, left = rounded(program(counts, length))
    return [*used.items(), *best_fit(left, length).items()]


def best_fit(left: dict[int, int], length: int) -> Counter:
    """Best fit by decreasing length; equal sequences count together, so the work follows the histogram."""
    rooms: list[int] = []
    held: dict[int, Counter] = {}  # room -> contents -> how many such sequences
    for k in sorted(left, reverse=True):
        n = left[k]
        while n:
            i = bisect_left(rooms, k)
            if i == len(rooms):
                room, per = length, min(length // k, n)
                full = n // per
                own, moved = (k,) * per, full
                n -= full * per
            else:
                room = rooms[i]
                contents, there = next(iter(held[room].items()))
                per = min(room // k, n)
                moved = min(there, n // per)
                n -= moved * per
                own = (*contents, *(k,) * per)
                held[room][contents] -= moved
                if not held[room][contents]:
                    del held[room][contents]
                if not held[room]:
                    del held[room]
                    rooms.pop(i)
            rest = room - k * per
            if rest not in held:
                held[rest] = Counter()
                insort(rooms, rest)
            held[rest][own] += moved
    return sum(held.values(), Counter())


def places(found: list[tuple[tuple[int, ...], int]], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, copies in a sequence, first sequence, offset): where ranks of a length go."""
    next_rank: Counter = Counter()
    out, sequence = [], 0
    for config, times in found:
        offset = 0
        for k, n in sorted(Counter(config).items(), reverse=True):
            out.append((k, next_rank[k], n * times, n, sequence, offset))
            next_rank[k] += n * times
            offset += k * n
        sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """PIECES plus sequence_id and offset: every piece has its place in a sequence of at most ``length``."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, length, end_id), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``length`` rows
    rows = sum(histogram.values())
    where = places(configurations(histogram, length), length)
    # A length has few ranges: they are found in an array of its own, so nothing is multiplied.
    by_length: dict[int, list] = {}
    for k, *rest in where:
        by_length.setdefault(k, []).append(tuple(rest))
    table = spark.createDataFrame(
        list(by_length.items()), "length long, ranges array<struct<first: long, ranks: long, per: long, sequence: long, at: long>>"
    )
    ranked = gapless(cut, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank", rows)
    placed = ranked.join(F.broadcast(table), "length").withColumn(
        "r", F.filter("ranges", lambda x: (F.col("rank") >= x["first"]) & (F.col("rank") < x["first"] + x["ranks"]))[0]
    )
    nth = F.col("rank") - F.col("r.first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("r.sequence") + F.floor(nth / F.col("r.per"))).cast("long").alias("sequence_id"),
        (F.col("r.at") + F.pmod(nth, F.col("r.per")) * F.col("length")).cast("long").alias("offset"),
    )
