"""Language-model scoring by a class-based bigram model whose classes come from exchange clustering.

P(word | before) = P(class | class before) * P(word | class), both smoothed. Every training word gets a class
of its own by exchange, in two steps:

* Words with at least EXCHANGED of all training tokens (1 / EXCHANGED at most, whatever the corpus) start from
  a deal at random. Each round counts, in Spark and over all training documents, how often each of them stands before
  and after each class, and moves words to the classes that raise the bigram likelihood most. All other words
  are of one further class meanwhile.
* Then each other word moves from there to the class that raises the likelihood most, by its own neighbours: rows
  (word, class before, class after, n) that Spark adds up, and a move for each word in the tasks. None of
  these words is frequent, so no key is hot.

A word that training lacks can stand in any class: every class keeps room for one unknown word, and the
model adds up over the classes. As a neighbour it is a mixture of the classes by the same room.

Word counts and classes cover every training word and stay in Spark. Words with at least FREQUENT of the tokens
(1 / FREQUENT at most) and the end token travel to the documents; the documents' other words are joined, one row for
each, with the classes of their neighbours. Where two such words meet, the one before is joined as well.

Words are known by 64-bit hashes. Defined cases: a null or empty text is the end token alone; repeated
rows are counted and scored one by one; without training documents all counts are 0; an empty table gives
an empty result; rows for which ``held_out`` is null are scored but not learned from; further columns are ignored;
texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, swept, written
from .words import encode, hashes

CLASSES = 64
EXCHANGED = 2e-5
FREQUENT = 4e-6
ROUNDS = 10
#: Share of the words that may move in a round: what the others' counts by class say stays true meanwhile.
MOVING = 0.5
#: Parts of a round's words that move one after the other, each seeing the moves before it.
STEPS = 24
#: Weight of the classes' overall shares in the transition probabilities.
PRIOR = 20.0
#: The end token: no word can hold white space.
END = int(hashes(pa.array(["\n"]))[0])
#: Tokens that a task looks at together.
SLICE = 1 << 20
#: Counts up to this many are looked up in a table of gains.
TABLED = 16


def _word_counts(docs: DataFrame) -> DataFrame:
    """h, c of every distinct token of ``docs``."""

    def run(batches):
        for batch in batches:
            for part in encode(batch.column(0)):
                h, n = hashes(part.vocabulary), np.bincount(part.codes, minlength=len(part.vocabulary))
                yield pa.RecordBatch.from_arrays([pa.array(np.append(h, END)), pa.array(np.append(n, len(part.offsets) - 1).astype(np.int64))], names=["h", "c"])

    counted = docs.select("text").mapInArrow(frugal(run), "h long, c long")
    return written(counted.groupBy("h").agg(F.sum("c").alias("c")), "word-counts")


class Vocabulary:
    """The frequent words in the order of their hashes, and which of them are exchanged on their own."""

    def __init__(self, h: np.ndarray, c: np.ndarray, tokens: int):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        alone = (self.c >= EXCHANGED * tokens) & (self.h != END)
        self.alone = int(alone.sum())
        # Units: 0 is the end token, then words of their own, then all others together.
        self.units = self.alone + 2
        self.unit = np.where(alone, np.cumsum(alone), self.alone + 1).astype(np.int32)
        self.unit[self.h == END] = 0

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each word among the frequent ones (-1: none)."""
        if not len(self.h):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1).astype(np.int32)


def _encoded(docs: DataFrame, held_out: Column, vocabulary: Vocabulary) -> DataFrame:
    """rid, doc_id, held_out, places (int32 bytes, without the end; -1: not frequent), the other words' hashes in order."""

    def run(batches):
        for batch in batches:
            for part in encode(batch.column(3)):
                h = hashes(part.vocabulary)
                place = vocabulary.places(h)[part.codes]
                n, rare = len(part.offsets) - 1, place < 0
                rows = batch.slice(part.start, n)
                ends, raw = (part.offsets * 4).tolist(), place.tobytes()
                cuts = np.concatenate([[0], np.cumsum(rare)])[part.offsets].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), rows.column(1), rows.column(2),
                        pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[part.codes[rare]])),
                    ],
                    names=["rid", "doc_id", "held_out", "places", "other"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return written(rows.mapInArrow(frugal(run), "rid long, doc_id long, held_out boolean, places binary, other array<long>"), "encoded")


def _slices(places: pa.Array):
    """First row, rows, and the places of all tokens of those rows, each text between two ends (END_AT)."""
    n = np.asarray([len(x) for x in places.to_pylist()]) // 4
    start, ends = 0, np.cumsum(n + 1)
    while start < len(n):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        mark = END_AT.tobytes()
        raw = mark + mark.join(x for x in places.slice(start, stop - start).to_pylist()) + mark
        yield start, n[start:stop], np.frombuffer(raw, np.int32)
        start = stop


#: How the end token stands among places.
END_AT = np.array(-2, np.int32)


def _summed(counted: DataFrame, size: int) -> np.ndarray:
    """An array of ``size`` cells from rows key, n, which Spark adds up."""
    got = counted.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out


def _cells(total: np.ndarray):
    """Rows key, n of the cells that hold something."""
    key = np.flatnonzero(total)
    for at in range(0, len(key), 1 << 16):
        some = key[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["key", "n"])


def _neighbours(train: DataFrame, vocabulary: Vocabulary, of: np.ndarray, classes: int) -> np.ndarray:
    """Counts (unit, 0 before / 1 after, class): how often a unit's neighbour is of a class."""
    units = vocabulary.units
    unit = np.concatenate([vocabulary.unit, [0, units - 1]]).astype(np.int64)  # the last two: places -2 and -1

    def run(batches):
        total = np.zeros(units * 2 * classes, np.int64)
        for batch in batches:
            for _, _, place in _slices(batch.column(0)):
                u = unit[place]
                c = of[u]
                np.add.at(total, u[1:] * (2 * classes) + c[:-1], 1)
                np.add.at(total, u[:-1] * (2 * classes) + classes + c[1:], 1)
        yield from _cells(total)

    return _summed(train.select("places").mapInArrow(frugal(run), "key long, n long"), units * 2 * classes).reshape(units, 2, classes)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(near: np.ndarray, of: np.ndarray, classes: int, may: np.ndarray, steps: int = STEPS, fixed: int = 1) -> tuple[np.ndarray, int]:
    """Moves the units of ``may`` to the classes that raise the likelihood most; no unit enters or leaves the last ``fixed`` ones."""
    before, after = near[:, 0].astype(float), near[:, 1].astype(float)
    n, of, moved = after.sum(axis=1), of.copy(), 0
    pair = np.zeros((classes, classes))
    np.add.at(pair, of, after)
    size = np.bincount(of, weights=n, minlength=classes)
    order = np.argsort(-n, kind="stable")
    order = order[(of[order] < classes - fixed) & (n[order] > 0) & may[order]]
    # Frequent units go in small parts, as each may change what the next ones see.
    bounds = np.unique(np.concatenate([[0], (np.linspace(0, 1, steps + 1)[1:] ** 2 * len(order)).astype(int)]))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        for u in np.array_split(order[a:b], max(1, (b - a) // 64)):
            own, row = of[u], np.arange(len(u))
            gain = np.zeros((len(u), classes))
            for c in range(classes - fixed):
                gain[:, c] = (_f(pair[c] + after[u]) - _f(pair[c])).sum(axis=1) + (_f(pair[:, c] + before[u]) - _f(pair[:, c])).sum(axis=1) - 2 * (_f(size[c] + n[u]) - _f(size[c]))
            gain[:, classes - fixed :] = -np.inf
            left_r, left_c = np.maximum(pair[own] - after[u], 0), np.maximum(pair[:, own].T - before[u], 0)
            stay = (_f(pair[own]) - _f(left_r)).sum(axis=1) + (_f(pair[:, own].T) - _f(left_c)).sum(axis=1) - 2 * (_f(size[own]) - _f(size[own] - n[u]))
            gain[row, own] = stay
            to = gain.argmax(axis=1)
            go = gain[row, to] > stay + 1e-9
            x, a_, b_ = u[go], own[go], to[go]
            np.subtract.at(pair, a_, after[x])
            np.add.at(pair, b_, after[x])
            pair = pair.T.copy()
            np.subtract.at(pair, a_, before[x])
            np.add.at(pair, b_, before[x])
            pair = np.maximum(pair.T, 0).copy()
            size += np.bincount(b_, weights=n[x], minlength=classes) - np.bincount(a_, weights=n[x], minlength=classes)
            of[x] = b_
            moved += len(x)
    return of, moved


def _own_moves(train: DataFrame, vocabulary: Vocabulary, of: np.ndarray, near: np.ndarray, classes: int) -> DataFrame:
    """h, class of every word that was not exchanged: where its own neighbours raise the likelihood most.

    Each such word leaves the class of all others, which is the same loss wherever it goes."""
    end, rest, total = classes, classes + 1, classes + 2
    unit = np.concatenate([vocabulary.unit, [0, vocabulary.units - 1]])

    def neighbours(batches):
        for batch in batches:
            others = batch.column(1)
            for start, n, place in _slices(batch.column(0)):
                c = of[unit[place]]
                h = np.zeros(len(place), np.int64)
                h[place >= 0] = vocabulary.h[place[place >= 0]]
                h[place == -1] = others.slice(start, len(n)).flatten().to_numpy(zero_copy_only=False)
                at = np.flatnonzero(c == rest)
                k = c[at - 1] * total + c[at + 1]
                order = np.lexsort((k, h[at]))
                own, k = h[at][order], k[order]
                cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (k[1:] != k[:-1])])) if len(k) else np.empty(0, np.int64)
                n = np.diff(np.append(cut, len(k)))
                yield pa.RecordBatch.from_arrays([pa.array(own[cut]), pa.array(k[cut].astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "k", "n"])

    pair = np.zeros((total, total))
    np.add.at(pair, of, near[:, 1].astype(float))
    size = np.bincount(of, weights=near[:, 1].sum(axis=1), minlength=total)[:classes]
    # Cells that a move to a class adds to: after a class (rows below total), then before it.
    cells = np.concatenate([pair[:, :classes], pair[:classes].T])
    table = np.stack([_f(cells + n) - _f(cells) for n in range(TABLED + 1)])

    def choose(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column(1)
            k, n = (found.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            starts = found.offsets.to_numpy().astype(np.int64)
            starts = starts[:-1] - starts[0]
            gain = -2 * (_f(size + np.add.reduceat(n, starts)[:, None]) - _f(size))
            for side in (k // total, total + k % total):
                part = table[np.minimum(n, TABLED), side]
                many = n > TABLED
                part[many] = _f(cells[side[many]] + n[many, None]) - _f(cells[side[many]])
                gain += np.add.reduceat(part, starts, axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain.argmax(axis=1).astype(np.int32))], names=["h", "class"])

    rows = train.select("places", "other").mapInArrow(frugal(neighbours), "h long, k int, n long").repartition("h")
    # One key's rows are in one partition: at most total * total of them leave the sum.
    rows = rows.groupBy("h", "k").agg(F.sum("n").alias("n")).groupBy("h").agg(F.collect_list(F.struct("k", "n")).alias("near"))
    return rows.mapInArrow(frugal(choose), "h long, class int")


class Model(NamedTuple):
    """What scores need: all words (h, c, class; the end's class is ``classes``), and small arrays of the classes.

    ``step`` holds log10 of a class after a class, and ``emit`` what a word's log10(c + 0.5) loses in its class; index
    ``classes + 1`` stands for words that training lacks."""

    words: DataFrame
    vocabulary: Vocabulary
    place_class: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    tokens: int
    distinct: int
    end_count: int


def _others(encoded: DataFrame, place_class: np.ndarray, classes: int, words: DataFrame) -> DataFrame:
    """rid, held_out, c, x, l, r for each word that is not frequent: its count and class, and its neighbours' classes.

    ``r`` is null where the next word isn't frequent either: that word's row has the transition."""
    unknown, base = classes + 1, classes + 2
    of = np.concatenate([place_class, [classes, -1]])  # the last two: places -2 and -1

    def run(batches):
        for batch in batches:
            others = batch.column(3)
            for start, n, place in _slices(batch.column(2)):
                at = np.flatnonzero(place == -1)
                h = others.slice(start, len(n)).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(start, start + len(n)), n + 1)[at - 1]
                left, right = of[place[at - 1]], of[place[at + 1]]
                before = np.concatenate([[0], h[:-1]]) if len(h) else h
                row = pa.array(row)
                out = pc.fill_null(batch.column(1), True).take(row).to_numpy(zero_copy_only=False).astype(np.int64)
                near = ((left + 1) * base + right + 1) * 2 + out
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(h), pa.array(before, mask=left >= 0), pa.array(near)], names=["rid", "h", "a", "near"])

    known = words.select("h", "c", F.col("class").alias("x"))
    rows = encoded.select("rid", "held_out", "places", "other").mapInArrow(frugal(run), "rid long, h long, a long, near long")
    joined = rows.join(known.hint("shuffle_hash"), "h", "left")
    # ``near`` holds both neighbours' classes (0: not frequent) and whether the row is held out, to shuffle less.
    side = lambda x: F.nullif(x, F.lit(0)).cast("int") - 1
    near = F.shiftright("near", 1)
    rows = joined.select(
        "rid", (F.col("near") % 2 == 1).alias("held_out"), F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("x", F.lit(unknown)).alias("x"),
        "a", side(F.floor(near / base)).alias("l"), side(near % base).alias("r"),
    )
    # Rows stay as they are written first; only those that meet another such word are joined and written again.
    first = written(rows, "other-words")
    before = words.select(F.col("h").alias("a"), F.col("class").alias("y"))
    met = first.where("a is not null").join(before.hint("shuffle_hash"), "a", "left").withColumn("l", F.coalesce("y", F.lit(unknown)))
    met = written(met.select("rid", "held_out", "c", "x", "l", "r"), "met-words")
    return first.where("a is null").select("rid", "held_out", "c", "x", "l", "r").unionByName(met)


def train(docs: DataFrame, held_out: Column, classes: int = CLASSES, rounds: int = ROUNDS, log: Callable | None = None) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows where ``held_out`` is false, the encoded documents, and their words that are not frequent."""
    with swept(docs.sparkSession):
        return _train(docs, held_out, classes, rounds, log)


def _train(docs: DataFrame, held_out: Column, classes: int, rounds: int, log: Callable | None) -> tuple[Model, DataFrame, DataFrame]:
    counts = _word_counts(docs.where(~held_out))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    frequent = counts.where((F.col("c") >= max(1.0, FREQUENT * tokens)) | (F.col("h") == END)).select("h", "c").toArrow()
    vocabulary = Vocabulary(frequent.column("h").to_numpy(), frequent.column("c").to_numpy(), tokens)
    encoded = _encoded(docs, held_out, vocabulary)
    seen = encoded.where(~F.col("held_out"))
    end, total = classes, classes + 2
    of = np.random.default_rng(3).integers(0, classes, vocabulary.units).astype(np.int64)
    of[0], of[-1] = end, classes + 1
    near = _neighbours(seen, vocabulary, of, total)
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        of, moved = exchange(near, of, total, rng.random(len(of)) < MOVING, fixed=2)
        near = _neighbours(seen, vocabulary, of, total)
        if log:
            pair = np.zeros((total, total))
            np.add.at(pair, of, near[:, 1].astype(float))
            log(moved, (_f(pair).sum() - 2 * _f(pair.sum(axis=1)).sum()) / max(tokens, 1) / np.log(10))
        if moved < 0.01 * vocabulary.alone:
            break
    # Classes of all words: those exchanged (bounded, from the driver), the end, and all others.
    alone = vocabulary.unit <= vocabulary.alone
    exchanged = pa.table({"h": vocabulary.h[alone], "class": of[vocabulary.unit[alone]].astype(np.int32)})
    moves = _own_moves(seen, vocabulary, of, near, classes)
    moves = moves.unionByName(docs.sparkSession.createDataFrame(exchanged))
    words = written(counts.join(moves.hint("shuffle_hash"), "h").select("h", "c", "class"), "word-classes")
    discard(counts)
    got = words.where((F.col("c") >= max(1.0, FREQUENT * tokens)) | (F.col("h") == END)).select("h", "class").toArrow()
    place_class = np.zeros(len(vocabulary.h), np.int64)
    place_class[vocabulary.places(got.column("h").to_numpy())] = got.column("class").to_numpy()
    others = _others(encoded, place_class, classes, words)
    pair = _transitions(seen, others.where(~F.col("held_out")), place_class, classes)
    size = pair.sum(axis=0)
    members = np.zeros(classes + 1)
    for r in words.groupBy("class").count().collect():
        members[r["class"]] = r["count"]
    step, emit = probabilities(pair, size, members)
    end_count = int(vocabulary.c[vocabulary.h == END].sum())
    return Model(words, vocabulary, place_class, step, emit, tokens, distinct, end_count), encoded, others


def probabilities(pair: np.ndarray, size: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """step and emit of a Model, from the counts of class after class, and each class's tokens and distinct words.

    A class gives an unknown word the share 0.5 / (tokens + 0.5 * (words + 1)), so over all words and unknown ones
    the probabilities after any class add up to one. The end is the only word of the last class."""
    n = len(size)
    share = (size + 0.5) / (size.sum() + 0.5 * n)
    step = (pair + PRIOR * share) / (pair.sum(axis=1, keepdims=True) + PRIOR)
    whole = size + 0.5 * (members + 1)
    room = np.append(0.5 / whole[:-1], 0.0)
    full = np.zeros((n + 1, n + 1))
    full[:n, :n], full[:n, n] = step, step @ room
    mixed = share * room / (share * room).sum()
    full[n] = mixed @ full[:n]
    # An unknown word's count is 0, so its log10(0 + 0.5) is taken back.
    return np.log10(full), np.concatenate([np.log10(whole[:-1]), [0.0, np.log10(0.5)]])


def _transitions(seen: DataFrame, others: DataFrame, place_class: np.ndarray, classes: int) -> np.ndarray:
    """How often each class follows each class in the training documents."""
    total, of = classes + 1, np.concatenate([place_class, [classes, -1]])

    def run(batches):
        out = np.zeros(total * total, np.int64)
        for batch in batches:
            for _, _, place in _slices(batch.column(0)):
                c = of[place]
                both = (c[:-1] >= 0) & (c[1:] >= 0)
                out += np.bincount((c[:-1] * total + c[1:])[both], minlength=len(out))
        yield from _cells(out)

    def joined(batches):
        out = np.zeros(total * total, np.int64)
        for batch in batches:
            l, x, r = (pc.fill_null(c, -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)  # noqa: E741
            for a, b in ((l, x), (x, r)):
                both = (a >= 0) & (b >= 0)
                out += np.bincount((a * total + b)[both], minlength=len(out))
        yield from _cells(out)

    local = seen.select("places").mapInArrow(frugal(run), "key long, n long")
    met = others.select("l", "x", "r").mapInArrow(frugal(joined), "key long, n long")
    return _summed(local.unionByName(met), total * total).reshape(total, total).astype(float)


def score(docs: DataFrame, held_out: Column, classes: int = CLASSES, rounds: int = ROUNDS, log: Callable | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity: one row for each row.

    The model learns from the rows where ``held_out`` is false; scores are log10 probabilities."""
    return applied(*train(docs, held_out, classes, rounds, log))


def applied(model: Model, encoded: DataFrame, others: DataFrame) -> DataFrame:
    """Scores of the encoded documents (see ``score``)."""
    step, emit, total = model.step, model.emit, len(model.emit)
    base_log = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    end_log = float(np.log10(model.end_count + 0.5))
    of = np.concatenate([model.place_class, [total - 2, -1]])
    own = np.concatenate([np.log10(model.vocabulary.c + 0.5), [end_log, 0.0]])

    def run(batches):
        for batch in batches:
            for start, n, place in _slices(batch.column(3)):
                c, row = of[place], np.repeat(np.arange(len(n)), n + 1)  # row of each token but the first end
                both = (c[:-1] >= 0) & (c[1:] >= 0)
                # The end's class holds nothing else; a word's log is its count's less its class's.
                lost = np.where((c[1:] >= 0) & (place[1:] != END_AT), emit[c[1:]], 0.0)
                counted, words = own[place[1:]], place[1:] >= 0
                path = np.where(both, step[c[:-1], c[1:]], 0.0) - lost
                path += np.where(words, counted, 0.0)
                rows = batch.slice(start, len(n))
                sums = [np.bincount(row, weights=w, minlength=len(n)) for w in (counted, path)]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(3)), pa.array(sums[0]), pa.array(sums[1]), pa.array(np.bincount(row, weights=words, minlength=len(n)).astype(np.int64)), pa.array((n + 1).astype(np.int64))],
                    names=["rid", "doc_id", "held_out", "log_sum", "path", "n_frequent", "n_tokens"],
                )

    local = encoded.select("rid", "doc_id", "held_out", "places").mapInArrow(frugal(run), "rid long, doc_id long, held_out boolean, log_sum double, path double, n_frequent long, n_tokens long")
    steps, emits = F.lit(step.ravel().tolist()), F.lit(emit.tolist())
    at = lambda a, b: F.get(steps, a * total + b)
    word = F.log10(F.col("c") + 0.5)
    sums = others.select("rid", "c", word.alias("word"), (at(F.col("l"), F.col("x")) + F.coalesce(at(F.col("x"), F.col("r")), F.lit(0.0)) + word - F.get(emits, F.col("x"))).alias("step"))
    sums = sums.groupBy("rid").agg(F.sum("word").alias("other_log"), F.sum("step").alias("other_path"), F.count_if(F.col("c") > 0).alias("n_other"))
    none = F.lit(0.0)
    scored = local.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_frequent") + F.coalesce("n_other", F.lit(0)) + int(model.end_count > 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("other_log", none) - F.col("n_tokens") * base_log).alias("base_score"),
        (F.col("path") + F.coalesce("other_path", none)).alias("score"),
    )
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
