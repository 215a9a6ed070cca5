"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. A line's evidence is its own features and those of the lines around it; the
chain's transitions tie neighbouring labels. Forward-backward gives each line's marginal, and a
document's score is the mean marginal of good weighted by line length. The weights maximise the
likelihood of labelled documents (each line carries its document's label) with an L2 penalty.

The fit takes at most SAMPLE labelled documents, chosen by the smallest hashes of doc_id; scoring takes
every row. Only the text is looked at.

Defined cases: a null or empty text is one empty line; a document with several labels counts with each
at the same time (their mean decides); null labels are left out; without any label every score is 0.5;
repeated rows are scored one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back
from .words import chunks, encode

SAMPLE = 4000
THRESHOLD = 0.7
KINDS = 10
#: Weight of the transitions' squares against the likelihood.
PAIR_PENALTY = 0.05
STEPS = 120


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)  # 0: letters and all bytes beyond ASCII
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[[9, 11, 12, 13, 32]] = 3
    for kind, chars in ((4, "#*$%&"), (5, "|<>{}[]\\/=_~^"), (6, ".,;:'\"()-"), (7, "!?"), (8, "@+`")):
        table[[ord(c) for c in chars]] = kind
    table[10] = 9
    return table


CLASSES = _classes()


def _repeats(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The share of each line's words that equal the word one, two or three places before in the line."""
    n = np.diff(ends)
    line = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), 3))
    for lag in (1, 2, 3):
        same = (codes[lag:] == codes[:-lag]) & (line[lag:] == line[:-lag])
        out[:, lag - 1] = np.bincount(line[lag:][same], minlength=len(n)) / np.maximum(n, 1)
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines' features with their neighbours', their lengths in bytes, and the lines' ends by text (rows + 1)."""
    lists = pc.split_pattern(texts, "\n")
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    n = len(flat)
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(x.as_buffer() for x in flat if x.as_buffer() is not None), np.uint8)
    line = np.repeat(np.arange(n, dtype=np.int64), size)
    count = np.bincount(line * KINDS + CLASSES[raw], minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(ends))
    codes = pc.dictionary_encode(flat).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    _, place, times = np.unique(text_of * (n + 1) + codes, return_inverse=True, return_counts=True)
    words = count[:, 3] + 1
    again = np.concatenate([np.zeros((0, 3)), *(_repeats(w.codes, w.offsets) for w in encode(flat, size=1 << 62))])
    some = np.maximum(size, 1)
    own = np.stack(
        [
            np.log1p(size) / 5, np.log1p(words) / 4, np.minimum(size / words, 30) / 10, size < 20,
            count[:, 1] / some, count[:, 2] / some, np.minimum(count[:, 4] / words, 4), np.minimum(count[:, 5] / words, 4),
            np.minimum(count[:, 6] / words, 3), np.minimum(count[:, 7] / words, 3), count[:, 8] / some,
            (times[place] > 1) & (size > 0), np.minimum(times[place], 10) / 5 * (size > 0),
            again[:, 0], again[:, 1], again[:, 2], again[:, 0] > 0.2,
            count[:, 1] > 0.4 * some, count[:, 4] > 0.3 * words, count[:, 5] > 0.3 * words, size == 0,
        ],
        axis=1,
    )
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[ends[:-1]] = True  # every text has a line at least
    last[ends[1:] - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    doc = np.log1p(np.diff(ends))[text_of] / 3
    return np.column_stack([own, before, after, first, last, doc, np.ones(n)]), size, ends


def marginals(unary: np.ndarray, ends: np.ndarray, pair: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(line is good), expected transitions summed (2 x 2; texts by ``weight``), log partition of each text.

    ``unary`` is the score of good over bad. All texts advance together, the longest first."""
    size = np.diff(ends)
    weight = np.ones(len(size)) if weight is None else weight
    order = np.argsort(-size, kind="stable")
    start, size_ = ends[:-1][order], size[order]
    longest = int(size_[0]) if len(size_) else 0
    active = np.searchsorted(-size_, -np.arange(longest), "left")  # texts with more than t lines
    e = np.exp(pair)
    top = np.maximum(unary, 0)
    emit = np.stack([np.exp(-top), np.exp(unary - top)], axis=1)
    alpha, beta, scale = np.empty((len(unary), 2)), np.empty((len(unary), 2)), np.empty(len(unary))
    for t in range(longest):
        at = start[: active[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ e) * emit[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at, None]
    trans = np.zeros((2, 2))
    for t in range(longest - 1, -1, -1):
        k = active[t + 1] if t + 1 < longest else 0
        at = start[: active[t]] + t
        beta[at[k:]] = 1
        if k:
            ahead = emit[at[:k] + 1] * beta[at[:k] + 1] / scale[at[:k] + 1, None]
            beta[at[:k]] = ahead @ e.T
            trans += ((alpha[at[:k]] * weight[order[:k], None]).T @ ahead) * e
    return alpha[:, 1] * beta[:, 1], trans, np.add.reduceat(np.log(scale) + top, ends[:-1]) if len(size) else np.empty(0)


def objective(w: np.ndarray, pair: np.ndarray, x: np.ndarray, ends: np.ndarray, labels: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """The penalized mean log likelihood of a text's labels for each line, and its gradient by ``w`` and ``pair``.

    Each text counts alike, however many lines it has: lines and transitions both weigh 1 / its lines. All
    lines of a text have its label; a label between 0 and 1 is that share of the one and of the other."""
    n = np.diff(ends)
    each = 1 / (n * max(len(n), 1))
    unary = x @ w
    p, trans, log_z = marginals(unary, ends, pair, each)
    seen = np.array([[((1 - labels) * (n - 1) * each).sum(), 0], [0, (labels * (n - 1) * each).sum()]])
    value = (np.add.reduceat(unary, ends[:-1]) * labels * each).sum() + (seen * pair).sum() - (log_z * each).sum()
    value -= penalty / 2 * (w**2).sum() + PAIR_PENALTY / 2 * (pair**2).sum()
    return value, np.concatenate([x.T @ ((np.repeat(labels, n) - p) * np.repeat(each, n)) - penalty * w, (seen - trans - PAIR_PENALTY * pair).ravel()])


def fit(texts: list[str], labels: np.ndarray, penalty: float = 1e-3, steps: int = STEPS) -> dict:
    """Weights, transitions (-2 to 2) and scaling by ascent of ``objective`` with adaptive steps."""
    x, _, ends = features(pa.array(texts, pa.string()))
    mean, dev = x.mean(axis=0), x.std(axis=0)
    dev[dev < 1e-6], mean[-1] = 1, 0
    x = (x - mean) / dev
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    for step in range(1, steps + 1):
        _, grad = objective(w, pair, x, ends, labels, penalty)
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, pair = w + move[:-4], np.clip(pair + move[-4:].reshape(2, 2), -2, 2)
    return {"w": w, "pair": pair, "mean": mean, "dev": dev}


def document_scores(texts: pa.Array, model: dict | None) -> np.ndarray:
    out = [np.empty(0)]
    for _, part in chunks(texts):
        if model is None:
            out.append(np.full(len(part), 0.5))
            continue
        x, size, ends = features(part)
        p, _, _ = marginals(((x - model["mean"]) / model["dev"]) @ model["w"], ends, model["pair"])
        weight = size + 1.0
        out.append(np.add.reduceat(p * weight, ends[:-1]) / np.add.reduceat(weight, ends[:-1]))
    return np.clip(np.concatenate(out), 0, 1)


def remainder(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(mod))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, label: str = "quality", sample: int = SAMPLE) -> dict | None:
    """The model from at most ``sample`` labelled documents where ``train_on`` (of doc_id) holds."""
    chosen = (
        labels.where(train_on & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    model = fit([r["text"] for r in rows], np.array([r["y"] for r in rows]))
    del rows
    give_back()
    return model


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, score: one row for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(document_scores(batch.column(1), model))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns; nothing is shuffled."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            keep = document_scores(batch.column(place), model) >= threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
