"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns' spans are the base and always stay. The field labels the tokens that could be personal
data at all (those with a digit or an at-sign; every other token is plain by definition) as email, ip,
card, phone or plain. Neighbouring candidates share a chain potential; occurrences of the same token
anywhere in the document, and of similar ones (equal digits or equal local parts), share a skip
potential: two directly, more through a hub that each is linked to, so that any two are two steps apart.
Loopy message passing spreads what one occurrence makes clear to the others. Tokens of a personal kind
outside base spans are added.

Weights come from pseudo-likelihood on at most SAMPLE documents, whose base spans are the labels.

Defined cases: a null or empty text has no spans; repeated rows are treated one by one; an empty table
gives an empty result; further columns are ignored; texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, give_back
from .words import chunks

KINDS = ["email", "ip", "card", "phone"]
K = len(KINDS) + 1  # the last is plain
SAMPLE = 3000
WIDTH = 512
#: Features of a token.
FEATURES = 10
SURE = 0.5
#: Most digits that tokens in a row may have as one span.
DIGITS = {"card": 19, "phone": 15}
ROUNDS = 8
#: Rounds of messages at most, and the change below which they have settled.
MOST_ROUNDS = 64
SETTLED = 1e-3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only: any later start would match as well, so none is lost.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'.,;:!?<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by kind as listed and then start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", token)))


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, token without edge punctuation, word before) of the tokens with a digit or an at-sign."""
    out, before = [], ""
    for m in TOKEN.finditer(text):
        token = m[0]
        if "@" in token or any("0" <= c <= "9" for c in token):
            core = token.strip(EDGES)
            a = m.start() + token.find(core) if core else m.start()
            out.append((a, a + len(core), core, before))
        before = token.lower()
    return out


def token_features(core: str, before: str) -> list[int]:
    """Hashed features: shape, length, counts and the word before."""
    digits = "".join(c for c in core if "0" <= c <= "9")
    found = [
        "bias", f"shape {shape(core)}", f"digits {min(len(digits), 20)}", f"dots {min(core.count('.'), 5)}", f"at {core.count('@')}",
        f"lead {core[:1] if not core[:1].isalnum() else 'w'}", f"luhn {len(digits) == len(core) and 13 <= len(digits) <= 19 and luhn(digits)}",
        f"parts {core.count('.') == 3 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in core.split('.'))}",
        f"hex {len(core) > 12 and any(c.isalpha() for c in core)}", f"before {shape(before)}",
    ]
    return [int.from_bytes(hashlib.blake2b(f.encode(), digest_size=4).digest(), "little") % WIDTH for f in found]


def graph(texts: list[str]) -> dict:
    """Candidate tokens of all texts with their features, chain edges, skip edges and links to hubs.

    A key's two occurrences share a skip edge, unless a chain edge joins them; more are linked to a hub of
    their own (token, hub), so the edges grow with the tokens and not with pairs."""
    doc, where, rows, chain, skip, hub, hubs = [], [], [], [], [], [], 0
    for d, text in enumerate(texts):
        members: dict[str, list[int]] = {}
        first_edge = len(chain)
        end = None
        for a, b, core, before in candidates(text):
            i = len(doc)
            doc.append(d)
            where.append((a, b))
            rows.append(token_features(core, before))
            if end is not None and a - end <= 3:
                chain.append((i - 1, i))
            digits = re.sub(r"\D", "", core)
            keys = {core.lower(), core.partition("@")[0].lower() if "@" in core else "", digits if len(digits) >= 7 else ""}
            for k in keys - {""}:
                members.setdefault(k, []).append(i)
            end = b
        joined_already = set(chain[first_edge:])
        for own in members.values():
            if len(own) > 2:
                hub += [(i, hubs) for i in own]
                hubs += 1
            elif len(own) == 2 and tuple(own) not in joined_already:
                skip.append(tuple(own))
    pairs = lambda e: np.array(e, dtype=np.int64).reshape(-1, 2)
    return {"doc": np.array(doc, dtype=np.int64), "where": where, "rows": np.array(rows, dtype=np.int64).reshape(len(doc), FEATURES), "chain": pairs(chain), "skip": pairs(skip), "hub": pairs(hub)}


def fit(texts: list[str], steps: int = 150) -> dict | None:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels."""
    g = graph(texts)
    if not len(g["doc"]):
        return None
    spans = [base_spans(t) for t in texts]
    y = np.full(len(g["doc"]), K - 1)
    for i, (d, (a, b)) in enumerate(zip(g["doc"], g["where"], strict=True)):
        for kind, s, e in spans[d]:
            if a < e and s < b:
                y[i] = KINDS.index(kind)
                break
    one = np.eye(K)[y]
    unary, chain, skip = np.zeros((WIDTH, K)), np.zeros((K, K)), np.zeros(K)
    left, right = g["chain"][:, 0], g["chain"][:, 1]
    near = np.zeros((len(y), K))
    np.add.at(near, g["skip"][:, 0], one[g["skip"][:, 1]])
    np.add.at(near, g["skip"][:, 1], one[g["skip"][:, 0]])
    if len(g["hub"]):  # a hub hands on the mean label of the other occurrences
        own, at = g["hub"].T
        total = np.zeros((int(at.max()) + 1, K))
        np.add.at(total, at, one[own])
        np.add.at(near, own, (total[at] - one[own]) / (np.bincount(at)[at] - 1)[:, None])
    rate, n = 0.5, len(y)
    for _ in range(steps):
        score = unary[g["rows"]].sum(axis=1) + near * skip
        np.add.at(score, right, one[left] @ chain)
        np.add.at(score, left, one[right] @ chain.T)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = one - p
        move = np.zeros_like(unary)
        for f in range(g["rows"].shape[1]):
            np.add.at(move, g["rows"][:, f], miss)
        unary += rate * (move / np.sqrt(n) / 4 - 0.002 * unary)
        chain += rate * ((one[left].T @ miss[right] + miss[left].T @ one[right]) / np.sqrt(n) / 4 - 0.05 * chain)
        skip += rate * ((near * miss).sum(axis=0) / np.sqrt(n) / 4 - 0.05 * (skip - 1.0))  # towards agreement
    return {"unary": unary, "chain": np.clip(chain, -2, 2), "skip": np.clip(skip, 0, 3)}


def beliefs(g: dict, model: dict) -> np.ndarray:
    """Marginals by loopy sum-product; all documents' graphs are passed over at once."""
    score = model["unary"][g["rows"]].sum(axis=1)
    tokens = len(score)
    if len(g["hub"]):
        score = np.concatenate([score, np.zeros((int(g["hub"][:, 1].max()) + 1, K))])
    same = np.concatenate([g["skip"], g["hub"] + [0, tokens]])
    edges = np.concatenate([g["chain"], same])
    if not len(edges):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)
    pair = np.concatenate([np.broadcast_to(np.exp(model["chain"]), (len(g["chain"]), K, K)), np.broadcast_to(np.exp(np.diag(model["skip"])), (len(same), K, K))])
    source, to = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), K))
    for r in range(MOST_ROUNDS):
        total = score.copy()
        np.add.at(total, to, message)
        out = total[source] - message[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        new = np.log(np.einsum("ek,ekl->el", out, pair) + 1e-300)
        new = 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
        change, message = np.abs(new - message).max(), new
        if r + 1 >= ROUNDS and change < SETTLED:
            break
    total = score.copy()
    np.add.at(total, to, message)
    total = total[:tokens]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def find(texts: list[str], model: dict | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if model is not None:
        g = graph(texts)
        if len(g["doc"]):
            p = beliefs(g, model)
            label = np.where(p[:, : K - 1].max(axis=1) >= SURE, p[:, : K - 1].argmax(axis=1), K - 1)
            for i in np.flatnonzero(label < K - 1).tolist():
                d, (a, b), kind = int(g["doc"][i]), g["where"][i], KINDS[label[i]]
                if b <= a or any(a < e and s < b for _, s, e in base[d]):
                    continue
                start = added[d][-1][1] if added[d] and added[d][-1][0] == kind and kind in DIGITS and a - added[d][-1][2] == 1 else a
                if start < a and sum("0" <= c <= "9" for c in texts[d][start:b]) <= DIGITS[kind]:
                    added[d][-1] = (kind, start, b)
                else:
                    added[d].append((kind, a, b))
    return [(b, b + a) for b, a in zip(base, added, strict=True)]


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model from at most ``sample`` documents with candidates, those with the smallest hashes of doc_id."""
    some = docs.where(F.regexp_like("text", F.lit("[0-9@]")))
    ids = F.broadcast(some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = some.select("doc_id", "text").join(ids, "doc_id").dropDuplicates(["doc_id"]).collect()
    model = fit([r["text"] for r in sorted(rows, key=lambda r: r["doc_id"])]) if rows else None
    del rows
    give_back()
    return model


def _found(texts: pa.Array, model: dict | None):
    """(rows with candidates, their texts, their spans) of each chunk; the rest of the rows have none."""
    for first, part in chunks(texts):
        hit = np.flatnonzero(pc.match_substring_regex(part, "[0-9@]").to_numpy(zero_copy_only=False))
        own = part.take(pa.array(hit)).to_pylist()
        yield first, part, hit, own, find(own, model)


def detect(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans, n_added."""
    none = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            counts, digest, spans, added = np.zeros((len(KINDS), n), np.int64), [none] * n, [""] * n, np.zeros(n, np.int64)
            for first, _, hit, _, found in _found(batch.column(1), model):
                for i, (base, every) in zip((hit + first).tolist(), found, strict=True):
                    if every:
                        for k, _, _ in base:
                            counts[KINDS.index(k), i] += 1
                        digest[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                        spans[i], added[i] = joined(every), len(every) - len(base)
            cols = [batch.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans), pa.array(added)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict | None) -> DataFrame:
    """``docs`` with every span replaced by its kind; all columns and rows stay."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(place)
            new = texts.to_pylist()
            for first, _, hit, own, found in _found(texts, model):
                for i, text, (_, every) in zip((hit + first).tolist(), own, found, strict=True):
                    if every:
                        new[i] = redacted(text, every)
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, texts.type))

    return docs.mapInArrow(frugal(run), docs.schema)
