"""Source audit, importance draw and token counts against brute force, and the cases their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from partita.llm import divergence, importance, token_counts
from partita.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, term string, score string, place string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "7") for r in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def audited(rows, least=10, top=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for _, text, lang, source in rows]
    within, counts, of_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        within[lang].update(set(terms))
        counts[lang, source].update(terms)
        of_lang[lang].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in within[lang].items() if n >= least]

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        own, q = {s: shares(c) for (k, s), c in counts.items() if k == lang}, shares(of_lang[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in own.items():
            pairs = [(sum(f(p[t], o[t]) for t in kept), i) for i, o in own.items() if i != s]
            terms = [(f(p[t], q[t]), t) for t in kept if counts[lang, s][t] and p[t] > q[t]]
            for part, found, last in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:last]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def audit_rows():
    rng = random.Random(4)
    vocabulary = [*(f"{a}{b}" for a in "abcdefgh" for b in "xyzé"), "Straße", "İx", "中文", "Ab", "aB"]
    rows = []
    for i in range(240):
        weights = [1 / (k + 1 + (i % 5) * (k % 3)) for k in range(len(vocabulary))]
        text = "".join(t + rng.choice([" ", "-", "7", "\n", "\x00", "_"]) for t in rng.choices(vocabulary, weights, k=rng.randrange(40)))
        rows.append((i, text, ("de", "en", None)[i % 3], f"s{i % 7}" if i % 11 else None))
    rows += [(900, None, "xx", "only null"), (901, "", "en", "empty"), (902, "12 34", "en", "digits"), (903, "one", None, ""), rows[5], rows[5]]
    return rows


def test_audit_equals_brute_force(spark, monkeypatch):
    rows = audit_rows()
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == audited(rows)
    # Many small blocks and tiles give the same sums.
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK", 5)
    assert sorted(map(tuple, divergence.audit(frame(spark, rows)).collect())) == audited(rows)


def test_audit_of_equal_values_expands_in_utf8_order(spark):
    terms = ["é", "z", "𝒜", "ｚ", "a", "B", "c", "d", "e", "f", "g", "h", "i"]
    rows = [(i, " ".join(terms), "en", "a") for i in range(12)] + [(20 + i, "other", "en", "b") for i in range(12)]
    got = sorted(map(tuple, divergence.audit(frame(spark, rows)).collect()))
    assert got == audited(rows)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1:3] == ("a", "term")] == sorted(map(lower, terms), key=str.encode)[:10]


def test_audit_without_kept_terms_and_of_nothing(spark):
    got = [tuple(r) for r in divergence.audit(frame(spark, [(1, "rare", "en", "a"), (2, "words", "en", "b"), (3, "x", "de", "a")])).collect()]
    assert sorted(got) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert divergence.audit(frame(spark, [])).count() == 0


def drawn(rows, target, most=1, buckets=importance.BUCKETS, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(b for r in rows for b in features(r[1])[1]), Counter(b for x in target for b in features(x)[1])
    of_s, of_t = sum(s.values()), sum(t.values())
    out = []
    for r in rows:
        words, found = features(r[1])
        gains = [math.floor(1000 * math.log((t[b] + 1) * (of_s + buckets) / ((s[b] + 1) * (of_t + buckets)))) for b in found]
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gains) // len(gains) if gains else 0
        out.append((r[0], len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    rank = {r: i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((r[0], *r[2:], rank.get(r)) for r in out), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_the_draw_equals_brute_force(spark, most):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["Tor ", "ab-", "9 ", "déjà\t", "中", "x" * rng.randrange(1, 300) + " "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(800, None, None, None), (801, "", "", ""), (None, "some words", "", ""), (802, "--- !!", "", "")]
    target = ["Tor tor TOR 9 99", None, "", "déjà vu " * 50]
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    got = importance.resample(frame(spark, rows), goal, most=most, percent=30)
    assert sorted(map(tuple, got.collect()), key=str) == drawn(rows, target, most, percent=30)


def test_draws_of_nothing_and_towards_nothing(spark):
    goal = spark.createDataFrame([], "text string")
    assert importance.resample(frame(spark, []), goal).count() == 0
    rows = [(i, f"word{i % 4} " * (i % 40), "en", "a") for i in range(90)]
    assert sorted(map(tuple, importance.resample(frame(spark, rows), goal).collect()), key=str) == drawn(rows, [])
    # Repeated rows each have a rank of their own.
    got = importance.resample(frame(spark, [(7, "same words " * 10, "en", "a")] * 40), goal, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21))


def test_crcs_by_column_equal_crcs_by_string(monkeypatch):
    rng = random.Random(2)
    strings = ["", *("".join(chr(rng.choice([97, 233, 0x4E2D, 0x1F600])) for _ in range(rng.randrange(60))) for _ in range(500)), "long " * 40_000]
    want = [zlib.crc32(s.encode()) for s in strings]
    assert importance.crc32s(pa.array(strings)).tolist() == want
    assert importance.crc32s(pa.array(strings).slice(3, 90)).tolist() == want[3:93]
    monkeypatch.setattr(importance, "MATRIX_BYTES", 64)
    assert importance.crc32s(pa.array(strings)).tolist() == want
    assert importance.crc32s(pa.array([], pa.string())).tolist() == []


PIECES = [
    "<|endoftext|>", "<|startoftext|>", " ", "\n\t ", "'s", "'re", "it's", "é", "é", "́" * 30, "한", "각", "中文字符", "ß", "İ", "\U0001f600",
    "123", "!!!!!", "<|endof", "aaaa", "abcdefgh", " ", "'", "’s", "ﬁ", "\u0000",
]


def odd_text(rng, n):
    return "".join(rng.choice(PIECES) * (1 if rng.random() < 0.7 else rng.randrange(1, 40)) for _ in range(n))


def test_spliced_counts_equal_the_tokenizer():
    model, rng = token_counts.load(tokenizer_path()), random.Random(5)
    texts = [odd_text(rng, rng.randrange(20, 300)) for _ in range(60)]
    texts += ["a" * 4000, "ab" * 3000, "!" * 3000, " " * 3000, " " * 3000 + "end", "́" * 1500, "".join(rng.choice("abc") for _ in range(6000)), "中" * 3000]
    for text in texts:
        want = len(model.encode(text, add_special_tokens=False))
        for chunk, overlap in ((200, 40), (300, 140), (1000, 200)):
            assert token_counts.count(model, text, chunk, overlap) == want


def test_splices_are_used_and_widened(monkeypatch):
    model, lengths = token_counts.load(tokenizer_path()), []
    part = token_counts._Part
    monkeypatch.setattr(token_counts, "_Part", lambda m, text, a, b: lengths.append(b - a) or part(m, text, a, b))
    plain = "plain words of a text " * 500
    assert token_counts.count(model, plain, 1000, 200) == len(model.encode(plain, add_special_tokens=False))
    assert max(lengths) == 1000 and len(lengths) == 14
    # White space over the whole overlap: it is widened, and the text is not encoded at once.
    lengths.clear()
    gap = "words before " * 300 + " " * 700 + "words behind " * 300
    assert token_counts.count(model, gap, 1000, 200) == len(model.encode(gap, add_special_tokens=False))
    assert len(gap) > max(lengths) >= 1000


def test_token_counts_of_odd_rows(spark):
    model = token_counts.load(tokenizer_path())
    rows = [(1, None, "", ""), (2, "", "", ""), (3, "Two words", "", ""), (3, "Two words", "", ""), (None, "no id é", "", ""), (5, "long text 中 " * 9000, "", ""), (6, "<|endoftext|>", "", "")]
    got = token_counts.token_counts(frame(spark, rows), tokenizer_path(), limit=3, chunk=5000, overlap=300)
    want = [(i, len((t or "").encode()), n := len(model.encode(t or "", add_special_tokens=False)), n > 3) for i, t, *_ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(frame(spark, []), tokenizer_path()).count() == 0


def test_tokenizers_without_proven_splices_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
