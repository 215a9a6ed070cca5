"""The pipeline: each stage and the whole chain against brute force, and the cases its stages define."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partita.llm import mixing, packing, pii
from partita.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def prose(rng):
    return "\n".join(words(rng, 12) + "." for _ in range(rng.randrange(3, 9)))


def junk(rng):
    return "\n".join("BUY!! " * 4 + "| " * 5 + str(rng.randrange(99)) for _ in range(5))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents and labels: good, bad, copied and near-copied texts, with personal data."""
    rng = random.Random(21)
    texts = [junk(rng) if i % 4 == 0 else prose(rng) + (f"\nmail u{i}@host.example.org or 10.0.{i % 250}.7 now." if i % 3 == 0 else "") for i in range(160)]
    texts += [texts[1], texts[1], texts[2].replace("w1", "w1", 1), " ".join(words(rng, 300).split())]
    texts += [texts[-1] + " more"]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_every_stage_and_the_chain_match_brute_force(spark, tables):
    folder, rows = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "near-duplicates", "personal data", "mix", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    good = stages["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns
    kept = {r["doc_id"]: r for r in good.collect()}
    assert set(kept) == {r[0] for r in rows if not r[1].startswith("BUY")}

    one = stages["near-duplicates"](spark, good, folder)
    seen, want = [], set()
    for i in sorted(kept):  # no chain of near copies here: the first of each group stays
        s = shingles(kept[i]["text"])
        if not any(100 * len(s & t) >= 75 * len(s | t) for t in seen):
            want.add(i)
        seen.append(s)
    single = {r["doc_id"]: r for r in one.collect()}
    assert set(single) == want and one.columns == docs.columns

    clean = stages["personal data"](spark, one, folder)
    assert clean.columns == docs.columns
    texts = {}
    for r in clean.collect():
        before = single[r["doc_id"]]["text"]
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.base_spans(before):
            assert r["text"] == before
        else:
            assert "[EMAIL]" in r["text"] and "[IP]" in r["text"]
        texts[r["doc_id"]] = r

    mixed = stages["mix"](spark, clean, folder)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    sizes, taken = Counter(), Counter()
    for i, r in texts.items():
        sizes[r["source"]] += len(r["text"].split())
        taken[r["source"]] += copies[i] * len(r["text"].split())
    for s, target in mixing.quotas(dict(sizes)).items():
        assert abs(taken[s] - target) <= max(len(r["text"].split()) for r in texts.values())
    assert max(copies.values()) <= 3

    def packed_pieces(found):
        places = {}
        for r in found:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in places.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 4096
        return Counter((r["doc_id"], r["piece"], r["length"]) for r in found), len(places)

    encoder = packing.Encoder(tokenizer_path()).tokenizer
    tokens = {i: len(encoder.encode(texts[i]["text"], add_special_tokens=False).ids) + 1 for i in copies}
    want = Counter()
    for i, n in copies.items():
        want.update({(i, k, min(4096, tokens[i] - 4096 * k)): n for k in range(-(-tokens[i] // 4096))})
    got, sequences = packed_pieces(stages["packing"](spark, mixed, folder).collect())
    assert got == want and sequences <= math.ceil(sum(n * tokens[i] for i, n in copies.items()) / 4096) + 1
    assert packed_pieces(corpus_pipeline.run(spark, folder).collect())[0] == want


def test_stages_take_nulls_empty_tables_repeats_and_clashing_names(spark, tables):
    folder, _ = tables
    rng = random.Random(5)
    rows = [(1, None, None, None, None), (None, "no id here at all, only words. " * 5, "en", "a", 1), (2, "", "en", None, 0), (3, prose(rng), "en", "a", 5), (3, prose(rng), "en", "a", 5), (4, words(rng, 30_000), None, "b", 9)]
    odd = spark.createDataFrame(rows + rows[3:4], COLUMNS)
    names = ["path", "key", "label", "size", "__size", "__uses", "uses", "row", "m", "whole", "id", "sequence_id", "piece", "score"]
    odd = odd.withColumns({n: F.lit("x") for n in names})
    for frame in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, frame, folder)
            ids = [r["doc_id"] for r in found.collect()]
            assert set(ids) <= {r["doc_id"] for r in frame.collect()}, name
            if name != "packing":
                assert found.columns == frame.columns, name
            elif frame is odd:
                assert {1, 2, 3, 4, None} == set(ids)
