"""The ten operators on small tables: brute force, round trips, and the cases their docstrings define."""

import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partita.llm import ann, html_extract, lm_scoring, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, sharding
from partita.llm.queries import tokenizer_path

#: The columns of documents, and one that clashes with names used inside the operators.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, label string, path string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(1)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    base = words(rng, 200)
    near = base.split()
    near[20] = "changed"
    texts += [base, base, " ".join(near), None, "", " \n\t ", "one two", "One  TWO", words(rng, 9000), "ties ties ties"]
    return [(i, t, ("en", "de", None)[i % 3], ("a", "b", "b", "b", None)[i % 5], 0, "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame(rows + rows[:1], SCHEMA).cache()  # one row twice


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_near_equal_and_keep_copies_together(docs, none):
    got = sharding.kd_shards(docs, 4).collect()
    assert len(got) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    where = {}
    for r in got:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    heaviest = max(len(t.encode()) + 1 for t in texts.values())
    total, load = sum(r["size"] for r in got), Counter()
    for r in got:
        load[r["shard"]] += r["size"]
    assert all(len(v) == 1 for v in where.values())
    assert max(load.values()) <= max(heaviest, total / 4 * 1.2)
    assert sharding.kd_shards(none, 4).count() == 0


def test_a_text_that_outweighs_a_shard_is_spread(spark):
    rows = [(i, "copy " * 20 if i % 3 else f"text {i} " * 3, "en", "a", 0, "", "", "") for i in range(400)]
    load = Counter()
    for r in sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 8).collect():
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) < 1.6 * sum(load.values()) / 8


def test_cuts_follow_a_brute_force_tree(spark):
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randrange(3, 90), 5000), rng.choice(("de", "en", "fr", None)), f"s{rng.randrange(30):02}", 0, "", "", "") for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(frame, 8).collect()}
    size = {r[0]: len(r[1].encode()) + 1 for r in rows}
    total = sum(size.values())
    values = {r[0]: (size[r[0]], (r[2] is not None, r[2] or ""), r[3]) for r in rows}
    scale = [{}, {}, {}]
    least, most = min(size.values()), max(size.values())
    for d in range(3):
        at = 0
        for v in sorted({x[d] for x in values.values()}):
            w = sum(size[i] for i, x in values.items() if x[d] == v)
            scale[d][v] = math.log(v / least) / math.log(most / least) if d == 0 else (at + w / 2) / total
            at += w

    def width(ids, d):
        n = sum(size[i] for i in ids)
        mean = sum(size[i] * scale[d][values[i][d]] for i in ids) / n
        return sum(size[i] * (scale[d][values[i][d]] - mean) ** 2 for i in ids) / n

    def check(ids, first, leaves):
        """A node is cut across the dimension of the largest deviation; only points of one value lie on both sides."""
        if leaves == 1:
            return
        left, right = [i for i in ids if got[i] < first + leaves // 2], [i for i in ids if got[i] >= first + leaves // 2]
        assert abs(sum(size[i] for i in left) - sum(size[i] for i in ids) / 2) < 0.01 * total / 8 + 700
        widest = max(range(3), key=lambda d: width(ids, d))
        assert max(values[i][widest] for i in left) <= min(values[i][widest] for i in right)
        check(left, first, leaves // 2)
        check(right, first + leaves // 2, leaves // 2)

    check(sorted(got), 0, 8)


def test_heavy_texts_fall_where_the_cut_says(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 1 + int(3 * rng.paretovariate(0.9)) % 4000, 5000), "en", f"s{rng.randrange(200):03}", 0, "", "", "") for i in range(1500)]
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    size, source = {r[0]: len(r[1].encode()) + 1 for r in rows}, {r[0]: r[3] for r in rows}
    total = sum(size.values())
    heavy = [i for i, s in size.items() if s > total / 400]
    assert sum(size[i] for i in heavy) > 0.4 * total
    load = Counter()
    for i, s in got.items():
        load[s] += size[i]
    assert max(load.values()) - min(load.values()) < 0.03 * total / 4
    # Of the bytes of heavy texts at the root, nearly all lie on their side of one cut in one dimension.
    best = max(
        sum(size[i] for i in heavy if (v[i] < c) == (got[i] < 2)) for v in (size, source) for c in {v[i] for i in heavy}
    )
    assert best > 0.95 * sum(size[i] for i in heavy)


def test_heavy_points_change_sides_only_where_the_others_are_too_few():
    assert sharding.heavy_sides([(0.1, 30.0), (0.4, 10.0), (0.6, 20.0)], 0.5, 60.0, 40.0) == ([True, True, False], 20.0)
    assert sharding.heavy_sides([(0.1, 30.0), (0.4, 10.0), (0.6, 20.0)], 0.5, 30.0, 5.0) == ([True, False, False], 0.0)
    assert sharding.heavy_sides([(0.1, 30.0), (0.6, 20.0), (0.9, 20.0)], 0.5, 55.0, 5.0) == ([True, True, False], 5.0)
    assert sharding.heavy_sides([], 0.5, 3.0, 7.0) == ([], 3.0)


def test_a_heavy_text_of_few_rows_is_spread_by_rows(spark):
    rows = [(i, "long copy " * 3000, "en", "a", 0, "", "", "") for i in range(6)] + [(10 + i, f"text {i}", "en", "a", 0, "", "", "") for i in range(50)]
    load = Counter(r["shard"] for r in sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), 3).where("doc_id < 10").collect())
    assert sorted(load.values()) == [2, 2, 2]


def test_language_model_base_is_exact_and_scores_are_proper(docs, none):
    held = quality_classifier.remainder(5) == 1
    got = lm_scoring.score(docs, held, classes=4, rounds=3).collect()
    rows = docs.collect()
    tokens = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in rows}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    count = Counter(t for r in rows if not out[r["doc_id"]] for t in tokens[r["doc_id"]])
    n, v = sum(count.values()), len(count)
    for r in got:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(own), sum(count[t] > 0 for t in own), n)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0 and r["perplexity"] > 1
    assert lm_scoring.score(none, held).count() == 0


@pytest.mark.parametrize("exchanged,frequent", [(2e-5, 4e-6), (0.0025, 0.0024), (1.0, 1.0)])
def test_class_scores_match_a_brute_force_bigram(docs, monkeypatch, exchanged, frequent):
    """Whichever words travel or are joined: classes for all training words, and scores from plain counts of them."""
    monkeypatch.setattr(lm_scoring, "EXCHANGED", exchanged)
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    held, k = quality_classifier.remainder(5) == 1, 4
    model, encoded, others = lm_scoring.train(docs, held, classes=k, rounds=2)
    got = lm_scoring.applied(model, encoded, others).collect()
    code = lambda w: int(lm_scoring.hashes(pa.array([w]))[0])
    rows = {r["doc_id"]: (r["text"] or "").lower().split() for r in docs.collect()}
    twice = {r["doc_id"]: n for r, n in Counter(docs.collect()).items()}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    known = {r["h"]: (r["c"], r["class"]) for r in model.words.collect()}
    of = {w: known[code(w)][1] if code(w) in known else None for t in rows.values() for w in t}
    count = Counter(w for i, t in rows.items() if not out[i] for w in t * twice[i])
    assert {code(w): c for w, c in count.items()} == {h: c for h, (c, x) in known.items() if h != lm_scoring.END}
    assert all(0 <= of[w] < k for w in count) and (exchanged == 1.0 or len({of[w] for w in count}) > 1)
    pair, members = np.zeros((k + 1, k + 1)), Counter(of[w] for w in count)
    for i, t in rows.items():
        path = [k, *(of[w] for w in t), k]
        for a, b in zip(path, path[1:]):
            if not out[i]:
                pair[a, b] += twice[i]
    size = pair.sum(axis=0)
    share = (size + 0.5) / (size.sum() + 0.5 * (k + 1))
    step = (pair + lm_scoring.PRIOR * share) / (pair.sum(axis=1, keepdims=True) + lm_scoring.PRIOR)
    room = [0.5 / (size[c] + 0.5 * (members[c] + 1)) for c in range(k)]
    mixed = [share[c] * room[c] for c in range(k)]
    unknown = [sum(m * step[c, x] for c, m in enumerate(mixed)) / sum(mixed) for x in range(k + 1)]
    for r in got:
        total, before = 0.0, step[k]
        for w in [*rows[r["doc_id"]], None]:
            if w is None:
                total += math.log10(before[k])
            elif of[w] is None:
                total += math.log10(sum(before[c] * room[c] for c in range(k)))
                before = unknown
            else:
                c = of[w]
                total += math.log10(before[c] * (count[w] + 0.5) * room[c] / 0.5)
                before = step[c]
        assert r["score"] == pytest.approx(total)
    # All words and an unknown one share the probability after any class.
    for before in (*step, unknown):
        assert before[k] + sum(before[of[w]] * (c + 0.5) * room[of[w]] / 0.5 for w, c in count.items()) + sum(before[c] * room[c] for c in range(k)) == pytest.approx(1.0)


def test_rows_without_an_id_are_scored_but_not_learned_from(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FREQUENT", 0.3)
    frame = spark.createDataFrame([(0, "a b a c"), (2, "a b"), (None, "a new word")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score(frame, F.col("doc_id") == 1, classes=2, rounds=1).collect()}
    assert len(got) == 3 and {r["train_tokens"] for r in got.values()} == {8}
    assert (got[None]["n_tokens"], got[None]["n_known"], got[None]["held_out"]) == (4, 2, None)


def test_words_that_are_not_exchanged_go_where_their_neighbours_say(spark, monkeypatch):
    """Each single word's class is the argument of the largest likelihood, tried class by class."""
    monkeypatch.setattr(lm_scoring, "EXCHANGED", 0.01)
    rng = random.Random(6)
    text = lambda: " ".join(f"{'ab'[i % 2]}{rng.randrange(8) if rng.random() < 0.9 else rng.randrange(8, 400)}" for i in range(60))
    texts = [text() for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    k = 3
    model, _, _ = lm_scoring.train(frame, F.lit(False), classes=k, rounds=3)
    known = {r["h"]: r["class"] for r in model.words.collect()}
    count = Counter(w for t in texts for w in t.split())
    alone = {w for w, c in count.items() if c >= 0.01 * model.tokens}
    of = {w: known[int(lm_scoring.hashes(pa.array([w]))[0])] for w in count}
    rest = k + 1
    paths = [[None, *t.split(), None] for t in texts]
    now = lambda w: k if w is None else of[w] if w in alone else rest
    pair = np.zeros((k + 2, k + 2))
    for p in paths:
        for a, b in zip(p, p[1:]):
            pair[now(a), now(b)] += 1
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    single = sorted(set(count) - alone)
    assert len(alone) >= 10 and len(single) > 50
    for w in single:
        gains = []
        for c in range(k):
            add, n = Counter(), count[w]
            for p in paths:
                for i, x in enumerate(p):
                    if x == w:
                        add[0, now(p[i - 1])] += 1
                        add[1, now(p[i + 1])] += 1
            cells = sum(f((pair[x, c] if side == 0 else pair[c, x]) + m) - f(pair[x, c] if side == 0 else pair[c, x]) for (side, x), m in add.items())
            total = sum(count[v] for v in alone if of[v] == c)
            gains.append(cells - 2 * (f(total + n) - f(total)))
        assert gains[of[w]] == pytest.approx(max(gains))


def test_the_end_counts_after_one_very_long_text(spark):
    frame = spark.createDataFrame([(0, "a b " * 150_000), (1, "a c")], "doc_id long, text string")
    got = lm_scoring.score(frame, F.col("doc_id") == 1, classes=2, rounds=1).where("held_out").first()
    assert (got["train_tokens"], got["n_tokens"], got["n_known"]) == (300_001, 3, 2)
    logs = math.log10(150_000.5) + math.log10(0.5) + math.log10(1.5)
    assert got["base_score"] == pytest.approx(logs - 3 * math.log10(300_001 + 0.5 * 4))


def test_training_leaves_no_shuffle_files_and_writes_rows_of_joined_words_once(docs, spark, monkeypatch):
    """Disk holds one job's shuffle at a time; of the joined words' rows, only those after another one are written again."""
    monkeypatch.setattr(lm_scoring, "FREQUENT", 0.0024)
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for d in folders for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}
    rows, write = {}, lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df, what: (back := write(df, what), rows.update({what: back.count()}))[0])
    name, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffled()
    setting = spark.conf.get(name)
    _, _, others = lm_scoring.train(docs, quality_classifier.remainder(5) == 1, classes=4, rounds=2)
    n = others.count()
    end = time.time() + 20
    while (left := {f for f in shuffled() - before if f.endswith(".data")}) and time.time() < end:
        time.sleep(0.2)  # executors delete them in the background
    # Counts of this test (others) shuffle one row a task.
    assert len({f.split("_")[1] for f in left}) <= 1 and spark.conf.get(name) == setting
    again = [m for what, m in rows.items() if what not in ("word-counts", "encoded", "word-classes", "other-words")]
    assert n == rows["other-words"] > 0 and len(again) == 1 and again[0] < n


def test_exchange_finds_classes_that_alternate(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"{'ab'[i % 2]}{rng.randrange(6)}" for i in range(400))
    frame = spark.createDataFrame([(i, text()) for i in range(60)], "doc_id long, text string")
    got = lm_scoring.score(frame, F.col("doc_id") % 5 == 1, classes=4, rounds=8).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.85 * got[1]  # less than the unigram's bits


def test_quotas_are_filled_by_weight_up_to_three_uses():
    got = mixing.quotas({"a": 100, "b": 1000, None: 1000})
    assert got["a"] == 300 and got["b"] == pytest.approx(1800 * 2 / 3) and sum(got.values()) == pytest.approx(2100)


def cheapest(supplies, room):
    """(words, cost) of the best of all integer flows, by trying them all."""
    edges = [(i, k) for i, s in enumerate(supplies) for k in s.most]
    best = (0, 0)

    def go(e, flow, left, given):
        nonlocal best
        if e == len(edges):
            cost = 0
            for s, n in zip(supplies, given, strict=True):
                for c, width in s.levels:
                    cost, n = cost + c * min(n, width), n - min(n, width)
            best = max(best, (sum(given), -cost))
            return
        i, k = edges[e]
        most = min(supplies[i].most[k], left[k], sum(n for _, n in supplies[i].levels) - given[i])
        for n in range(most + 1):
            go(e + 1, flow, left | {k: left[k] - n}, [g + n * (j == i) for j, g in enumerate(given)])

    go(0, [], room, [0] * len(supplies))
    return best[0], -best[1]


def test_flow_is_the_cheapest_of_all():
    rng = random.Random(8)
    overlapping = 0
    for _ in range(60):
        supplies = []
        for _ in range(3):
            held = rng.sample("abc", rng.randrange(1, 4))
            n = rng.randrange(1, 3)
            supplies.append(mixing.Supply([(k + (rng.random() < 0.2), n) for k in range(2)], {k: rng.randrange(1, 4) for k in held}))
            overlapping += len(held) > 1
        room = {k: rng.randrange(0, 5) for k in "abc"}
        flow = mixing.route(supplies, room)
        cost = 0
        for s, f in zip(supplies, flow, strict=True):
            n = sum(f.values())
            assert n <= sum(w for _, w in s.levels) and all(0 <= f[k] <= s.most[k] for k in f)
            for c, width in sorted(s.levels):
                cost, n = cost + c * min(n, width), n - min(n, width)
        assert all(sum(f.get(k, 0) for f in flow) <= room[k] for k in room)
        supplies = [mixing.Supply(sorted(s.levels), s.most) for s in supplies]
        assert (sum(sum(f.values()) for f in flow), cost) == cheapest(supplies, room)
    assert overlapping > 60


def test_flow_moves_overlapping_words_to_where_they_are_needed():
    # The shared pattern must serve b, as a can live on its own.
    supply = lambda n, held: mixing.Supply([(0, n), (1, n), (2, n)], dict.fromkeys(held, 3 * n))
    assert mixing.route([supply(100, "a"), supply(100, "ab")], {"a": 100, "b": 100}) == [{"a": 100}, {"a": 0, "b": 100}]
    assert mixing.route([supply(10, "a")], {"a": 25}) == [{"a": 25}]


def test_overlapping_sources_share_texts_before_any_is_used_twice(spark):
    rng = random.Random(10)
    shared = [words(rng, 20, 10_000) for _ in range(400)]
    rows = [(i, t, s) for s, at in (("a", 0), ("b", 1000)) for i, t in enumerate(shared, at)]
    rows += [(2000 + i, words(rng, 20, 10_000), "c") for i in range(400)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, uses string")
    got = {r["doc_id"]: r for r in mixing.mix(frame).collect()}
    taken = Counter()
    for i, _, s in rows:
        taken[s] += got[i]["taken"]
    for i, _, s in rows:
        assert abs(taken[s] - got[i]["target"]) <= 20
    uses = [got[i]["uses"] + got[1000 + i]["uses"] for i in range(400)]
    # 8000 words, of which a and b ask for 21,000: two or three uses, but where hashes leave a gap between a's part and b's.
    assert sum(n in (2, 3) for n in uses) >= 0.95 * len(uses) and 20 * sum(uses) == taken["a"] + taken["b"]
    few = {r["doc_id"]: r["taken"] for r in mixing.mix(frame, max_patterns=0).collect()}
    assert sum(few.values()) == pytest.approx(sum(r["taken"] for r in got.values()), abs=60)


def test_mix_meets_its_targets(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    rows = docs.collect()
    source = {r["doc_id"]: r["source"] for r in rows}
    taken, target, size = Counter(), {}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["target"]
    for s, t in target.items():
        # Whole documents are taken: the gap is under the source's largest one.
        assert abs(taken[s] - t) <= max(0.02 * t, max(r["size"] for r in got if source[r["doc_id"]] == s))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(none).count() == 0
    odd = docs.withColumns({c: F.lit("?") for c in ("__size", "__uses", "__pattern", "uses", "key", "label", "pattern", "row", "m", "spot", "ticket", "first", "target")})
    again = mixing.mixed(odd)
    assert again.columns == odd.columns
    assert Counter(r["doc_id"] for r in again.collect()) == Counter({r["doc_id"]: n for r in got if (n := sum(x["uses"] for x in got if x["doc_id"] == r["doc_id"]))})
    assert mixing.mixed(none).count() == 0 and mixing.mixed(docs.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_rules_match_brute_force(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.host_rules(docs).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
        covered = {i + k for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_dup_lines"], g["n_repeat_words"]) == (len(own), sum(map(len, own)), len(lines) - len(set(lines)), len(covered))
        assert g["base_failed"] == (len(own) < 10 or 100 * len(covered) > 20 * len(own))
        assert not (g["base_failed"] and g["kept"])
    assert quality_rules.host_rules(none).count() == 0


def test_a_bad_host_takes_its_documents_with_it(spark):
    good = "\n".join(f"line{i} holds{i} other{i} words{i} than{i} that" for i in range(6))
    rows = [(i, "# # # # #" * 9, "en", "bad", 0, "", "", "") for i in range(40)] + [(100 + i, good, "en", "bad" if i == 0 else "ok", 0, "", "", "") for i in range(40)]
    kept = {r["doc_id"] for r in quality_rules.host_rules(spark.createDataFrame(rows, SCHEMA)).where("kept").collect()}
    assert kept == set(range(101, 140))


def test_personal_data_base_patterns():
    card = "4041894974608795"
    text = f"a.b@c.de x@y 1.2.3.4 999.1.1.1 x {card} +1 (269) 555-3296 4.0. x {card[:-1]}6"
    # The phone runs on over the digits behind it, as its pattern says.
    assert pii.joined(pii.base_spans(text)) == "email:0:8,ip:13:20,card:33:49,phone:50:71"
    assert pii.base_spans("+1 (269) 555-3296 and") == [("phone", 0, 17)]
    assert pii.base_spans("") == [] and pii.base_spans("@" * 50 + "a" * 5000) == []


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_base_spans_equal_the_patterns_on_odd_texts():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    keep = {
        "email": lambda x: True,
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 13 <= len(d := re.sub(r"\D", "", x)) <= 19 and luhn(d),
        "phone": lambda x: 9 <= len(re.sub(r"\D", "", x)) <= 15,
    }
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "@@", "x@y.de", ".", "-", "+", "+1", "(", ")", " ", " ", "1", "22", "333", "4111111111111111", "4041894974608795", "10.0.0.7", "256.1.1.1", "555-", "é", "%", "_", "0000000000000"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        want = [(k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, text) if keep[k](m[0])]
        assert pii.base_spans(text) == want, text


def test_the_field_adds_what_patterns_lose_and_leaves_the_rest(spark, none):
    rng = random.Random(5)

    def card():
        body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
        return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))

    def phone():
        return f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"

    rows = []
    for i in range(300):
        rows.append((i, f"some words {card()} then {phone()} and mail u{i}.{i}@host{i % 9}.example.com version {i % 5}.{i % 7} end"))
    lost = f"call {phone()} {card()} now"
    rows += [(1000, lost), (1001, None), (1002, ""), (1003, "plain words of version 3.2 only"), (1003, "plain words of version 3.2 only")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(frame)
    got = {r["doc_id"]: r for r in pii.detect(frame, model).collect()}
    assert got[1000]["n_card"] == got[1000]["n_phone"] == 0
    assert [s.split(":")[0] for s in got[1000]["spans"].split(",")] == ["card", "phone"]
    assert got[1001]["spans"] == got[1002]["spans"] == got[1003]["spans"] == ""
    assert got[7]["n_card"] == got[7]["n_phone"] == got[7]["n_email"] == 1
    clean = pii.redact(frame, model).where("doc_id = 1000").first()["text"]
    assert clean == "call [PHONE] [CARD] now"
    assert pii.find([], model) == [] and pii.find(["no digit", "a@ b"], model)[0] == ([], [])
    assert pii.train(none) is None and pii.detect(none, None).count() == 0


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(0)
    texts = ["4000 then 12 and 4000 or x 99 12"]
    g = pii.graph(texts)
    model = {"unary": rng.normal(size=(pii.WIDTH, pii.K)) * 0.3, "chain": np.zeros((pii.K, pii.K)), "skip": np.full(pii.K, 0.7)}
    got = pii.beliefs(g, model)
    score = model["unary"][g["rows"]].sum(axis=1)
    n = len(score)
    total = np.zeros((n, pii.K))
    for y in np.ndindex(*[pii.K] * n):
        w = sum(score[i, y[i]] for i in range(n)) + sum(model["skip"][y[a]] for a, b in g["skip"] if y[a] == y[b])
        for i in range(n):
            total[i, y[i]] += math.exp(w)
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-3)  # the skip edges form a forest


@pytest.mark.parametrize("times", [2, 20])
def test_what_one_occurrence_makes_clear_reaches_all_others(times):
    g = pii.graph([" and some plain words then ".join(["card: 4000123"] + ["saw 4000123"] * (times - 1))])
    clear = [f for f in g["rows"][0] if f not in g["rows"][1]]
    model = {"unary": np.zeros((pii.WIDTH, pii.K)), "chain": np.zeros((pii.K, pii.K)), "skip": np.full(pii.K, 3.0)}
    model["unary"][clear, 3] = 8.0
    p = pii.beliefs(g, model)
    assert len(p) == times and len(g["chain"]) == 0
    assert (p[:, 3] > 0.5).all()
    assert pii.fit(["call 4000123 and plain words then 4000123 " * 2])["skip"].shape == (pii.K,)


def test_packing_is_a_round_trip_close_to_the_bound(docs, none):
    got = packing.pack(docs, tokenizer_path(), 256).collect()
    tokenizer = packing.Encoder(tokenizer_path()).tokenizer
    want = Counter()
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want.update((r["doc_id"], i // 256, i, len(ids[i : i + 256]), zlib.crc32(ids[i : i + 256].tobytes())) for i in range(0, len(ids), 256))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    fill = {}
    for r in got:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert len(fill) <= math.ceil(sum(r["length"] for r in got) / 256) + 2
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_configurations_hold_each_piece_once():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 65) for _ in range(3000))
    found = packing.configurations(dict(counts), 64)
    held = Counter()
    for config, times in found:
        assert sum(config) <= 64 and times > 0
        for k in config:
            held[k] += times
    assert held == counts
    assert sum(t for _, t in found) <= math.ceil(sum(k * n for k, n in counts.items()) / 64) * 1.01 + 1


def test_the_program_is_covered_bounded_and_rounded():
    rng = random.Random(3)
    counts = Counter(min(1024, max(3, int(rng.lognormvariate(5, 1.2)))) for _ in range(4000))  # the shortest has few copies
    found = packing.program(dict(counts), 1024)
    # What the amounts hold is what is said to be covered, with no more sequences than the bound.
    held = np.zeros(len(found.lengths))
    for key, x in found.amounts.items():
        assert x > 0 and sum(found.lengths[at] * n for at, n in key) <= 1024
        for at, n in key:
            held[at] += n * x
    assert np.allclose(held / found.demand, found.covered) and (found.covered <= 1 + 1e-6).all()
    assert sum(found.amounts.values()) <= found.bound + 1e-6
    assert (found.covered * found.demand).sum() > 0.85 * found.demand.sum()
    used, left = packing.rounded(found)
    whole = Counter(left)
    for config, times in used.items():
        assert sum(config) <= 1024 and times > 0
        for k in config:
            whole[k] += times
    assert whole == counts
    assert sum(left.values()) < 0.4 * sum(counts.values())
    assert found.bound <= sum(t for _, t in packing.configurations(dict(counts), 1024)) <= math.ceil(found.bound) * 1.002 + 1


def fewest(sizes, length):
    """The least number of sequences, by trying every piece in every sequence."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms[j] not in rooms[:j]:
                go(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        go(i + 1, [*rooms, length - sizes[i]])

    go(0, [])
    return best


def test_small_packings_are_optimal_or_one_above_and_never_below_the_bound():
    rng = random.Random(11)
    exact = 0
    for _ in range(40):
        sizes = sorted((rng.randrange(2, 21) for _ in range(9)), reverse=True)
        want, found = fewest(sizes, 20), packing.configurations(Counter(sizes), 20)
        got = sum(t for _, t in found)
        assert packing.program(Counter(sizes), 20).bound <= want + 1e-9 and want <= got <= want + 1
        exact += got == want
    assert exact >= 35
    # Pieces over half a sequence stand alone: the dual bound knows, the tokens do not.
    found = packing.program({11: 10}, 20)
    assert found.bound == pytest.approx(10) and sum(t for _, t in packing.configurations({11: 10}, 20)) == 10


def test_the_knapsack_is_optimal_within_its_copies():
    rng = np.random.default_rng(5)
    for _ in range(40):
        lengths, length = np.sort(rng.choice(np.arange(1, 13), 4, replace=False)), 20
        value, copies = rng.random(4), rng.integers(1, 5, 4)
        sack = packing.Knapsack(lengths, value, copies, length)
        best = max(float(value @ n) for n in np.ndindex(*(copies + 1)) if lengths @ n <= length)
        assert max(sack.worth) == pytest.approx(best)
        for i, worth in enumerate(sack.worth):
            filling = sack.filling(i)
            assert sum(lengths[at] * n for at, n in filling.items()) <= length and all(n <= copies[at] for at, n in filling.items())
            assert sum(value[at] * n for at, n in filling.items()) == pytest.approx(worth)


def test_encoder_equals_the_tokenizer_on_odd_texts():
    rng = random.Random(1)
    alphabet = "aAbZéÉß'sst rell\n\t.,;:!?#$%&*|<>0129  İ́eΑΣ中🎉\x85 "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(2000)] + ["a<|endoftext|>b.", "it's don't.'s", ""]
    encoder = packing.Encoder(tokenizer_path(), keep=500)
    ids, ends = encoder.ids(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, ascii(t)


def test_the_encoder_learns_each_string_once_while_there_is_room(monkeypatch):
    """A task's many rare words stay remembered from chunk to chunk; with little room the ids are the same."""
    rng = random.Random(8)
    some = sorted({"".join(rng.choice("abcdeilnorstu") for _ in range(7)) for _ in range(120_000)}) + ["größe", "l'été", "x1", "Straße,", "a.b"]
    texts = [" ".join(rng.sample(some, 50_000)) for _ in range(6)] + ["", " ".join(some)]
    learned, learn = [], packing.Encoder._learn
    monkeypatch.setattr(packing.Encoder, "_learn", lambda self, words: (learned.append(len(words)), learn(self, words))[1])
    encoder, small = packing.Encoder(tokenizer_path()), packing.Encoder(tokenizer_path(), keep=1)
    for t in texts:
        learned.clear()
        ids, ends = small.ids(pa.array([t]))
        assert sum(learned) <= len(t.split()) + 6 and ends.tolist() == [0, len(ids)]
        assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.array_equal(encoder.ids(pa.array([t]))[0], ids)
    again, learned[:] = packing.Encoder(tokenizer_path()), []
    for t in texts:
        again.ids(pa.array([t]))
    # Each string once: the words, the empty string, and what cuts before punctuation leave.
    assert sum(learned) <= len(some) + 6


def test_line_field_learns_and_holds_out(spark, docs, none):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 != 0
        line = lambda: words(rng, 9) + "." if good else "SPAM!! " * 4 + "| " * 5  # noqa: B023, E731
        rows.append((i, "\n".join(line() for _ in range(5))))
        labels.append((i, int(good)))
    labels += [(1, None), (999_999, 1)]
    frame, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    held = quality_classifier.remainder(4) == 2
    model = quality_classifier.train(frame, marks, ~held)
    got = quality_classifier.score(frame, model).withColumn("held", held).where("held").collect()
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 3 != 0) for r in got)
    assert quality_classifier.accepted(frame, model).count() == sum(i % 3 != 0 for i in range(400))
    odd = quality_classifier.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score between 0 and 1").count() == docs.count()
    assert quality_classifier.train(frame, marks.limit(0), ~held) is None
    assert quality_classifier.score(none, model).count() == 0


def test_line_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    unary, pair, ends = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 4, 5])
    got, trans, log_z = quality_classifier.marginals(unary, ends, pair)
    p, t, z = np.zeros(4), np.zeros((2, 2)), 0.0
    for y in np.ndindex(2, 2, 2, 2):
        w = math.exp(sum(unary[i] * y[i] for i in range(4)) + sum(pair[y[i], y[i + 1]] for i in range(3)))
        z += w
        p += w * np.array(y)
        for i in range(3):
            t[y[i], y[i + 1]] += w
    assert np.allclose(got[:4], p / z) and np.allclose(trans, t / z) and log_z[0] == pytest.approx(math.log(z))
    assert got[4] == pytest.approx(1 / (1 + math.exp(-unary[4])))


PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{menu}</ul></nav>"
    "<div class='ad'>buy {ad}</div><article><h1>{title}</h1>{body}</article><footer>&copy; {ad}</footer></body></html>"
)


def test_both_gradients_of_the_line_field_ascend_one_likelihood():
    rng = np.random.default_rng(4)
    ends = np.array([0, 1, 6, 8, 20])
    x, labels, at = rng.normal(size=(20, 3)), np.array([1.0, 0.0, 0.5, 1.0]), rng.normal(size=7)
    value = lambda z: quality_classifier.objective(z[:3], z[3:].reshape(2, 2), x, ends, labels, 0.01)
    for i, step in enumerate(np.eye(7) * 1e-5):
        assert value(at)[1][i] == pytest.approx((value(at + step)[0] - value(at - step)[0]) / 2e-5, abs=1e-7)


def page(rng):
    body = [words(rng, rng.randrange(1, 60)) + " &amp; more." for _ in range(rng.randrange(1, 7))]
    title = words(rng, 5)
    html = PAGE.format(menu="".join(f"<li><a href=x>{words(rng, 1)}</a></li>" for _ in range(5)), ad=words(rng, 4), title=title, body="".join(f"<p>{b}</p>" for b in body))
    return html, "\n".join([title, *(b.replace("&amp;", "&") for b in body)])


def test_labeller_finds_the_article(spark):
    rng = random.Random(6)
    pages = [page(rng) for _ in range(260)]
    rows = [(i, "u", h) for i, (h, _) in enumerate(pages)] + [(1000, "u", None), (1001, None, ""), (1002, "u", "<p>unclosed <!-- "), (0, "u", pages[0][0])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = html_extract.train(frame, sample=150)
    got = {r["page_id"]: r for r in html_extract.extract(frame, model).collect()}
    assert sum(got[i]["text"] == want for i, (_, want) in enumerate(pages)) >= 0.97 * len(pages)
    assert got[1000]["text"] == got[1001]["text"] == "" and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(frame.limit(0), model).count() == 0
    assert html_extract.train(frame.limit(0)) is None


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    model = html_extract.Labeller(5, hidden=3)
    x, sizes, y = rng.normal(size=(7, 5)), np.array([4, 1, 2]), rng.integers(0, 2, 7).astype(float)

    def loss():
        p = model.predict(x, sizes)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip(model.weights, model.gradients(x, sizes, y), strict=True):
        at = tuple(rng.integers(0, s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_blocks_decode_and_join():
    got = html_extract.blocks("<div>a<b>b</b> &lt;c&gt;<br>d<p>e\n f<p>g<script>x</p></script>h<ul><li>i<li>j</ul></div>k")
    assert [b.text for b in got] == ["ab <c> d", "e f", "gh", "i", "j", "k"]


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000,
        "<div>x" * 100_000,
        "<div>" * 100_000 + "</section>" * 50_000,
        "<b>x" * 100_000 + "</i>" * 100_000,
        "<ol>" + "<div>" * 60_000 + "<li>x</li>" * 60_000,
        '<a ">" ' * 150_000 + "'",
        "<!--x" * 100_000,
        "<p class=' " * 100_000,
        "<td>x" * 50_000 + "<tr>y" * 50_000,
    ],
)
def test_broken_and_deep_pages_are_read_in_time(page):
    began = time.perf_counter()
    found = html_extract.blocks(page)
    model = html_extract.Labeller(html_extract.DIM)
    html_extract.texts([page], model, html_extract.PathVectors())
    assert time.perf_counter() - began < 30 and len(found) <= len(page)


def test_tags_end_at_their_quotes_if_these_close():
    got = [b.text for b in html_extract.blocks("<p title='a > b'>one</p><p title=\"x>two</p><p>three</p> 1 < 2")]
    assert got == ["one", "two", "three", "1 < 2"]
    assert [b.text for b in html_extract.blocks("<div>a<p>b<ul><li>c<p>d<li>e</ul><table><tr><td>f<td>g<tr><th>h</table>")] == list("abcdefgh")


def test_only_void_elements_are_empty():
    """A slash that ends a tag, or an unquoted value in it, leaves the element open until its end tag."""

    def tags(block):
        path, out = block.path, []
        while path is not None:
            out.insert(0, path.element[0])
            path = path.above
        return out

    got = html_extract.blocks("<article class=x/><p>one</p></article><div id=a/>two<br/>three</div><svg><path d='M0'/><path/></svg>four")
    assert [b.text for b in got] == ["one", "two three", "four"]
    assert [tags(b) for b in got] == [["article", "p"], ["div"], []]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 16))
    v[200:260] = v[7]  # copies
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] + [1.0] * 15), (5080, [None] + [1.0] * 15), (None, [1.0] * 16), (5100, [1.0, 2.0]), rows[11]]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 20))
    hits = 0
    for q, own in got.items():
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(1500), -np.round(s, 12))) if i != q][:20]
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in [i for _, i, _ in own]
        assert all(abs(score - s[i]) < 1e-9 for _, i, score in own)
        assert [(-round(score, 12), i) for _, i, score in own] == sorted((-round(score, 12), i) for _, i, score in own)
        hits += len(set(want) & {i for _, i, _ in own})
    assert hits >= 0.9 * 20 * len(got)
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_hot_buckets_are_dealt_by_entries_and_by_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.concatenate([1.0 + rng.normal(size=(400, 8)) * 1e-3, rng.normal(size=(40, 8))])  # near-equal, but distinct
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "BLOCK", 32)
    monkeypatch.setattr(ann, "SLICE", 10)
    seen, compared = [], ann._compared
    monkeypatch.setattr(ann, "_compared", lambda members, dim, k: (seen.append(members), compared(members, dim, k))[1])
    got = {}
    for r in ann.nearest(frame, F.col("vec_id") < 200, k=5, tables=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert seen[0].groupBy("path", "asks").count().agg(F.max("count")).first()[0] <= 3 * 32
    want = lambda q: [i for i in np.argsort(-(v @ v[q]), kind="stable").tolist() if i != q][:5]
    hits = sum(len(set(want(q)) & {i for _, i in own}) for q, own in got.items())
    assert set(got) == set(range(200)) and hits >= 0.9 * 5 * 200


def brute_components(rows):
    sets = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark, docs, none):
    want = brute_components(docs.collect())
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.one_of_each(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == docs.columns


def test_large_groups_of_near_copies_branch_and_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "BLOCK", 6)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):  # edits of very different number: some links, many just below the threshold
        own = list(base)
        for k in rng.sample(range(120), (0, 2, 3, 4, 5, 6)[i % 6]):
            own[k] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base[:30]) + " " + words(rng, 90, 100_000)) for i in range(40)]  # a passage in common
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: c for i, (_, c) in brute_components(frame.collect()).items()}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()} == want
