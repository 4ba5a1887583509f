"""Operators on single documents, against plain Python, with every odd kind of row."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import classify, language, maxent, quality, tokens
from emberwatch.llm.common import held_out

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, trusted boolean, words string, w string, n long"


def sample(seed=0, n=60):
    """Random texts, then null, empty, blank, short, repeated, tied, one-word and very long ones."""
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "dé", "ñu", "e f", "#tag", "x|y", "zz$"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 40))) for _ in range(n)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "one", "a b c d e", "a b c d e a b c d e", "x " * 50, "l1\nl2\nl1\n\n \nl1"]
    texts += ["same text here"] * 3 + ["long " * 30_000 + "end", "😀   wide space"]
    rows = [(i, t, "en", "s", i % 3 == 0, "clash", "clash", 1) for i, t in enumerate(texts)]
    return rows + [(None, "no id at all", None, None, None, None, None, None), rows[0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(4).cache()


def counts_of(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    signs = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), signs, len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs):
    buckets = 64
    weights = quality.gram_weights(docs, buckets=buckets).cache()
    raw, target = Counter(), Counter()
    grams = {}
    for r in docs.collect():
        words = WORDS.findall(r.text or "")
        found = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
        grams[r.text] = [zlib.crc32(g.encode()) % buckets for g in found]
        raw.update(grams[r.text])
        target.update(grams[r.text] if r.trusted else [])
    ratio = lambda b: (target[b] * raw.total() / raw[b] + 4 * buckets) / (target.total() + 4 * buckets)
    want = {b: round(math.log(ratio(b)), 6) if raw[b] else 0 for b in range(buckets)}
    got = {r.bucket: r for r in weights.collect()}
    assert {b: (r.raw, r.target) for b, r in got.items()} == {b: (raw[b], target[b]) for b in range(buckets)}
    assert all(abs(got[b].weight - want[b]) < 2e-6 for b in range(buckets))
    rows = quality.quality_rules(docs.withColumn("key", F.coalesce("text", F.lit("-"))), weights, doc_id="key", buckets=buckets).collect()
    assert len(rows) == docs.count()
    for r in rows:
        text = None if r.doc_id == "-" else r.doc_id
        counted = counts_of(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted, text
        g = grams[text]
        llr = sum(got[b].weight for b in g) / len(g) if g else 0
        assert abs(r.llr - llr) < 1e-5
        failed = counted[0] < 10 or 100 * counted[4] > 20 * counted[0]
        assert r.base_failed == failed and r.kept == (not failed and r.llr >= -0.2)


def test_quality_rules_without_target_or_rows(docs):
    none = docs.withColumn("trusted", F.lit(False))
    weights = quality.gram_weights(none, buckets=8)
    assert weights.where("weight <> 0").isEmpty() and weights.count() == 8
    empty = docs.limit(0)
    assert quality.quality_rules(empty, quality.gram_weights(empty, buckets=8), buckets=8).isEmpty()


def test_quality_filter_keeps_rows_whole(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    kept = quality.filtered(docs, labels, least=-100)
    assert kept.columns == docs.columns
    want = sorted(r.text for r in docs.collect() if counts_of(r.text)[0] >= 10 and counts_of(r.text)[4] * 5 <= counts_of(r.text)[0])
    assert sorted(r.text for r in kept.collect()) == want


def test_greedy_pieces():
    rng = random.Random(3)
    for _ in range(300):
        pieces = ["".join(rng.choices("abé▁", k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 12))]
        automaton = tokens.Automaton(pieces)
        known = {p.encode() for p in pieces}
        for _ in range(5):
            word = "".join(rng.choices("abcé", k=rng.randrange(1, 14)))
            rest, n = (tokens.START + word).encode(), 0
            while rest:
                size = next((k for k in range(len(rest), 1, -1) if rest[:k] in known), 1)
                rest, n = rest[size:], n + 1
            assert automaton.count(word.encode()) == n, (pieces, word)


def test_token_counts(docs):
    got = tokens.token_counts(docs, ["▁alpha", "▁", "mma", "ga"]).collect()
    automaton = tokens.Automaton(["▁alpha", "▁", "mma", "ga"])
    by = {}
    for r in docs.collect():
        words = (r.text or "").encode().split()
        by[r.doc_id] = (len((r.text or "").encode()), len(words), sum(map(automaton.count, words)))
    assert len(got) == docs.count() and all(by[r.doc_id] == (r.n_bytes, r.n_words, r.n_tokens) for r in got)
    assert tokens.token_counts(docs.limit(0), []).isEmpty()


def languages():
    rng = random.Random(5)
    texts = []
    for lang, letters in (("aa", "abcde "), ("bb", "bcdfé "), ("cc", "xyzw ")):
        texts += [("".join(rng.choices(letters, k=80)), lang) for _ in range(30)]
    return texts


LANGUAGES_SCHEMA = "text string, lang string, doc_id long"


def language_table(spark):
    return spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(languages())], LANGUAGES_SCHEMA)


def test_code_lengths_fit_in_one(spark):
    (model,) = language.trained(language_table(spark))
    assert model.langs == ["aa", "bb", "cc"]
    # the chances of all bytes after any three add up to one at most, seen context or not
    rng = np.random.default_rng(1)
    for key in [*rng.choice(model.four_keys, 20), *rng.integers(0, 1 << 32, 20)]:
        bits = model.of_runs(key // 256 * 256 + np.arange(256))
        assert (np.exp2(-bits).sum(0) <= 1 + 1e-4).all()  # escapes without exclusion lose a part


@pytest.mark.parametrize("block", [16, 2])
def test_code_lengths_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(language, "LANGUAGES", block)
    models = language.trained(language_table(spark))
    assert [m.langs for m in models] == ([["aa", "bb", "cc"]] if block == 16 else [["aa", "bb"], ["cc"]])
    counts = {}
    for text, lang in languages():
        row = [10] * 3 + list(text.encode())
        for i in range(3, len(row)):
            for order in range(4):
                counts.setdefault((lang, tuple(row[i - order : i])), Counter())[row[i]] += 1

    def chance(lang, context, symbol):
        c = counts.get((lang, context))
        shorter = (lambda: chance(lang, context[1:], symbol)) if context else (lambda: 1 / 256)
        if not c:
            return shorter()
        total = c.total() + len(c)
        return c[symbol] / total if c[symbol] else len(c) / total * shorter()

    for text in ("abc", "bcd bcd", "xé w", "ABC", "", "ж\x00中"):
        row = [10] * 3 + list(text.translate(str.maketrans("ABC", "abc")).encode())
        for model in models:
            want = [-sum(math.log2(chance(g, tuple(row[i - 3 : i]), row[i])) for i in range(3, len(row))) for g in model.langs]
            assert np.allclose(model.bits([text.encode(), b"x"])[0], want, rtol=1e-4)


def test_language_rows(spark, docs, monkeypatch):
    table = language_table(spark)
    models = language.trained(table)
    got = language.identified(docs, models).collect()
    assert len(got) == docs.count()
    for r in got:
        letters = bool(r.text) and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    right = language.identified(table, models)
    assert right.where("lang = lang_pred").count() >= 0.95 * right.count()
    monkeypatch.setattr(language, "LANGUAGES", 1)  # a model for each language, and the same results
    again = language.identified(docs, language.trained(table)).collect()
    told = lambda rows: Counter((r.doc_id, r.text, r.lang_pred, round(r.score, 9)) for r in rows)
    assert told(again) == told(got)
    nothing = language.trained(docs.where("lang is null"))
    assert {r.lang_pred for r in language.identified(docs, nothing).collect()} == {"und"}
    assert language.identified(docs.limit(0), models).isEmpty()


def test_every_language_and_byte_is_learnt(spark):
    """Many languages, one with an empty name and one in a rare script, beside one with most of the texts."""
    rng = random.Random(3)
    names = ["", *(f"l{i:03d}" for i in range(40))]
    # each language has its own two letters, of scripts all over the code points
    letters = {n: [chr(0x400 + 7 * i), chr(0x4E00 + 11 * i)] for i, n in enumerate(names)}
    rows = [("".join(rng.choices(letters[n], k=60)), n) for n in names for _ in range(4)]
    rows += [("the hot language has most of the texts " * 3, "hot")] * 300
    table = spark.createDataFrame([(t, g, i) for i, (t, g) in enumerate(rows)], LANGUAGES_SCHEMA)
    models = language.trained(table, rows=50)
    assert [n for m in models for n in m.langs] == sorted([*names, "hot"])
    assert language.identified(table, models).where("lang <> lang_pred").isEmpty()


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = classify.boosted(x[:2000], y[:2000])
    score = model.scores(x[2000:])
    assert ((score >= 0.5) == y[2000:]).mean() > 0.95 and ((0 <= score) & (score <= 1)).all()

    def walk(row):
        total = model.base
        for k in model.roots:
            while not model.leaf[k]:
                k = model.child[k] + (row[model.feature[k]] > model.split[k])
            total += model.value[k]
        return 1 / (1 + math.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], model.scores(x[:50]))
    for labels in (np.ones(10), np.zeros(0)):
        constant = classify.boosted(x[: len(labels)], labels)
        assert len(constant.roots) == 0 and np.allclose(constant.scores(x[:3]), constant.scores(x[3:6]))


def test_the_first_splits_by_brute_force():
    """The root of the first tree and its leaves, against a search of all cuts of all features."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)).round(1)
    y = (x[:, 1] + 0.3 * rng.normal(size=400) > 0.4).astype(float)
    model = classify.boosted(x, y, trees=1, depth=1, rate=1.0, bins=64, least=1.0, ridge=1.0)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(part):
        return g[part].sum() ** 2 / (h[part].sum() + 1)

    cuts = [(f, c) for f in range(3) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1]))]
    gains = {
        (f, c): gain(x[:, f] <= c) + gain(x[:, f] > c)
        for f, c in cuts if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= 1
    }
    f, c = max(gains, key=gains.get)
    root = int(model.roots[0])
    assert (model.feature[root], model.split[root]) == (f, c)
    for side, part in enumerate((x[:, f] <= c, x[:, f] > c)):
        assert math.isclose(model.value[model.child[root] + side], -g[part].sum() / (h[part].sum() + 1), rel_tol=1e-9)


def test_the_labelled_sample_is_bounded_and_fixed(spark, monkeypatch):
    """An id with most of the rows, half of them copies, does not decide the sample's size or order."""
    rows = [(5, [float(i % 700)] * len(classify.FEATURES)) for i in range(1_400)]
    rows += [(i, [float(i)] * len(classify.FEATURES)) for i in range(100, 400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(classify, "boosted", lambda x, y: seen.append((x.tolist(), y.tolist())))
    for parts in (1, 7):
        features = spark.createDataFrame(rows, "doc_id long, features array<float>").repartition(parts)
        classify.trained(features, labels, rows=200)
    assert seen[0] == seen[1] and 120 < len(seen[0][0]) < 280


def test_classifier_rows(spark, docs):
    features = classify.with_statistics(docs).cache()
    assert features.count() == docs.count()
    assert all(len(r.features) == len(classify.FEATURES) and all(map(math.isfinite, r.features)) for r in features.collect())
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(50, 0), (50, 1), (None, 1), (51, None)], "doc_id long, label int")
    got = classify.scored(features, classify.trained(features, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert classify.scored(features, classify.trained(features, labels.limit(0))).count() == docs.count()
    assert classify.with_statistics(docs.limit(0)).isEmpty()


def test_language_model_scores(spark, docs):
    shape = maxent.Shape(classes=2, members=4, rare=3, class_rows=64, member_rows=64, direct=6, batch=64)
    got = maxent.scored(docs, held_out(F.col("doc_id"), 10, 0), shape=shape).collect()
    training = Counter()
    split = {}
    for r in docs.collect():
        split[r.doc_id] = [*(r.text or "").encode().lower().split(), b""]
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10:
            training.update(split[r.doc_id])
    n, v = training.total(), len(training)
    assert len(got) == docs.count()
    for r in got:
        words = split[r.doc_id]
        base = sum(math.log10((training[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(training[w] > 0 for w in words), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    assert maxent.scored(docs.limit(0), held_out(F.col("doc_id"), 10, 0), shape=shape).isEmpty()


def test_model_chances_add_up():
    shape = maxent.Shape(classes=3, members=4, rare=2, class_rows=32, member_rows=32, batch=16)
    rng = np.random.default_rng(4)
    weights = maxent.Weights(shape, rng.normal(size=5), np.log(rng.dirichlet(np.ones(4), 3)))
    symbols = rng.integers(0, 14, 200)
    at = np.arange(3, 200)
    before = weights.log_chances(symbols, at).sum()
    zeros = [[np.zeros(len(t), np.float32) for t in weights.tables] for _ in range(2)]
    for _ in range(5):
        weights.learn(symbols, at, *zeros)
    assert weights.log_chances(symbols, at).sum() > before
    for place in (10, 50):
        total = 0.0
        for s in range(14):
            other = symbols.copy()
            other[place] = s
            total += math.exp(weights.log_chances(other, np.array([place]))[0])
        assert abs(total - 1) < 1e-4


def test_sums_by_row():
    rng = np.random.default_rng(5)
    for n, rows in ((1, 3), (50, 4), (3_000, 40), (300, 10_000)):
        at = np.minimum(rng.zipf(1.3, (4, n)), rows - 1).astype(np.uint16)
        slope = rng.normal(size=(n, 7)).astype(np.float32)
        want = np.zeros((rows, 7))
        for r in at:
            np.add.at(want, r, slope)
        met, count, sums = maxent._sums_by_row(slope, at)
        assert sorted(met) == sorted(set(at.ravel().tolist())) and len(set(met)) == len(met)
        assert (count == np.bincount(at.ravel(), minlength=rows)[met]).all() and np.allclose(sums, want[met], atol=1e-3)


def test_chances_and_a_step_by_brute_force():
    """The chance of each place, and the weights after one batch, from the definition, place by place."""
    shape = maxent.Shape(classes=3, members=4, rare=2, class_rows=16, member_rows=16, batch=500)
    rng = np.random.default_rng(6)
    weights = maxent.Weights(shape, rng.normal(size=5), np.log(rng.dirichlet(np.ones(4), 3)))
    weights.tables = [rng.normal(size=t.shape).astype(np.float32) for t in weights.tables]
    symbols, at = rng.integers(0, 14, 300), np.arange(3, 300)
    slope = [np.zeros(t.shape) for t in weights.tables]
    want = []

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    for place in at:
        features, s = weights.features(symbols, np.array([place])), symbols[place]
        group = s // 4 if s < 12 else 3 + s - 12
        rows = weights.rows(features, 16)[:, 0]
        p = softmax(weights.class_bias + weights.tables[0][rows].astype(float).sum(0))
        want.append(math.log(p[group]))
        np.add.at(slope[0], rows, p - np.eye(5)[group])
        if s < 12:
            with_class = features + (np.uint64(group) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            rows = weights.rows(with_class, 16)[:, 0]
            p = softmax(weights.member_bias[group] + weights.tables[1][rows].astype(float).sum(0))
            want[-1] += math.log(p[s % 4])
            np.add.at(slope[1], rows, p - np.eye(4)[s % 4])
    assert np.allclose(weights.log_chances(symbols, at), want, atol=1e-4)
    before = [t.copy() for t in weights.tables]
    weights.learn(symbols, at, *[[np.zeros(len(t), np.float32) for t in weights.tables] for _ in range(2)])
    for t in range(2):
        step = shape.rate * slope[t] / np.sqrt((slope[t] ** 2).mean(1, keepdims=True) + 1e-6)
        assert np.allclose(weights.tables[t], before[t] - step, atol=1e-3)


def test_scores_do_not_depend_on_the_cluster(spark, docs, monkeypatch):
    """The same scores, to the rounding of sums, however the rows come and however many tasks there are."""
    monkeypatch.setattr(maxent, "PART_TOKENS", 5_000)
    shape = maxent.Shape(classes=2, members=4, rare=3, class_rows=64, member_rows=64, direct=6, batch=64)
    seen = []
    for rows, shuffles in ((1, "2"), (9, "13")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        got = maxent.scored(docs.repartition(rows), held_out(F.col("doc_id"), 10, 0), shape=shape).collect()
        seen.append(sorted((str(r.doc_id), r.n_tokens, r.score) for r in got))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [x[:2] for x in seen[0]] == [x[:2] for x in seen[1]]
    assert np.allclose([x[2] for x in seen[0]], [x[2] for x in seen[1]], rtol=1e-4)


def test_third_word_before_is_learnt():
    shape = maxent.Shape(classes=2, members=8, rare=2, batch=256)
    rng = np.random.default_rng(7)
    symbols = rng.integers(0, 8, 12000)
    symbols[3::4] = symbols[0::4]  # each fourth word repeats the third before it; all else is chance
    at = np.arange(7, 12000, 4)
    weights = maxent.Weights(shape, np.zeros(4), np.zeros((2, 8)))
    zeros = [[np.zeros(len(t), np.float32) for t in weights.tables] for _ in range(2)]
    weights.learn(symbols, at[:2000], *zeros)
    assert np.exp(weights.log_chances(symbols, at[2000:]).mean()) > 0.5


def test_model_grows_with_the_corpus():
    small, large, huge = (maxent.Shape.of(*x) for x in ((1000, 100), (1 << 27, 1 << 20), (1 << 34, 1 << 26)))
    assert small == maxent.Shape() and small.known == 1024
    assert (large.known, large.class_rows) == (4096, 1 << 15) and huge.known > 30_000
    hashes = np.random.default_rng(1).integers(0, 1 << 62, 1 << 20).astype(np.uint64)
    rows = maxent.Weights.rows(hashes, huge.member_rows)
    assert huge.member_rows > 1 << 16 and rows.max() == huge.member_rows - 1
