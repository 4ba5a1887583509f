"""Sets of members in the language model, and words split and counted in Arrow."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import maxent

ODD = ["", " ", None, "  a b\x0b\x0c\r\nC ", "Ä ä x\u0085y   z\x1c", "\0 \0", "E e E", "one\ttwo\n\nthree"]


def weights_of(rng, **sizes):
    shape = maxent.Shape(classes=3, rare=2, class_rows=16, batch=500, **sizes)
    weights = maxent.Weights(shape, rng.normal(size=5), np.log(rng.dirichlet(np.ones(shape.members), 3)))
    weights.tables = [rng.normal(size=t.shape).astype(np.float32) for t in weights.tables]
    return shape, weights


def test_wide_classes_read_few_weights_a_place():
    """Columns read at a place grow with the root of the members, and no weights are lost by that."""
    for tokens, vocabulary in ((1 << 27, 1 << 20), (122_000_000, 3_300_000), (1 << 34, 1 << 26)):
        shape = maxent.Shape.of(tokens, vocabulary)
        whole = maxent.Shape.of(tokens, vocabulary)
        whole.sets = 1
        assert sum(w for _, w in shape.tables[1:]) <= 2 * math.sqrt(shape.members) + 2 < whole.tables[1][1] / 3
        assert sum(n * w for n, w in shape.tables) >= sum(n * w for n, w in whole.tables)


@pytest.mark.parametrize(("members", "sets"), [(6, 2), (5, 2), (7, 3), (7, 5)])
def test_sets_by_brute_force(members, sets):
    """Chances of every symbol at a place, and the weights after one batch, from the definition; sets may be part empty."""
    rng = np.random.default_rng(members)
    shape, weights = weights_of(rng, members=members, member_rows=16, sets=sets)
    known, width = shape.known, shape.set_members
    symbols, at = rng.integers(0, known + 2, 120), np.arange(3, 120)
    slope, want = [np.zeros(t.shape) for t in weights.tables], []

    def chances(table, hashes, bias):
        rows = weights.rows(hashes, len(weights.tables[table]))[:, 0]
        x = bias + weights.tables[table][rows].astype(float).sum(0)
        e = np.exp(x - x.max())
        return rows, e / e.sum()

    for place in at:
        features, s = weights.features(symbols, np.array([place])), int(symbols[place])
        group = s // members if s < known else 3 + s - known
        met = [(0, *chances(0, features, weights.class_bias), group)]
        if s < known:
            of, inner = divmod(s % members, width)
            with np.errstate(over="ignore"):
                hashes = features + np.uint64(group + 1) * np.uint64(0xD6E8FEB86659FD93)
                deeper = hashes + np.uint64(of + 1) * np.uint64(0xA0761D6478BD642F)
            met += [(1, *chances(1, hashes, weights.set_bias[group]), of), (2, *chances(2, deeper, weights.inner_bias[group * sets + of]), inner)]
        want.append(sum(math.log(p[column]) for _, _, p, column in met))
        for t, rows, p, column in met:
            np.add.at(slope[t], rows, p - np.eye(len(p))[column])
    assert np.allclose(weights.log_chances(symbols, at), want, atol=1e-4)
    total = 0.0
    for s in range(known + 2):
        other = symbols.copy()
        other[50] = s
        total += math.exp(weights.log_chances(other, np.array([50]))[0])
    assert abs(total - 1) < 1e-4
    before = [t.copy() for t in weights.tables]
    weights.learn(symbols, at, *[[np.zeros(len(t), np.float32) for t in before] for _ in range(2)])
    for t, rate in enumerate(shape.rates):
        step = rate * slope[t] / np.sqrt((slope[t] ** 2).mean(1, keepdims=True) + 1e-6)
        assert np.allclose(weights.tables[t], before[t] - step, atol=1e-3)


def test_sets_keep_the_words_own_chances_without_weights():
    shape, weights = weights_of(np.random.default_rng(1), members=7, member_rows=16, sets=3)
    weights.tables = [np.zeros_like(t) for t in weights.tables]
    symbols = np.concatenate([[0, 0, 0], np.arange(shape.known)])
    bias = weights.class_bias.astype(float)
    bias -= np.log(np.exp(bias).sum())
    want = np.repeat(bias[:3], 7) + weights.member_bias.astype(float).ravel()
    assert np.allclose(weights.log_chances(symbols, np.arange(3, len(symbols))), want, atol=1e-5)


def test_words_are_split_as_bytes_are():
    texts = [None if t is None else t.encode() for t in ODD] + [b"\xff\xfe A\xc3 b"]
    words, sizes = maxent.split_words(texts)
    want = [(t or b"").lower().split() for t in texts]
    assert words.to_pylist() == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
    for none in ([], [None], [b" "]):
        words, sizes = maxent.split_words(none)
        assert len(words) == 0 and sizes.tolist() == [0] * len(none)


def test_counts_are_sent_in_runs(spark, monkeypatch):
    """All words are counted, however many a task holds at a time."""
    texts = ODD * 30
    want = Counter(w for t in texts for w in [*(t or "").encode().lower().split(), maxent.END])
    docs = spark.createDataFrame([(t,) for t in texts], "text string").select(F.col("text").cast("binary").alias("_bytes"))
    for waiting in (1, 50, 1 << 22):
        monkeypatch.setattr(maxent, "WAITING", waiting)
        got = {bytes(r["word"]): r["n"] for r in maxent.token_counts(docs).collect()}
        assert got == want
    assert maxent.token_counts(docs.limit(0)).isEmpty()


@pytest.mark.parametrize("rare", [3, 70_000])
def test_texts_are_dealt_as_their_symbols(spark, rare):
    """Every symbol of every text goes to its part, in as few bytes as hold all symbols."""
    shape = maxent.Shape(classes=2, members=2, rare=rare)
    vocabulary = maxent.Vocabulary(shape, [(maxent.END, 9), (b"a", 5), (b"b", 4), (b"e", 3)])
    rows = [(i % 3, i, None if t is None else bytearray(t.encode())) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "_part long, _place long, _bytes binary")
    got = maxent._numbered(docs, spark.sparkContext.broadcast(vocabulary)).collect()
    assert sorted((r["_part"], r["_place"]) for r in got) == sorted(r[:2] for r in rows)
    assert shape.symbol == (np.uint16 if rare == 3 else np.uint32)
    number = {b"a": 1, b"b": 2, b"e": 3}
    for r in got:
        words = (ODD[r["_place"]] or "").encode().lower().split()
        want = [0, 0, 0, *(number.get(w, 4 + w[-1] % rare) for w in words), 0]
        assert np.frombuffer(r["_symbols"], shape.symbol).tolist() == want
    assert maxent._numbered(docs.limit(0), spark.sparkContext.broadcast(vocabulary)).isEmpty()
