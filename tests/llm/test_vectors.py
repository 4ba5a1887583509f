"""Whitening and nearest neighbours against brute force, with every odd kind of row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import neighbours, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, vector string, ids string, rank string, key int, i int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, -1, "clash", "clash", "clash", 0, 0) for i, v in rows], SCHEMA)


ODD = [
    (900, None), (901, [math.nan] * 6), (902, [1.0, math.inf, 0.0, 0.0, 0.0, 0.0]), (903, []),
    (904, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (905, [1.0, 2.0]), (906, [1.0] * 7),
]


def single(values):
    """As floats of four bytes."""
    return [float(x) for x in np.array(values, dtype=np.float32)]


# --- whitening ------------------------------------------------------------------------


def matrices():
    rng = np.random.default_rng(3)
    turn = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]
    few = rng.standard_normal((8, 30))
    for values in (np.arange(1.0, 41.0), 10.0 ** -np.arange(30.0), [3.0] * 7 + [1.0] * 9, [5.0, 5.0 + 1e-13, 1.0], [0.0] * 4 + [2.0]):
        q = turn(len(values))
        yield q @ np.diag(values) @ q.T
    yield from (few.T @ few, np.eye(5), np.zeros((3, 3)), np.array([[2.0]]), np.diag([1.0, 2.0, 2.0, 9.0]))


@pytest.mark.parametrize("matrix", list(matrices()), ids=lambda m: str(len(m)))
def test_divide_and_conquer_finds_the_spectrum(matrix):
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.spectral(matrix)
    scale = max(np.linalg.norm(matrix), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1], rtol=0, atol=1e-13 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(matrix)), atol=1e-13)
    assert np.linalg.norm(matrix @ vectors - vectors * values) < 1e-12 * scale


def test_polar_factor_is_the_sign_of_the_matrix():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    values, vectors = np.linalg.eigh(a)
    assert np.allclose(u, vectors @ np.diag(np.sign(values)) @ vectors.T, atol=1e-12)
    assert np.allclose(u @ u, np.eye(30), atol=1e-12)


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def test_whitened_rows(spark):
    rng = random.Random(1)
    rows = [(i if i % 9 else None, single([rng.gauss(3 * j, 1 + j) for j in range(6)])) for i in range(120)]
    rows += [rows[5]] * 3 + ODD
    found = table(spark, rows).repartition(5)
    model = whitening.fitted(found, most=4)
    got = whitening.whitened(found, model).collect()
    kept = [(i, v) for i, v in rows if v and len(v) == 6 and None not in v and all(map(math.isfinite, v))]
    n, x = len(kept), np.array([whole(v) for _, v in kept])
    total = [sum(int(a) for a in column) for column in x.T]
    assert model.n == n and model.sums == total and len(got) == 4 * n
    centred = (x * n - np.array(total)) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    want = centred @ vectors / np.sqrt(values)
    sides = []
    for c in range(4):
        mine = sorted((r.vec_id or -1, r.deviation, abs(r.whitened)) for r in got if r.component == c + 1)
        theirs = sorted((i or -1, sum((n * int(a) - s) ** 2 for a, s in zip(row, total, strict=True)), abs(w))
                        for (i, _), row, w in zip(kept, x, want[:, c], strict=True))
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        assert np.allclose([m[2] for m in mine], [t[2] for t in theirs], atol=1e-9)
        explained = {r.explained for r in got if r.component == c + 1}
        assert len(explained) == 1 and math.isclose(explained.pop(), values[c] / np.trace(centred.T @ centred / n), rel_tol=1e-9)
        signs = {np.sign(r.whitened) * np.sign(want[k, c]) for k, (i, _) in enumerate(kept) if i == 7 for r in got if r.vec_id == 7 and r.component == c + 1}
        sides.append(signs)
    assert all(len(s) == 1 for s in sides)  # one sign for all rows
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_without_variance(spark):
    flat = [[1.0, 2.0, 3.0]] * 4
    line = [[float(i), float(i), 5.0] for i in range(5)]
    for vectors, components in (([], 0), ([None], 0), (flat[:1], 0), (flat, 0), (line, 1)):
        rows = table(spark, list(enumerate(vectors)))
        got = whitening.whitened(rows, whitening.fitted(rows)).collect()
        assert {r.component for r in got} == set(range(1, components + 1))
        assert len(got) == components * len(vectors)


def test_sums_beyond_doubles_and_longs(spark):
    rng = random.Random(8)
    rows = [(i, single([rng.uniform(-1, 1) * 2.0**44, rng.uniform(-1, 1)])) for i in range(40)]
    found = table(spark, rows)
    model = whitening.fitted(found)
    got = whitening.whitened(found, model).collect()
    x = [whole(v) for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert model.sums == sums
    far = [sum((40 * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    by = {r.vec_id: r.deviation for r in got}
    assert by == {i: f if f < 2**63 else None for i, f in enumerate(far)} and None in by.values()


# --- nearest neighbours ---------------------------------------------------------------


def nearest_by_brute_force(rows, asked, k):
    """For each asked row: ids by falling inner product, then by id."""
    rows = sorted({(i, tuple(v)) for i, v in rows}, key=str)
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if asked(i):
            score = (m * np.array(v)).sum(axis=1)
            score[ids == i] = -np.inf
            best = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in best]
    return out


def spread(n, d, rng):
    """Directions everywhere, clusters, near copies, and norms of all sizes."""
    out = rng.standard_normal((n, d))
    out /= np.linalg.norm(out, axis=1)[:, None]
    out[: n // 4] = out[0] + 0.3 * out[: n // 4]
    out[n // 4 : n // 2] = out[n // 4 : n // 2] * rng.uniform(0.2, 3, n // 4)[:, None]
    out[-20:] = out[-21] + 0.01 * rng.standard_normal((20, d))
    return out


@pytest.mark.parametrize("d, bits, block", [(16, 256, 300), (48, 128, 16_384), (3, 64, 100)])
def test_nearest_rows(spark, d, bits, block):
    rng = np.random.default_rng(d)
    rows = [(i, single(v)) for i, v in enumerate(spread(1_000, d, rng))]
    clean = rows + [(2_000 + i, rows[50][1]) for i in range(60)] + [rows[40]] * 5  # ties, repeated rows
    odd = [(1_900 + i, v if not v or len(v) < 6 else (v * d)[:d] if len(v) == 6 else v) for i, (_, v) in enumerate(ODD)]
    odd = [(i, v) for i, v in odd if not v or len(v) != d or None in v or not all(map(math.isfinite, v))]
    odd += [(1_980, [0.0] * d), (None, rows[0][1])]
    found = neighbours.nearest(
        table(spark, clean + odd).repartition(3), F.col("vec_id") % 20 == 0, k=10, bits=bits, sample=400, block=block
    ).collect()
    want = nearest_by_brute_force(clean, lambda i: i % 20 == 0, 10)
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r["rank"]
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    hits = sum(len(set(want[i]) & set(got[i])) for i in want)
    assert hits >= 0.95 * 10 * len(want)
    scores = {i: dict(nearest_by_brute_force(clean, lambda j, i=i: j == i, 10**6)[i]) for i in list(want)[:5]}
    assert all(scores[i][j] == s for i in scores for j, s in got[i])
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())
    assert [i for i, _ in got[2_000]] == [i for i, _ in want[2_000]]  # equal scores: smaller ids first


def test_few_rows_and_ids_with_several_vectors(spark):
    assert neighbours.nearest(table(spark, ODD[:2]), F.col("vec_id") % 2 == 0).collect() == []
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 3.0]), (0, [1.0, 0.0])]
    got = neighbours.nearest(table(spark, rows), F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (0, 1, 1, 1.0), (0, 1, 2, 3.0), (0, 2, 1, 1.0), (0, 2, 2, -1.0),
    ]
    alone = neighbours.nearest(table(spark, [(5, [1.0, 0.0])] * 3), F.col("vec_id") == 5)
    assert alone.collect() == []


def test_index_holds_every_code_within_a_radius():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 16, (40, 8), dtype=np.uint16)
    codes = np.vstack([base, base ^ (rng.random((40, 8, 16)) < 0.05).dot(1 << np.arange(16)).astype(np.uint16)])
    index = neighbours.Index(codes)
    for code in codes[::7]:
        growing = index.probe(code)
        apart = np.bitwise_count(codes ^ code).sum(axis=1)
        for radius in (0, 1, 7, 8, 9, 20, 63, 64, 100, 128):
            assert index.probe(code)(radius).tolist() == np.flatnonzero(apart <= radius).tolist()
            assert growing(radius).tolist() == np.flatnonzero(apart <= radius).tolist()
