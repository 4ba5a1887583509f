"""Embedding whitening: exact moments in Spark, components by QDWH spectral divide and conquer.

The covariance of whole numbers is summed exactly and centred before it is multiplied. Its
eigenvectors come from polar decompositions: the polar factor of the covariance, shifted, is the
sign of each eigenvalue's distance from the shift, so half of it plus half the identity projects
on the subspace above. The covariance restricted to that subspace and to its complement are split
again until a subspace is one component. The polar factor is found by QR-based dynamically
weighted Halley steps. The matrix is dimensions by dimensions, whatever the number of rows; only
it is on the driver, and the projection goes to the tasks.

Rows whose vector is null, empty, of another length than the most frequent one (ties: the longer),
or holds null or non-finite entries, or entries of 2^45 or more (whose squares leave the exact
sums), take no part. Repeated rows and null ids stay. A component without variance (a vanishing part of
the largest) has no whitened value and is left out, so equal rows, or one row, or an empty table
give no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 64, 1_000_000
#: Halley steps from the smallest lower bound to convergence are six; more mean no convergence.
STEPS = 12
_EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = _EPS / n  # a lower bound of the singular values that count
    for _ in range(STEPS):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        after = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        low = min(low * (h + b * low**2) / (1 + c * low**2), 1.0)
        moved, x = np.linalg.norm(after - x), after
        if 1 - low < 8 * _EPS and moved < 1e-12 * np.sqrt(n):
            break
    return x


def _basis(projector: np.ndarray, rank: int, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal basis of a projector's range, by two steps of subspace iteration."""
    q, _ = np.linalg.qr(projector @ rng.standard_normal((len(projector), rank)))
    return np.linalg.qr(projector @ q)[0]


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if no shift parts them."""
    n, middle = len(a), np.trace(a) / len(a)
    for shift in (np.median(np.diag(a)), middle, middle + np.linalg.norm(a - middle * np.eye(n)) / (8 * n)):
        away = a - shift * np.eye(n)
        if not np.any(away):
            continue
        projector = (polar(away) + np.eye(n)) / 2
        above = np.trace(projector)
        rank = int(round(above))
        if not 0 < rank < n or abs(above - rank) > 1e-6:
            continue  # the shift met an eigenvalue or lies at an end of the spectrum
        both = np.hstack([_basis(projector, rank, rng), _basis(np.eye(n) - projector, n - rank, rng)])
        both, _ = np.linalg.qr(both)
        upper, lower = both[:, :rank], both[:, rank:]
        if np.linalg.norm(upper.T @ a @ lower) <= 1e-11 * np.linalg.norm(a):
            return upper, lower
    return None


def spectral(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    rng = np.random.default_rng(11)
    whole = max(np.linalg.norm(matrix), np.finfo(float).tiny)
    done: list[np.ndarray] = []
    waiting = [np.eye(len(matrix))]
    while waiting:
        basis = waiting.pop()
        inner = basis.T @ matrix @ basis
        inner = (inner + inner.T) / 2
        n = len(inner)
        spread = inner - np.trace(inner) / n * np.eye(n)
        parts = None if n == 1 or np.linalg.norm(spread) <= n * _EPS * whole else _split(inner, rng)
        if parts is None:
            # one component, or a subspace in which every direction is one
            done.append(basis)
        else:
            waiting += [basis @ part for part in parts]
    vectors, _ = np.linalg.qr(np.hstack(done))
    values = np.einsum("ij,ik,kj->j", vectors, matrix, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(matrix))]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def _usable(rows: DataFrame, vector: str, *keep) -> DataFrame:
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**45)
    own = F.col(vector).cast("array<double>")
    picked = rows.select(*keep, own.alias("vector"))
    return picked.where(F.coalesce((F.size("vector") > 0) & F.forall("vector", fits), F.lit(False)))


def _numbers(batch: pa.RecordBatch, d: int) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, d) + OFFSET


def _products(y: np.ndarray, z: np.ndarray) -> list[list[int]]:
    """Exact sums of products of whole numbers: in doubles where they hold them, else in integers."""
    out = np.zeros((y.shape[1], z.shape[1]), dtype=object)
    for at in range(0, len(y), 4096):
        a, b = y[at : at + 4096], z[at : at + 4096]
        if float(np.abs(a).max()) * float(np.abs(b).max()) * len(a) < 2.0**53:
            out += np.rint(a.T.astype(float) @ b.astype(float)).astype(np.int64).astype(object)
        else:
            out += a.T.astype(object) @ b.astype(object)
    return out.tolist()


def _summed(rows: DataFrame, work, d: int) -> np.ndarray:
    """The d x d sums of what `work` makes of each batch, added up per task and then by Spark."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.decimal128(38, 0))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = np.array(work(batch), dtype=object)
                total = found if total is None else total + found
        if total is not None:
            i, j = np.indices(total.shape)
            cells = [Decimal(int(v)) for v in total.ravel()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(cells, pa.decimal128(38, 0))],
                schema=schema,
            )

    cells = rows.mapInArrow(task, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d), dtype=object)
    for r in cells.collect():  # as many as dimensions squared
        out[r.i, r.j] = int(r.v)
    return out


class Whitening:
    """What the fit list says: n, the sums of each dimension, components and their variances."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, most: int) -> None:
        self.n, self.sums = n, sums
        kept = values > max(values[0], 0) * len(values) * _EPS * 16 if len(values) else values > 0
        kept &= np.arange(len(values)) < most
        self.values, self.explained = values[kept], values[kept] / trace if trace else values[kept]
        self.matrix = vectors[:, kept] / np.sqrt(values[kept])
        self.identity_error = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """The components of each row of whole numbers; (n * x - S) / n is rounded once."""
        return self._deviations(x).astype(float) / self.n @ self.matrix

    def _deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in Python integers where longs would not hold it."""
        if (float(np.abs(x).max()) + 1) * self.n < 2.0**61:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n * x - S; null beyond a long."""
        y = self._deviations(x)
        if float(np.abs(y.astype(float)).max()) ** 2 * y.shape[1] < 2.0**62:
            return (y.astype(np.int64) ** 2).sum(axis=1).tolist()
        sums = (y.astype(object) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in sums]


def _length_and_sums(rows: DataFrame, vector: str) -> tuple[int, int, list[int]]:
    """The dimension that vectors have, how many have it, and the sums of their whole numbers."""
    usable = _usable(rows, vector)
    lengths = usable.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, 0, []
    whole = (F.floor(F.lit(float(SCALE)) * F.col("c")) + F.lit(OFFSET)).cast("decimal(38,0)")
    sums = (
        usable.where(F.size("vector") == most.d)
        .select(F.posexplode("vector").alias("i", "c"))
        .groupBy("i").agg(F.sum(whole).alias("s"))
    )
    return most.d, most.n, [int(r.s) for r in sums.orderBy("i").collect()]


def fitted(rows: DataFrame, vector: str = "embedding", most: int = 32) -> Whitening:
    """Moments of all usable rows and up to `most` components; with the error of the whitened covariance."""
    d, n, sums = _length_and_sums(rows, vector)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, most)
    vectors = _usable(rows, vector).where(F.size("vector") == d)
    centre = np.array([s // n for s in sums], dtype=np.int64)
    rest = [s - n * (s // n) for s in sums]

    def centred(batch: pa.RecordBatch) -> list[list[int]]:
        y = _numbers(batch, d) - centre
        return _products(y, y)

    products = _summed(vectors, centred, d)
    square = n * n
    covariance = np.array(
        [[float(Fraction(n * int(products[i, j]) - rest[i] * rest[j], square)) for j in range(d)] for i in range(d)]
    )
    values, components = spectral(covariance)
    model = Whitening(n, sums, values, components, float(np.trace(covariance)), most)
    model.identity_error = _identity_error(vectors, model, d)
    return model


def _identity_error(vectors: DataFrame, model: Whitening, d: int) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    width = len(model.values)
    if not width:
        return 0.0
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(_numbers(batch, d))
                total += np.vstack([w.T @ w, w.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], schema=schema
        )

    found = np.zeros((width + 1, width))
    cells = vectors.mapInArrow(task, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in cells.collect():  # components squared
        found[r.i, r.j] = r.v
    mean = found[width] / model.n
    return float(np.abs(found[:width] / model.n - np.outer(mean, mean) - np.eye(width)).max())


def whitened(rows: DataFrame, model: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    d, width = len(model.sums), len(model.values)
    names = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    schema = pa.schema([(part.split()[0], t) for part, t in zip(names.split(", "), types, strict=True)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows if width else 0, 2048):
                batch = whole.slice(at, 2048)
                x, size = _numbers(batch, d), batch.num_rows
                ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(size), width)))
                far = pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(size), width)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * width, model.n)), far, pa.array(model.whitened(x).ravel()),
                        pa.array(np.tile(model.explained, size)), pa.array(np.full(size * width, model.identity_error)),
                    ],
                    schema=schema,
                )

    own = _usable(rows, vector, F.col(vec_id).cast("long").alias("vec_id")).where(F.size("vector") == d)
    return own.mapInArrow(task, names)
