"""Nearest neighbours by largest inner product: multi-index hashing of learnt binary codes.

Distinct vectors get a code of `bits` signs after learnt rotations. A vector with a smaller norm
than the largest first gets one more coordinate that fills the norm up, which turns the largest
inner product into the smallest angle, and the share of differing signs follows the angle.

Codes are cut into substrings of 16 bits, each with its own index from value to rows. Codes within
radius r of a query have at least one substring within r / substrings of the query's (pigeonhole,
with the remainder dealt to the first substrings), so these values are probed in each index, and
every code within the radius is found. The radius is widened until as many rows as are wanted were
found; the worst score among them then gives the angle that any better row must keep, and with a
margin measured on the sample the last radius. Rows within it are ranked by their floats.

Searching is a tiling: rows are dealt to blocks by a hash of the vector, queries to blocks of
queries, and a pair of blocks meets in one group of bounded size, with its own indexes. Repeated
vectors are searched once: an index row carries the smallest ids of its vector, as many as any
answer can use, so no group of copies grows.

Fixed by a bounded sample (`sample` distinct vectors at most, those with the least hashes): the
rotations, the first radius and the margin. All rows are indexed. Growth: on vectors that point
everywhere alike, near and far codes differ by little, and a large part of each index is probed.

Rows whose vector is null, empty, zero (below 1e-150), of another length than the most frequent
one (ties: the longer), or that hold null, non-finite or huge (1e150) components, or that have a
null id, take no part. Rows with the query's id are its own and no candidates. Rows that share id
and vector are one row; an id with several vectors is a query, and a candidate, for each. Ties go
to the smaller id. Fewer candidates than `k` are all returned; an empty table gives no rows. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, staged

#: Rows and queries of a pair of blocks.
BLOCK, QUERIES = 16_384, 2_048
_POP16 = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
#: All substrings by their number of set bits: flipping these reaches every value at that distance.
_FLIPS = [np.flatnonzero(_POP16 == i).astype(np.uint16) for i in range(17)]
_BALL = [np.concatenate(_FLIPS[: i + 1]) for i in range(17)]


class Code:
    """Rotations, the largest norm, and what the sample says about radii. `bits` is a multiple of 64."""

    def __init__(self, sample: np.ndarray, longest: float, bits: int = 256, k: int = 20, turns: int = 15) -> None:
        if bits <= 0 or bits % 64:
            raise ValueError("bits must be a multiple of 64")
        self.longest, self.bits, self.k = longest, bits, k
        rng = np.random.default_rng(12)
        rows = self._filled(sample)
        d = rows.shape[1]
        self.rotations = np.hstack([self._learnt(rows, rng, turns) for _ in range(-(-bits // d))])[:, :bits]
        self.margin, self.spread = 2.5, np.arange(bits + 1, dtype=float) / bits
        if len(sample) > 4 * k:
            self._measure(sample)

    def _filled(self, rows: np.ndarray) -> np.ndarray:
        unit = rows / self.longest
        missing = np.sqrt(np.maximum(0.0, 1 - (unit**2).sum(axis=1)))
        return np.hstack([unit, missing[:, None]])

    @staticmethod
    def _learnt(rows: np.ndarray, rng: np.random.Generator, turns: int) -> np.ndarray:
        """A rotation that brings rows near the corners of the cube: signs and rotation by turns."""
        rotation, _ = np.linalg.qr(rng.standard_normal((rows.shape[1],) * 2))
        for _ in range(turns):
            left, _, right = np.linalg.svd(rows.T @ np.where(rows @ rotation < 0, -1.0, 1.0))
            rotation = left @ right
        return rotation

    def codes(self, rows: np.ndarray, query: bool = False) -> np.ndarray:
        """Signs as packed 16-bit substrings; a query's filling coordinate is 0."""
        full = np.hstack([rows / self.longest, np.zeros((len(rows), 1))]) if query else self._filled(rows)
        return np.packbits(full @ self.rotations >= 0, axis=1).view(np.uint16)  # whole 64-bit words

    def expected(self, cosine: float) -> tuple[float, float]:
        """Mean and deviation of the number of differing signs at an angle."""
        p = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
        return self.bits * p, math.sqrt(self.bits * p * (1 - p))

    def radius(self, cosine: float) -> int:
        mean, deviation = self.expected(cosine)
        return min(self.bits, int(mean + self.margin * deviation) + 2)

    def _measure(self, sample: np.ndarray) -> None:
        """How far differing signs exceed their mean among near pairs, and how they lie among all."""
        own = self.codes(sample).view(np.uint64)
        asked = sample[:256]
        scores = asked @ sample.T
        scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        norms = np.linalg.norm(asked, axis=1) * self.longest
        over, counts = [], np.zeros(self.bits + 1)
        for i, code in enumerate(self.codes(asked, query=True)):
            apart = np.bitwise_count(own ^ code.view(np.uint64)).sum(axis=1, dtype=np.int64)
            counts += np.bincount(apart, minlength=self.bits + 1)
            for j in np.argpartition(-scores[i], self.k)[: self.k]:
                mean, deviation = self.expected(scores[i, j] / norms[i])
                over.append((apart[j] - mean - 2) / max(deviation, 0.5))
        self.margin = max(1.0, float(np.quantile(over, 0.98)))
        self.spread = np.cumsum(counts) / counts.sum()

    def first_radius(self, rows: int) -> int:
        """Where about twice the wanted number of rows is expected."""
        return int(np.searchsorted(self.spread, min(1.0, 2 * self.k / max(rows, 1))))


class Index:
    """The codes of a block of rows, with an index per substring."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for column in codes.T:
            values, place, counts = np.unique(column, return_inverse=True, return_counts=True)
            starts = np.concatenate([[0], np.cumsum(counts)])
            self.tables.append((values, starts, np.argsort(column, kind="stable"), place))

    def probe(self, code: np.ndarray) -> Callable[[int], np.ndarray]:
        """A function from a radius to all rows whose code is within it.

        By the pigeonhole the indexes are probed, and all bits of what they hold are counted. Once
        that is half of the rows, the bits of all rows are counted, and kept for larger radii.
        """
        apart: np.ndarray | None = None
        words = self.codes.view(np.uint64)
        bits = np.ascontiguousarray(code).view(np.uint64)

        def within(radius: int) -> np.ndarray:
            nonlocal apart
            if apart is None:
                near = self._probed(code, radius)
                if near is not None:
                    rows = np.flatnonzero(near)
                    return rows[np.bitwise_count(words[rows] ^ bits).sum(axis=1, dtype=np.int64) <= radius]
                apart = np.bitwise_count(words ^ bits).sum(axis=1, dtype=np.int64)
            return np.flatnonzero(apart <= radius)

        return within

    def _probed(self, code: np.ndarray, radius: int) -> np.ndarray | None:
        """Which rows share a substring up to its part of the radius; None once they are half of all."""
        m = len(self.tables)
        each, rest = divmod(radius, m)
        near = np.zeros(len(self.codes), dtype=bool)
        for at, (values, starts, order, place) in enumerate(self.tables):
            reach = min(16, each if at <= rest else each - 1)
            if reach < 0:
                continue
            if len(_BALL[reach]) < len(values):
                probes = _BALL[reach] ^ code[at]
                found = np.searchsorted(values, probes)
                found = found[values[np.minimum(found, len(values) - 1)] == probes]
            else:  # fewer values occur than the ball holds: go through those
                found = np.flatnonzero(_POP16[values ^ code[at]] <= reach)
            if len(found) <= 64:
                for b in found:
                    near[order[starts[b] : starts[b + 1]]] = True
            else:
                hit = np.zeros(len(values), dtype=bool)
                hit[found] = True
                near |= hit[place]
                if 2 * np.count_nonzero(near) > len(near):
                    return None
        return near


def _search(code: Code, vectors: np.ndarray, ids: list[np.ndarray], asked: np.ndarray, asked_ids: np.ndarray) -> Iterator[tuple]:
    """(query, vec_id, score) of each query's nearest in one block of rows."""
    k = code.k
    index = Index(code.codes(vectors))
    sizes = np.array([len(x) for x in ids])
    lone = np.array([x[0] for x in ids])
    for at, (vector, own, bits) in enumerate(zip(asked, asked_ids, code.codes(asked, query=True), strict=True)):

        within = index.probe(bits)

        def ranked(radius: int, vector=vector, own=own, within=within) -> list[tuple]:
            rows = within(radius)
            rows = rows[(sizes[rows] > 1) | (lone[rows] != own)]
            scores = (vectors[rows] * vector).sum(axis=1)
            if len(rows) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[scores >= least], scores[scores >= least]
            flat = np.concatenate([ids[r] for r in rows]) if len(rows) else np.zeros(0, np.int64)
            score = np.repeat(scores, sizes[rows])
            score, flat = score[flat != own], flat[flat != own]
            best = np.lexsort((flat, -score))[:k]
            return list(zip(flat[best].tolist(), score[best].tolist(), strict=True))

        radius = code.first_radius(len(vectors))
        found = ranked(radius)
        while len(found) < k and radius < code.bits:
            radius = min(code.bits, radius + max(4, radius // 8))
            found = ranked(radius)
        if found:
            last = code.radius(found[-1][1] / max(np.linalg.norm(vector) * code.longest, 1e-300))
            if last > radius:
                found = ranked(last)
        for vec_id, score in found:
            yield at, vec_id, score


def _usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e150)
    own = F.col(vector).cast("array<double>")
    picked = rows.select(F.col(vec_id).cast("long").alias("vec_id"), own.alias("vector")).where("vec_id IS NOT NULL")
    some = F.exists("vector", lambda c: F.abs(c) > 1e-150)
    return picked.where(F.coalesce(F.forall("vector", fits) & some, F.lit(False)))


def _distinct(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): each distinct vector with its k + 1 smallest ids; no answer can use more."""
    once = rows.groupBy("vector", "vec_id").agg(F.lit(0).alias("_"))
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    few = once.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def learnt(distinct: DataFrame, d: int, sample: int = 8_192, bits: int = 256, k: int = 20) -> Code:
    """The code, fitted on the distinct vectors with the least hashes; the largest norm is over all."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, c: a + c * c))
    longest = distinct.agg(F.max(norm).alias("m")).first().m
    most = max(256, min(sample, (1 << 23) // d))
    picked = distinct.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(most).collect()
    return Code(np.array([r.vector for r in picked]), longest * (1 + 1e-12), bits, k)


def nearest(
    rows: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding",
    k: int = 20, bits: int = 256, sample: int = 8_192, block: int = BLOCK,
) -> DataFrame:
    """The k nearest rows of each row that `queries` (a condition on vec_id) picks: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    shared_folder(spark)
    usable = _usable(rows, vec_id, vector)
    lengths = usable.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    names = "query_id long, rank int, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], names)
    usable = usable.where(F.size("vector") == most.d)
    index = staged(_distinct(usable, k), "vectors")
    asked = staged(usable.where(queries).distinct(), "queries")
    n_rows, n_asked = index.count(), asked.count()
    code = learnt(index, most.d, sample, bits, k)
    by_block, by_query = max(1, -(-n_rows // block)), max(1, -(-n_asked // QUERIES))
    tile = lambda n, *of: F.pmod(F.xxhash64(*of, F.lit(1)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("row_block", tile(by_block, "vector")).withColumn("query_block", every(by_query))
    right = asked.withColumn("query_block", tile(by_query, "vec_id", "vector")).withColumn("row_block", every(by_block))
    out = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def cell(these: pa.Table, those: pa.Table) -> pa.Table:
        if not (these.num_rows and those.num_rows):
            return out.empty_table()
        matrix = lambda t: t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        ids = these.column("ids").combine_chunks()
        offsets, flat = ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy(zero_copy_only=False)
        lists = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        asked_ids = those.column("vec_id").to_numpy()
        keys = those.column("key").to_numpy()
        found = list(_search(code, matrix(these), lists, matrix(those), asked_ids))
        at = np.array([f[0] for f in found], dtype=np.int64)
        return pa.table(
            [asked_ids[at], keys[at], np.array([f[1] for f in found], np.int64), np.array([f[2] for f in found], float)], schema=out
        )

    right = right.withColumn("key", F.xxhash64("vector"))
    cells = left.groupBy("row_block", "query_block").cogroup(right.groupBy("row_block", "query_block")).applyInArrow(
        cell, "query_id long, key long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
