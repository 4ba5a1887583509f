"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, shared_folder, slices, staged
from .neardup import shingles

FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "repeated_runs", "upper", "digits", "signs", "marks",
    "high_bytes", "spaces", "lines_per_word", "distinct_lines", "longest_word", "top_word", "one_byte_words",
)
_KIND = np.full(256, 3, np.int64)  # 0 lower, 1 upper, 2 digit, 3 sign, 4 high byte, 5 space, 6 mark
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 6


def statistics(text: bytes | None, hashes: WordHashes) -> list[float]:
    """FEATURES of a whole text; null counts as empty."""
    text = text or b""
    words = text.split()
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=7) / max(1, len(text))
    n = max(1, len(words))
    ids = hashes.of(words)
    _, times = np.unique(ids, return_counts=True)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.sum() / n, len(times) / n,
        1 - len(shingles(ids, 3)) / max(1, len(words) - 2), kinds[1], kinds[2], kinds[3], kinds[6], kinds[4], kinds[5],
        len(lines) / n, len(set(lines)) / max(1, len(lines)), lengths.max(initial=0), times.max(initial=0) / n, (lengths == 1).sum() / n,
    ]


def with_statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, features: array of FEATURES), a row per row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float32()))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start, end, texts in slices(batch, "_bytes"):
                values = np.array([statistics(t, hashes) for t in texts], np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), pa.array(list(values), pa.list_(pa.float32()))], schema=schema)

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_bytes"))
    return own.mapInArrow(emit, "doc_id long, features array<float>")


@dataclass
class Trees:
    """Boosted trees in flat arrays: node i goes to child[i] if feature[i]'s value is at most
    split[i], else to child[i] + 1; a leaf is its own child and adds value[i]. roots: each tree's first node."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    leaf: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 of each row, all trees at once, level by level."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            below = self.child[at] + (x[rows, self.feature[at]] > self.split[at])
            at = np.where(self.leaf[at], at, below)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def boosted(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Trees fitted to the logistic loss by histograms of gradients over at most `bins` bins a feature.

    A level of a tree is grown at once: one histogram of all its nodes per feature. Ties
    between splits go to the first feature and bin. One class only: no trees, a constant.
    """
    chance = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(chance / (1 - chance)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
    margin = np.full(len(y), base)
    roots, feature, split, child, leaf, value = [], [], [], [], [], []

    def node() -> int:
        for column, empty in ((feature, 0), (split, 0.0), (child, 0), (leaf, True), (value, 0.0)):
            column.append(empty)
        return len(leaf) - 1

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        level = [node()]
        roots.append(level[0])
        at = np.zeros(len(y), np.int64)  # the row's place in the level, -1 once in a leaf
        for d in range(depth + 1):
            here = at >= 0
            sum_g, sum_h = (np.bincount(at[here], v[here], len(level)) for v in (g, h))
            for i, k in enumerate(level):
                value[k] = -rate * sum_g[i] / (sum_h[i] + ridge)
            if d == depth:
                margin[here] += np.array([value[k] for k in level])[at[here]]
                break
            best = np.full(len(level), 1e-9)
            choice: dict[int, tuple[int, int]] = {}
            for f in range(x.shape[1]):
                size = len(cuts[f]) + 1
                key = at[here] * size + binned[f, here]
                left_g, left_h = (np.bincount(key, v[here], len(level) * size).reshape(-1, size).cumsum(1)[:, :-1] for v in (g, h))
                right_g, right_h = sum_g[:, None] - left_g, sum_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (sum_g**2 / (sum_h + ridge))[:, None]
                gain[(left_h < least) | (right_h < least)] = 0
                for i in range(len(level)):
                    if gain.shape[1] and (j := int(gain[i].argmax())) >= 0 and gain[i, j] > best[i] + 1e-9:
                        best[i], choice[i] = gain[i, j], (f, j)
            below: list[int] = []
            move = np.full(len(level), -1)
            for i, (f, j) in sorted(choice.items()):
                k = level[i]
                move[i] = len(below)
                below += [node(), node()]
                feature[k], split[k], child[k], leaf[k] = f, float(cuts[f][j]), below[-2], False
            stop = here & (move[at] < 0)
            margin[stop] += np.array([value[k] for k in level])[at[stop]]
            moved = np.full(len(y), -1)
            for i, (f, j) in choice.items():
                own = here & (at == i)
                moved[own] = move[i] + (binned[f, own] > j)
            at, level = moved, below
            if not level:
                break
    empty = not leaf
    return Trees(
        base, np.array(roots, np.int64), np.array(feature if not empty else [0], np.int64), np.array(split if not empty else [0.0]),
        np.array(child if not empty else [0], np.int64), np.array(leaf if not empty else [True]), np.array(value if not empty else [0.0]), depth,
    )


def trained(features: DataFrame, labels: DataFrame, *, rows: int = 50_000) -> Trees:
    """Trees from about `rows` labelled documents at most, chosen by a hash of the id and the features.

    features: (doc_id, features); labels: (doc_id, label 0/1). Labels that are null, or differ for one
    id, are left out; copies of an id and its features count once. The sample's features go to the
    driver: `rows` times 64 bytes.
    """
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    one = one.where("label = other").select("doc_id", "label")
    known = staged(features.select("doc_id", "features").distinct().join(one, "doc_id"), "labelled")
    share = min(1.0, rows / max(1, known.count()))
    place = F.xxhash64(F.lit(11), "doc_id", "features")
    drawn = known.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("place", place).toPandas()
    drawn = drawn.sort_values(["doc_id", "place"], kind="stable")
    x = np.array(drawn["features"].tolist(), np.float32).reshape(-1, len(FEATURES))
    return boosted(x.astype(np.float64), drawn["label"].to_numpy(np.float64))


def scored(features: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score, predicted), a row per row of features; predicted is 1 from a score of 0.5 on."""
    sent = features.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.asarray(part.column("features").flatten(), np.float64).reshape(-1, len(FEATURES))
                score = sent.value.scores(x)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return features.mapInArrow(emit, "doc_id long, score double, predicted int")
