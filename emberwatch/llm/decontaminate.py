"""Benchmark decontamination: BM25 over test items, block-max pruning, then exact overlap."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices

#: Items of a postings block.
BLOCK = 4
#: Bounds that are added up at a time, of four bytes each.
CELLS = 1 << 22

#: A-Z to lower case, other ASCII signs than letters and digits to spaces; bytes of other scripts stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _grams(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


class Index:
    """BM25 impacts of test items, each as a share of the item's score against itself.

    items: (item_id, question, answer) with the texts as bytes. Passages are pairs of
    neighbouring parts of `step` words, step being the longest item's length, so that each
    occurrence of an item lies within a passage.
    """

    def __init__(self, items: list[tuple[int, bytes, bytes]], least: float, overlap: float, k: int, k1: float = 1.2, b: float = 0.75) -> None:
        self.least, self.overlap, self.k = least, overlap, k
        split = [(i, _words(q), _words(a)) for i, q, a in items]
        split = sorted((x for x in split if x[1] or x[2]), key=lambda x: x[0])
        self.ids = [x[0] for x in split]
        self.question = [_grams(q, k) for _, q, _ in split]
        self.answer = [_grams(a, k) for _, _, a in split]
        words = [Counter([*q, *a]) for _, q, a in split]
        sizes = [sum(c.values()) for c in words]
        self.step = max(sizes, default=1)
        usual = max(1.0, sum(sizes) / max(1, len(sizes)))
        df = Counter(w for c in words for w in c)
        idf = {w: math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        self.term = {w: t for t, w in enumerate(sorted(df))}
        blocks = -(-len(words) // BLOCK) or 1
        #: Per block of items and term, the greatest impact; per block, its terms and their impacts on its items.
        self.block_bound = np.zeros((len(self.term), blocks), np.float32)
        postings: list[dict[int, np.ndarray]] = [defaultdict(lambda: np.zeros(BLOCK)) for _ in range(blocks)]
        for item, (c, size) in enumerate(zip(words, sizes, strict=True)):
            impact = {w: idf[w] * n * (k1 + 1) / (n + k1 * (1 - b + b * size / usual)) for w, n in c.items()}
            own = sum(impact.values())
            for w, x in impact.items():
                t, block = self.term[w], item // BLOCK
                postings[block][t][item % BLOCK] = x / own
                self.block_bound[t, block] = max(self.block_bound[t, block], x / own)
        self.term_bound = self.block_bound.max(axis=1) if len(words) else np.zeros(len(self.term), np.float32)
        self.block_terms = [np.array(sorted(p), np.int64) for p in postings]
        self.block_impacts = [np.array([p[t] for t in sorted(p)]).reshape(-1, BLOCK) for p in postings]

    def retrieve(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """Items of the block that the passage with these distinct terms scores at least `least` on."""
        own = self.block_terms[block]
        at = np.searchsorted(own, terms)
        at[at == len(own)] = 0
        score = self.block_impacts[block][at[own[at] == terms]].sum(0)
        return [(block * BLOCK + int(i), float(score[i])) for i in np.flatnonzero(score >= self.least)]

    def matches(self, words: list[bytes], terms: np.ndarray) -> dict[int, tuple[int, float, float, float]]:
        """item: (passages, best score, question overlap, answer overlap) of the verified ones.

        A passage's sum of block maxima bounds its score on each item of the block; only blocks where that
        reaches `least` are scored. All blocks' bounds are added up side by side, in place of postings
        cursors that skip from item to item: a passage has many terms, and an index few blocks.
        """
        found: dict[int, tuple[int, float, float, float]] = {}
        known = np.flatnonzero(terms >= 0)
        if not len(known):
            return found
        pair = np.unique(known // self.step * len(self.term) + terms[known])
        part, term = pair // len(self.term), pair % len(self.term)
        n = -(-len(words) // self.step)
        edge = np.searchsorted(part, np.arange(n + 1))
        grams_of, grams = -1, set()
        for p, block in self._candidates(term, edge):
            for item, score in self.retrieve(np.unique(term[edge[p] : edge[min(p + 2, n)]]), block):
                if grams_of != p:
                    grams_of, grams = p, _grams_of_all_sizes(words[p * self.step : (p + 2) * self.step], self.k)
                q, a = (_covered(x, grams) for x in (self.question[item], self.answer[item]))
                if q >= self.overlap and a >= self.overlap:
                    before = found.get(item, (0, 0.0, 0.0, 0.0))
                    found[item] = (before[0] + 1, max(before[1], score), max(before[2], q), max(before[3], a))
        return found

    def _candidates(self, term: np.ndarray, edge: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, block) pairs whose bound reaches `least`, for parts with these distinct terms.

        Passages whose terms' greatest impacts on any item do not add up to `least` have no pivot and
        are passed over. The others' bounds are added up for a run of parts at a time, so that
        memory does not grow with the text.
        """
        n, blocks = len(edge) - 1, self.block_bound.shape[1]
        most = np.concatenate([[0], np.cumsum(self.term_bound[term], dtype=np.float64)])
        reach = np.diff(most[edge])
        reach = reach + np.append(reach[1:], 0)
        wanted = np.flatnonzero(reach >= self.least - 1e-4)
        size = max(1, CELLS // blocks)
        at = 0
        while at < len(wanted):
            first = wanted[at]
            # passages from here on whose parts' terms fit, one at least
            end = int(np.searchsorted(edge, edge[first] + size, "right")) - 1
            stop = max(at + 1, int(np.searchsorted(wanted, max(first + 1, end - 1))))
            last = min(n, wanted[stop - 1] + 2)
            parts = np.arange(first, last)
            sums = np.zeros((len(parts) + 1, blocks), np.float32)
            full = np.flatnonzero(edge[parts + 1] > edge[parts])
            if len(full):
                sums[full] = np.add.reduceat(self.block_bound[term[edge[first] : edge[last]]], edge[parts[full]] - edge[first], axis=0)
            own = wanted[at:stop] - first
            for p, block in zip(*np.nonzero(sums[own] + sums[own + 1] >= self.least - 1e-4), strict=True):
                yield int(own[p] + first), int(block)
            at = stop


def _grams_of_all_sizes(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for n in range(1, k + 1) for i in range(len(words) - n + 1)}


def _covered(wanted: set, grams: set) -> float:
    return sum(g in grams for g in wanted) / len(wanted) if wanted else 1.0


def questions(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, question, answer) of items in one text: the last sentence or line is the answer.

    An item with one sentence only is all question. Null ids and texts are left out.
    """
    whole = F.rtrim(F.col(text))
    answer = F.regexp_extract(whole, r"(?s)[.?!\n]\s*([^.?!\n]+[.?!]?)$", 1)
    return benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item_id).cast("long").alias("item_id"),
        F.substring(whole, F.lit(1), F.length(whole) - F.length(answer)).alias("question"), answer.alias("answer"),
    ).distinct()


def indexes(items: DataFrame, *, least: float = 0.5, overlap: float = 0.8, k: int = 5, shard_words: int = 50_000) -> list[Index]:
    """One index per shard of items; a shard has about `shard_words` words, so that it can be sent to each task.

    More items make more shards, each of which reads the documents again.
    """
    bytes_of = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    own = items.select("item_id", bytes_of("question").alias("question"), bytes_of("answer").alias("answer"))
    words = own.agg(F.sum(F.length("question") + F.length("answer"))).first()[0] or 0
    shards = 1 + words // (6 * shard_words)
    made = []
    for s in range(shards):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).collect()
        made.append(Index([(r["item_id"], bytes(r["question"]), bytes(r["answer"])) for r in rows], least, overlap, k))
    return made


def _per_row(batch: pa.RecordBatch, index: Index, column: str = "_bytes") -> Iterator[tuple[int, int, list[dict]]]:
    look = index.term.get
    for start, end, texts in slices(batch, column):
        found = []
        for value in texts:
            words = _words(value)
            terms = np.array([look(w, -1) for w in words], np.int64)
            found.append(index.matches(words, terms) if len(words) else {})
        yield start, end, found


def contaminated(docs: DataFrame, made: list[Index], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_passages, score, question_overlap, answer_overlap), a row per row of docs and item found.

    Every passage of every text queries the index; items that score at least `least` of
    their own score and whose question and answer both share at least `overlap` of
    their k-word shingles with the passage are returned. Case (A-Z) and ASCII punctuation don't matter. Null and empty texts match nothing;
    a null doc_id stays null; repeated rows repeat their pairs; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_passages", pa.int64()), *((c, pa.float64()) for c in ("score", "question_overlap", "answer_overlap"))])
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_bytes"))

    def scan(sent) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [
                    (ids[start + r], index.ids[i], n, round(s, 6), q, a)
                    for start, _, found in _per_row(batch, index) for r, own in enumerate(found)
                    for i, (n, s, q, a) in sorted(own.items())
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], f.type) for c, f in enumerate(schema)], schema=schema)

        return own.mapInArrow(emit, "doc_id long, item_id long, n_passages long, score double, question_overlap double, answer_overlap double")

    out = None
    for index in made:
        one = scan(docs.sparkSession.sparkContext.broadcast(index))
        out = one if out is None else out.union(one)
    return out


def decontaminated(docs: DataFrame, made: list[Index], *, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text holds no test item (as `contaminated` finds them)."""
    names = docs.columns
    (bytes_,) = fresh(docs, "_bytes")

    def scan(df: DataFrame, sent) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start, end, found in _per_row(batch, sent.value, bytes_):
                    part = batch.slice(start, end - start).filter(pa.array([not x for x in found], pa.bool_()))
                    yield part.select(names)

        return df.withColumn(bytes_, F.col(text).cast("binary")).mapInArrow(emit, docs.schema)

    for index in made:
        docs = scan(docs, docs.sparkSession.sparkContext.broadcast(index))
    return docs
