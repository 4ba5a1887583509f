"""Repeated passages: content-defined chunks by a gear rolling hash, deduplicated by digests of stretches of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, mixed, shared_folder, slices

#: Bytes that a boundary depends on.
REACH = 16
#: Odd base of the sums of chunk digests, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: One number per byte value; 0 for the byte that parts texts.
GEAR = (mixed(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0, 9, 10, 11, 12, 13, 32]] = True


class Chunks:
    """The chunks of some texts: runs of whole words that end where the rolling hash is small.

    A cut after a byte depends on the REACH bytes up to it only, and moves to the next start of a word. So equal
    passages have equal chunks, but for those at their ends, whatever stands before them.
    Chunks have `mean` bytes on average and `most` words at most.
    """

    def __init__(self, texts: list[bytes | None], mean: int, most: int) -> None:
        gap = bytes(REACH)
        self.buffer = gap.join([b"", *(t or b"" for t in texts), b""])
        lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
        self.begin = np.cumsum(lengths + REACH) - lengths
        self.end = self.begin + lengths
        data = np.frombuffer(self.buffer, np.uint8)
        gear = GEAR[data]
        for shift in (1, 2, 4, 8):  # sums of 2, 4, 8, 16 bytes, each shifted by its distance
            gear[shift:] += gear[:-shift] << np.uint32(shift)
        cuts = np.flatnonzero(gear * np.uint32(0x9E3779B1) < np.uint32((1 << 32) // mean))
        space = SPACE[data]
        starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
        self.word_start = starts
        self.word_end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        first_word = np.searchsorted(starts, self.begin)
        self.first_word = np.append(first_word, len(starts))
        own = np.unique(np.concatenate([np.searchsorted(starts, cuts + 1), first_word]))
        own = own[own < len(starts)]
        wide = np.flatnonzero(np.diff(np.append(own, len(starts))) > most)
        if len(wide):
            ends = np.append(own, len(starts))
            own = np.unique(np.concatenate([own, *(np.arange(ends[i], ends[i + 1], most) for i in wide)]))
        self.chunk_word = np.append(own, len(starts))
        #: Of each text, the number of its first chunk; one more at the end.
        self.first_chunk = np.searchsorted(own, self.first_word)

    def digests(self) -> np.ndarray:
        first, last = self.chunk_word[:-1], self.chunk_word[1:] - 1
        whole, digest = self.buffer, xxhash.xxh3_64_intdigest
        spans = zip(self.word_start[first].tolist(), self.word_end[last].tolist(), strict=True)
        return np.fromiter((digest(whole[a:b]) for a, b in spans), np.uint64, len(first)).view(np.int64)


    def stretches(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First chunk, chunk after the last, and digest of each stretch, by place; of each text, the number of its first, one more at the end.

        From each chunk on, and back from each, the fewest chunks of one text with `least` words make a stretch.
        So each chunk of a passage with that many words in whole chunks is in a stretch of the passage.
        """
        words, n = self.chunk_word, len(self.chunk_word) - 1
        text = np.repeat(np.arange(len(self.begin)), np.diff(self.first_chunk))
        first = np.arange(n)
        after = np.searchsorted(words, words[:-1] + least)
        before = np.searchsorted(words, words[1:] - least, "right") - 1
        forth, back = after <= self.first_chunk[text + 1], before >= self.first_chunk[text]
        pairs = np.unique(np.concatenate([first[forth] * (n + 1) + after[forth], before[back] * (n + 1) + first[back] + 1]))
        start, stop = np.divmod(pairs, n + 1)
        powers, inverses = (np.full(n + 1, x, np.uint64) for x in (BASE, INVERSE))
        powers[0] = inverses[0] = 1
        powers, inverses = np.cumprod(powers), np.cumprod(inverses)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.digests().view(np.uint64) * powers[:n], dtype=np.uint64)])
        digest = mixed((sums[stop] - sums[start]) * inverses[start] + (stop - start).astype(np.uint64))
        return start, stop, digest.view(np.int64), np.searchsorted(start, self.first_chunk)


def _first_in_text(digests: np.ndarray) -> np.ndarray:
    """Whether each digest is the first of its kind."""
    first = np.zeros(len(digests), dtype=bool)
    first[np.unique(digests, return_index=True)[1]] = True
    return first


def _occurrences(docs: DataFrame, mean: int, most: int, least: int) -> DataFrame:
    """(digest, id, row): each distinct stretch of each text."""
    schema = pa.schema([("digest", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in slices(batch, "_bytes"):
                _, _, digests, edge = Chunks(texts, mean, most).stretches(least)
                own = [np.unique(digests[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                many = [len(x) for x in own]
                ids, rows = (np.repeat(batch.column(c).slice(start, end - start).to_numpy(), many) for c in ("_id", "_row"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(ids), pa.array(rows)], schema=schema)

    return docs.select("_id", "_row", "_bytes").mapInArrow(emit, "digest long, id long, row long")


def _cut(made: Chunks, row: int, repeated: np.ndarray, least: int) -> tuple[list[tuple[int, int]], int]:
    """Byte spans of the runs of repeated chunks, which have at least so many words, and their words."""
    a = made.first_chunk[row]
    words = made.chunk_word[a : made.first_chunk[row + 1] + 1]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]])))
    spans, gone = [], 0
    for s, e in zip(edge[::2], edge[1::2], strict=True):
        n = int(words[e] - words[s])
        if n >= least:
            gone += n
            stop = made.word_start[words[e]] if words[e] < made.first_word[row + 1] else made.end[row]
            spans.append((int(made.word_start[words[s]] - made.begin[row]), int(stop - made.begin[row])))
    return spans, gone


def without_repeats(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mean: int = 24, most: int = 32, least: int = 20,
) -> DataFrame:
    """docs' columns, text without repeated passages, and n_words, n_chunks, removed_words, spans.

    Stretches are the shortest runs of chunks with at least `least` words. Of each stretch, the occurrence in the
    text with the smallest id counts as the original (there, the first place); all others are repeats and are cut
    out. So whatever is cut stands in one piece of `least` words or more in an earlier place, and shorter repeats stay, as common phrases
    and lines do, even if one follows the other. Passages lose up to a chunk or
    two at their ends, so with `least` 20 passages of 50 words are found. spans are the cut
    (start, end) in bytes of the UTF-8 text.

    A null text stays null with zeros and no spans; a text may become empty. Rows with the same id do
    not repeat each other; null ids come last, ordered by a hash of the text, and are the same id if their texts
    are equal. Digests that a row repeats come to that row only, however many rows share its id. The columns
    n_words, n_chunks, removed_words, spans of docs itself, if any, are replaced.
    """
    shared_folder(docs.sparkSession)
    new = ["n_words", "n_chunks", "removed_words", "spans"]
    names = [c for c in docs.columns if c not in new]
    # behind all ids; a place of its own for each text
    last = F.xxhash64(text).bitwiseAND(F.lit((1 << 60) - 1)) + F.lit(7 << 60)
    key, row_, bytes_, repeats_ = fresh(docs, "_id", "_row", "_bytes", "_repeats")
    place = F.coalesce(F.col(doc_id).cast("long"), last)
    # rows that share an id are told apart by their texts; where none do, the id will do
    shared = not docs.groupBy(place.alias("id")).count().where("count > 1").isEmpty()
    row = F.coalesce(F.xxhash64(text), F.lit(0)) if shared else F.lit(0).cast("long")
    own = docs.select(*names, place.alias(key), row.alias(row_))
    bare = own.select(F.col(key).alias("_id"), F.col(row_).alias("_row"), F.col(text).cast("binary").alias("_bytes"))
    found = _occurrences(bare, mean, most, least)
    firsts = found.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("other")).where("first < other")
    firsts = firsts.select("digest", "first").checkpoint()
    repeats = found.join(firsts, "digest").where("id > first").groupBy("id", "row").agg(
        F.collect_set("digest").alias(repeats_)
    ).withColumnsRenamed({"id": key, "row": row_}).checkpoint()
    schema = T.StructType([
        *own.select(*names).schema.fields,
        *(T.StructField(n, T.LongType()) for n in new[:3]),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, texts in slices(batch, bytes_):
                made = Chunks(texts, mean, most)
                starts, stops, digests, edge = made.stretches(least)
                marks = batch.column(repeats_).slice(start, end - start).to_pylist()
                out, info = [], []
                for row, value in enumerate(texts):
                    a, b = made.first_chunk[row], made.first_chunk[row + 1]
                    local = digests[edge[row] : edge[row + 1]]
                    again = ~_first_in_text(local)
                    again |= np.isin(local, np.array(marks[row] or [], dtype=np.int64))
                    turns = np.zeros(b - a + 1, dtype=np.int64)
                    np.add.at(turns, starts[edge[row] : edge[row + 1]][again] - a, 1)
                    np.add.at(turns, stops[edge[row] : edge[row + 1]][again] - a, -1)
                    repeated = np.cumsum(turns)[:-1] > 0
                    spans, gone = _cut(made, row, repeated, least)
                    if spans:
                        edges = [0, *(x for s in spans for x in s), len(value)]
                        value = b"".join(value[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                    out.append(None if value is None else value.decode("utf-8", "replace"))
                    info.append((int(made.first_word[row + 1] - made.first_word[row]), int(b - a), gone, [{"start": s, "end": e} for s, e in spans]))
                columns = [
                    pa.array(out, pa.string()) if n == text else batch.column(n).slice(start, end - start) for n in names
                ]
                kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                columns += [pa.array(v, k) for v, k in zip(zip(*info, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    joined = own.join(repeats, [key, row_], "left").select(*names, F.col(text).cast("binary").alias(bytes_), repeats_)
    return joined.mapInArrow(emit, schema)
