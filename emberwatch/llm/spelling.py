"""Spelling variants: words one edit apart, by dynamic programming along a sorted vocabulary.

Two words at most one edit apart agree in the first half of the shorter or in its last half. So
the vocabulary is laid out twice, by the first half of words and, with words turned around, by the
last half; a group holds the words that some length of query can meet there. A group is a sorted
list. In it all queries walk down shared prefixes at once: a range of the list whose words share a
prefix has one banded row of the edit matrix per query, made once from the row of the prefix that
is shorter by one. Where the prefix ends follows from the longest common prefixes of neighbours.
A range whose row exceeds one edit everywhere is left with all its words. At a word's end its row
gives the distance.

Groups are dealt by key. One with more than BLOCK words is cut into blocks by hash, and each
block of queries meets each block of words, so no task holds more than two blocks of a group at
once and nothing is left out.

A form is a more frequent near word, so a chain of forms is short (each is `times` as frequent as
the one before); roots are spread down the chains by joins, one per link, whose keys have at most
as many rows as a word has near words.

A null text has no words; a null id counts as an empty text in the hash. Repeated rows count as
often as they occur. Words of any length are handled; the cost grows with the longest prefix that
two words share. An empty table gives no rows. Other columns are not looked at, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, staged

RUN = "[A-Za-zÀ-ÿ]"
BLOCK = 16_384
#: Queries that walk at once, and rows of a task's list.
_QUERIES, _ROWS = 4_096, 65_536
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, often: int = 5) -> DataFrame:
    """(word, n) of the words of at least `least` code points and `often` occurrences in all documents.

    Runs of letters, A-Z lower-cased; where 199 divides the crc32 of `<id>:<run>`, the run loses
    the code point at that hash modulo its length. Runs are counted per task before any shuffle.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{least},}}"), F.lit(0))
    found = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")
    ).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    size = F.length("run")
    at = (F.col("h") % size).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))
    words = found.withColumn("h", h).select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.length("word") >= least) & (F.col("n") >= often))


class SortedList:
    """Byte strings in order, of one group after the other, with common prefixes of neighbours."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> None:
        """Strings in order within their group; groups in order."""
        self.data, self.offsets, self.group = data, offsets[:-1], group
        self.sizes = np.diff(offsets)
        self.prefix = np.zeros(len(group), dtype=np.int64)
        same = np.flatnonzero(np.diff(group, prepend=-1) == 0)
        depth = 0
        while len(same):
            same = same[(self.sizes[same] > depth) & (self.sizes[same - 1] > depth)]
            same = same[data[self.offsets[same] + depth] == data[self.offsets[same - 1] + depth]]
            depth += 1
            self.prefix[same] = depth

    def within_one(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple:
        """(query, place) of strings exactly one edit from a query, among places first..last-1 of each query.

        Values of a band's row: distances to the query's prefix shorter by one than, as long as, and
        longer by one than the list's prefix; all above 1 count as 2.
        """
        query, lo, hi = np.arange(len(starts)), first, last
        row = np.tile(np.array([2, 0, 1], dtype=np.uint8), (len(starts), 1))
        out_q, out_w = [], []
        depth = 0
        bounds = np.append(np.flatnonzero(self.prefix <= depth), len(self.group))
        while len(query):
            # the ranges that share one more byte start wherever neighbours share no more than `depth`
            a, b = np.searchsorted(bounds, lo), np.searchsorted(bounds, hi)
            many = b - a
            item = np.repeat(np.arange(len(query)), many)
            child = np.repeat(a - np.cumsum(many) + many, many) + np.arange(len(item))
            lo, hi = bounds[child], bounds[child + 1]
            longer = self.sizes[lo] > depth
            item, lo, hi = item[longer], lo[longer], hi[longer]
            query, old = query[item], row[item]
            c, size, at = self.data[self.offsets[lo] + depth], sizes[query], starts[query] + depth

            def differs(shift: int, at=at, size=size, c=c, depth=depth) -> np.ndarray:
                inside = (depth + shift >= 0) & (depth + shift < size)
                return (data[np.where(inside, at + shift, 0)] != c) | ~inside

            before = np.minimum(old[:, 0] + differs(-1), old[:, 1] + 1)
            before = np.where(depth > size, 2, before)
            here = np.minimum(np.minimum(old[:, 1] + differs(0), old[:, 2] + 1), before + 1)
            here = np.where(depth + 1 > size, 2, here)
            after = np.minimum(old[:, 2] + differs(1), here + 1)
            after = np.where(depth + 2 > size, 2, after)
            row = np.minimum(np.stack([before, here, after], axis=1), 2).astype(np.uint8)
            depth += 1
            alive = (row < 2).any(axis=1)
            query, lo, hi, row, size = query[alive], lo[alive], hi[alive], row[alive], size[alive]
            # the band's place of the query's end, at the end of the shortest string of each range
            place = size - depth + 1
            ends = (self.sizes[lo] == depth) & (place >= 0) & (place <= 2)
            ends[ends] = row[ends, place[ends]] == 1
            out_q.append(query[ends])
            out_w.append(lo[ends])
            bounds = np.append(np.flatnonzero(self.prefix <= depth), len(self.group))
        empty = np.zeros(0, dtype=np.int64)
        return np.concatenate([empty, *out_q]), np.concatenate([empty, *out_w])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, never empty, and the offsets of its values."""
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(1, np.uint8)
    return data, offsets


_OUT = pa.schema([("turned", pa.bool_()), ("word", pa.binary()), ("n", pa.int64()), ("near", pa.binary()), ("near_n", pa.int64())])


def _pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs within each group of a sorted table of whole groups: turned, key.., rest, n, listed, asks, shared."""
    table = table.combine_chunks()
    keys = table.select(["turned", "len", "half", "i", "j"])
    change = np.zeros(len(table), dtype=bool)
    for column in keys.itercolumns():
        coded = column.combine_chunks().dictionary_encode()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        change |= np.diff(coded.indices.to_numpy(), prepend=-1) != 0
    group = np.cumsum(change) - 1
    listed = np.flatnonzero(table["listed"].to_numpy(zero_copy_only=False))
    asks = np.flatnonzero(table["asks"].to_numpy(zero_copy_only=False))
    if not (len(listed) and len(asks)):
        return
    rest = table["rest"].combine_chunks()
    rest = rest.chunk(0) if isinstance(rest, pa.ChunkedArray) else rest
    data, offsets = _bytes_of(rest.take(pa.array(listed)))
    ordered = SortedList(data, offsets, group[listed])
    asked, asked_offsets = _bytes_of(rest.take(pa.array(asks)))
    first, last = (np.searchsorted(group[listed], group[asks], side=s) for s in ("left", "right"))
    for at in range(0, len(asks), _QUERIES):
        part = slice(at, at + _QUERIES)
        q, w = ordered.within_one(asked, asked_offsets[:-1][part], np.diff(asked_offsets)[part], first[part], last[part])
        if len(q):
            mine, other = pa.array(asks[part][q]), pa.array(listed[w])
            rows = [table["turned"].take(mine), table["whole"].take(mine), table["n"].take(mine), table["whole"].take(other), table["n"].take(other)]
            yield from pa.table(rows, schema=_OUT).to_batches()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups at a time, about _ROWS rows."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    key = lambda b, at: tuple(b.column(n)[at].as_py() for n in ("turned", "len", "half", "i", "j"))
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        size += batch.num_rows
        if size < _ROWS:
            continue
        table = pa.Table.from_batches(waiting)
        last, cut = key(table, size - 1), size - 1
        step = 1
        while cut > 0 and key(table, cut - 1) == last:  # groups are bounded: look back in growing steps
            back = max(0, cut - step)
            if key(table, back) == last:
                cut, step = back, step * 2
            else:
                step = max(1, step // 2)
        if cut:
            yield from _pairs_of(table.slice(0, cut))
            waiting = table.slice(cut).to_batches()
            size -= cut
    if waiting:
        yield from _pairs_of(pa.Table.from_batches(waiting))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): each word with each word exactly one edit away. `words`: distinct word, n."""
    latin = lambda c: F.encode(c, "ISO-8859-1")  # noqa: E731  one byte a code point, in the same order
    size = F.length("word")
    sides = []
    for turned in (False, True):
        word = F.reverse("word") if turned else F.col("word")
        # queries of a length share this many code points with what they can meet on this side
        shared = lambda n, turned=turned: n - 1 - F.floor((n - 1) / 2) if turned else F.floor((n - 1) / 2)
        sides.append(
            words.select(F.lit(turned).alias("turned"), word.alias("whole"), "n", F.explode(F.array(size - 1, size, size + 1)).alias("len"))
            .withColumn("shared", shared(F.col("len")).cast("int"))
        )
    rows = sides[0].unionByName(sides[1]).select(
        "turned", "len", F.substring("whole", F.lit(1), F.col("shared")).alias("half"), "whole", "n", "shared",
    )
    key = ["turned", "len", "half"]
    large = rows.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cut = rows.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("whole"), F.col("blocks")).cast("int")
    asks = F.length("whole") == F.col("len")
    tile = lambda i, j, listed, asking: F.struct(i.alias("i"), j.alias("j"), listed.alias("listed"), asking.alias("asks"))
    yes, no = F.lit(True), F.lit(False)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # the words of block i meet the queries of block j
    as_words = F.transform(every, lambda j: tile(F.col("mine"), j, yes, (j == F.col("mine")) & F.col("asking")))
    as_queries = F.transform(F.filter(every, lambda i: F.col("asking") & (i != F.col("mine"))), lambda i: tile(i, F.col("mine"), no, yes))
    tiled = (
        cut.withColumns({"mine": mine, "asking": asks})
        .select(*key, "whole", "n", "shared", F.explode(F.concat(as_words, as_queries)).alias("t"))
        .select(
            "turned", "len", latin(F.col("half")).alias("half"), "t.i", "t.j", "t.listed", "t.asks",
            latin(F.col("whole")).alias("whole"), latin(F.expr("substring(whole, shared + 1)")).alias("rest"), "n",
        )
    )
    grid = ["turned", "len", "half", "i", "j"]
    found = (
        tiled.repartition(*grid).sortWithinPartitions(*grid, "rest")
        .mapInArrow(_scan, "turned boolean, word binary, n long, near binary, near_n long")
    )
    text = lambda c: F.when(F.col("turned"), F.reverse(F.decode(c, "ISO-8859-1"))).otherwise(F.decode(c, "ISO-8859-1"))
    both = found.select(text(F.col("word")).alias("word"), "n", text(F.col("near")).alias("near"), "near_n")
    return both.repartition("word").dropDuplicates(["word", "near"])  # which also suits a grouping by word


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last word, which has none."""
    links = staged(forms.select("word", "form"), "forms")
    ends = links.select(F.col("form").alias("word")).distinct().join(links, "word", "left_anti")
    edge = staged(ends.select("word", F.col("word").alias("root")), "roots")
    out = None
    while True:
        edge = staged(
            links.join(edge.select(F.col("word").alias("form"), "root"), "form").select("word", "root"), "roots"
        )
        out = edge if out is None else out.unionByName(edge)
        if edge.isEmpty():
            return out


def variants(words: DataFrame, times: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of rows (word, n): a form is the near word of largest n, if `times` the word's."""
    shared_folder(words.sparkSession)
    words = staged(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_pairs(words, block).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form: Column = -F.col("best.less") >= times * F.col("n")
    near = staged(
        near.select(
            "word", "n_near", F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
        ),
        "near-words",
    )
    ends = roots(near.where("form IS NOT NULL"))
    return (
        words.join(near, "word", "left").join(ends, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
        )
    )
