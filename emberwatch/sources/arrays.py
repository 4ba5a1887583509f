"""JSON arrays read in splits, by as many tasks as the file has.

A file is read as the pieces between its commas, which Spark can start at any offset. Whether a
comma ends an element depends on all text before it: on being inside a string and on the number of
open brackets. So each split is scanned once for either entry, inside a string or not; its outcome
is a few numbers. These are put together over the splits, one after the other, and then every split
knows its entry and cuts its elements. Only elements that lie across splits are put together again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.functions import text as X
from emberwatch.operators import blocks
from emberwatch.operators.staging import staged, staged_bytes
from emberwatch.packaging import ship

_QUOTE, _BACKSLASH = 34, 92
#: Tables of splits up to this size are sent to the tasks.
MOST_SENT = 64 << 20
_SHOWN = 200  # characters shown of a file that is no array. Fixed value.


def _pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return (
        spark.read.option("lineSep", ",").text(path)
        .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    )


def _marks() -> np.ndarray:
    marks = np.zeros(256, np.int8)
    for chars, mark in ((b"[{", 1), (b"]}", -1), (b'"', 2)):
        marks[list(chars)] = mark
    return marks


def _scan(text: np.ndarray, sizes: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
    """At the end of each piece: whether it is inside a string, and how many more brackets are open than before.

    `text` is the pieces' bytes side by side; `state` is 1 if the first begins inside a string.
    """
    ends = np.cumsum(sizes)
    marks = _marks().take(text)
    at = np.flatnonzero(marks)  # quotes and brackets; all else changes nothing
    mark = marks[at]
    quote = mark == 2
    if len(slash := np.flatnonzero(text == _BACKSLASH)):
        # a run of backslashes ends where the next byte is another one, and does not reach over a comma
        begins = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
        run = np.searchsorted(slash[begins], at, "left") - 1
        last = np.append(slash[begins[1:] - 1], slash[-1])
        before = (run >= 0) & (last[run] == at - 1)
        piece = np.searchsorted(ends, at, "right")
        first = np.maximum(slash[begins][run], (ends - sizes)[piece])
        quote &= ~(before & ((at - first) % 2 == 1))
    inside = (np.cumsum(quote) + state) % 2 == 1
    level = np.where(inside | (mark == 2), 0, mark)
    upto = np.searchsorted(at, ends, "left")
    quotes = np.concatenate([[state == 1], inside])
    return quotes[upto], np.concatenate([[0], np.cumsum(level, dtype=np.int64)])[upto]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows of each split in a batch."""
    n = batch.num_rows
    fresh = np.zeros(n, dtype=bool)
    fresh[:1] = True
    for c in ("_file", "_start"):
        fresh[1:] |= np.diff(batch.column(c).dictionary_encode().indices.to_numpy()) != 0
    edges = [*np.flatnonzero(fresh).tolist(), n]
    for a, b in zip(edges, edges[1:], strict=False):
        yield (batch.column("_file")[a].as_py(), batch.column("_start")[a].as_py()), batch.slice(a, b - a)


def _bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The pieces' bytes side by side, and how many each has."""
    values = batch.column("value").cast(pa.large_binary())
    _, offsets, text = values.buffers()
    ends = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(text or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


_OUTCOME = "_file string, _start bigint, entry int, parity int, opens boolean, opened bigint, depth bigint, ends bigint"


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split and entry (0 outside, 1 inside a string): what the split does to both, and piece ends outside strings by depth."""
    split, states, opened, ends, opens = None, [0, 1], [0, 0], [{}, {}], True
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _OUTCOME.split(", ")]

    def told() -> pa.RecordBatch:
        rows = [(*split, e, states[0], opens, opened[e], d, n) for e in (0, 1) for d, n in (ends[e] or {0: 0}).items()]
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for own, rows in _runs(batch):
            if own != split:
                if split is not None:
                    yield told()
                split, states, opened, ends = own, [0, 1], [0, 0], [{}, {}]
                opens = own[1] > 0 or rows.column("value")[0].as_py().lstrip().startswith("[")
            text, sizes = _bytes(rows)
            for e in (0, 1):
                inside, outer = _scan(text, sizes, states[e])
                for d, n in zip(*np.unique(opened[e] + outer[~inside], return_counts=True), strict=True):
                    ends[e][int(d)] = ends[e].get(int(d), 0) + int(n)
                states[e], opened[e] = int(inside[-1]), opened[e] + int(outer[-1])
    if split is not None:
        yield told()


def _entries(outcomes: DataFrame) -> DataFrame:
    """Per split: whether it is entered inside a string, how deep, after how many elements, and whether the file is no array."""
    split, file = ["_file", "_start"], Window.partitionBy("_file")
    before = file.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    outcomes = staged(outcomes)
    inside = outcomes.groupBy(*split).agg(F.max("parity").alias("parity")).select(*split, (so_far("parity") % 2).cast("int").alias("state"))
    real = outcomes.join(inside, split).where(F.col("entry") == F.col("state"))
    per_split = real.groupBy(*split, "state").agg(
        F.max("parity").alias("parity"), F.min("opens").alias("opens"), F.max("opened").alias("opened"),
        F.collect_list(F.struct("depth", "ends")).alias("by_depth"),  # as many as brackets are nested
    )
    deep = per_split.withColumn("level", so_far("opened"))
    at_one = F.aggregate(
        F.filter("by_depth", lambda x: x["depth"] + F.col("level") == 1), F.lit(0).cast("bigint"), lambda n, x: n + x["ends"]
    )
    numbered = deep.withColumn("ended", at_one).withColumn("element", so_far("ended"))
    closed = (F.sum("opened").over(file) == 0) & (F.sum("parity").over(file) % 2 == 0) & F.min("opens").over(file)
    return numbered.select(*split, "state", "level", "element", (~closed).alias("broken"))


_CUT = "_file string, element bigint, part bigint, whole boolean, broken boolean, text string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of each split; those that begin before it or go on beyond it are parts. Of files that are no array, the first text."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    names = [c.split()[0] for c in _CUT.split(", ")]
    split, state, depth, element, waiting, whole, broken = None, 0, 0, 0, [], True, False

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def rest() -> list[tuple]:
        if split is None or not waiting:
            return []
        text = ",".join(waiting)
        if broken:
            return [(split[0], 0, 0, True, True, text[:_SHOWN])] if split[1] == 0 else []
        if depth == 0:  # the array's end
            text = text.rstrip()[:-1]
        return [(split[0], element, split[1], False, False, text)]

    for batch in batches:
        out: list[tuple] = []
        for own, rows in _runs(batch):
            values = rows.column("value").to_pylist()
            if own != split:
                out += rest()
                split, waiting = own, []
                state, depth, element, broken = (rows.column(c)[0].as_py() for c in ("state", "level", "element", "broken"))
                whole = own[1] == 0  # else the first element may have begun in the split before
                if whole and not broken:
                    values[0] = values[0].lstrip()[1:]
            if broken:
                if sum(map(len, waiting)) < _SHOWN:
                    waiting += values[:_SHOWN]
                continue
            text, sizes = _bytes(rows)
            inside, outer = _scan(text, sizes, state)
            begun = 0
            for ended in (np.flatnonzero(~inside & (depth + outer == 1)) + 1).tolist():
                out.append((own[0], element, own[1], whole, False, ",".join(waiting + values[begun:ended])))
                element, waiting, whole, begun = element + 1, [], True, ended
            waiting += values[begun:]
            state, depth = int(inside[-1]), depth + int(outer[-1])
        yield table(out)
    yield table(rest())


def read_json_array(
    spark: SparkSession, path: str | Sequence[str], feed: str | None = None, feed_order: int = 0
) -> DataFrame:
    """Files that each hold one JSON array, as one line per element; element numbers start at 1 in each file.

    Files are read in splits. One that is no array, or leaves strings or brackets open, gives one line
    with its first characters; other elements are judged one by one, like lines. `feed` is the file's
    path unless given.
    """
    ship(spark)
    pieces = _pieces(spark, path)
    entries = staged(_entries(pieces.mapInArrow(_outcomes, _OUTCOME)))
    # one row per split, 800,000 at 100 TB: sent to the tasks, which keeps pieces in order; else they are sorted again
    if staged_bytes(entries) <= MOST_SENT:
        entered = pieces.join(F.broadcast(entries), ["_file", "_start"])
    else:
        numbered = pieces.withColumn("_row", F.monotonically_increasing_id())
        entered = blocks.grouped(numbered.join(entries, ["_file", "_start"]), ["_file", "_start"], ["_row"]).drop("_row")
    cut = staged(entered.mapInArrow(_cut, _CUT))
    parts = F.sort_array(F.collect_list(F.struct("part", "text")))  # as many as splits that the element lies across
    across = cut.where("NOT whole").groupBy("_file", "element", "broken").agg(
        F.array_join(F.transform(parts, lambda x: x["text"]), ",").alias("text")
    )
    every = cut.where("whole").select("_file", "element", "broken", "text").unionByName(across)
    name = F.lit(feed) if feed is not None else F.col("_file")
    return every.where(~X.blank(F.col("text"))).select(
        name.alias("feed"), F.lit(feed_order).alias("feed_order"), (F.col("element") + 1).alias("line_no"),
        F.when(F.col("broken"), F.col("text")).otherwise(X.trim(F.col("text"))).alias("line"),
    )
