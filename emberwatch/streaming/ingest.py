"""Streams of raw lines and events, through the same normalisers as batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions import text as X
from emberwatch.packaging import ship
from emberwatch.sources import normalize as N

#: Bits of a position for the place in a file (64 GB) and for the file; feeds get the six above.
PLACE_BITS, FILE_BITS = 36, 21


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with the number of each row in its split (_row, from 0) in place of the split's columns."""
    split, seen = None, 0
    for batch in batches:
        file, start = (batch.column(c).dictionary_encode() for c in ("_file", "_start"))
        n = batch.num_rows
        fresh = np.zeros(n, dtype=bool)
        for coded in (file, start):
            fresh[1:] |= np.diff(coded.indices.to_numpy()) != 0
        if n:
            fresh[0] = (batch.column("_file")[0].as_py(), batch.column("_start")[0].as_py()) != split
            split = batch.column("_file")[n - 1].as_py(), batch.column("_start")[n - 1].as_py()
        since = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        row = np.where(np.cumsum(fresh) > 0, since, since + seen)
        seen = int(row[-1]) + 1 if n else seen
        yield batch.append_column("_row", pa.array(row, pa.int64()))


def _positioned(rows: DataFrame, feed_order: int) -> DataFrame:
    """Rows of a file source with `tie`, a BIGINT that orders them by feed, file, and place in the file.

    The place is the offset of the split plus the row's number in it, which never passes the split's
    bytes. Files of a feed come in an order that their names fix. So equal times have one order,
    whatever the micro-batch, task or shuffle that a line goes through. At most 64 feeds.
    """
    if not 0 <= feed_order < 64:
        raise ValueError("feed_order must be below 64")
    ship(rows.sparkSession)
    names = [c for c in rows.columns if c != "_metadata"]
    split = rows.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in split.schema.fields)
    numbered = split.mapInArrow(_numbered, f"{kinds}, _row bigint")
    place = (F.col("_start") + F.col("_row")).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    file = F.pmod(F.xxhash64("_file"), F.lit(1 << FILE_BITS))
    tie = F.lit(feed_order << (PLACE_BITS + FILE_BITS)) + F.shiftleft(file, PLACE_BITS) + place
    return numbered.select(*names, tie.alias("tie"))


def stream_lines(
    spark: SparkSession, path: str, feed: str, feed_order: int = 0, **options: str
) -> DataFrame:
    """New text files of a folder as lines, with `tie`, the line's position, which orders equal times.

    `options` are those of Spark's file source, such as maxFilesPerTrigger.
    """
    rows = spark.readStream.options(**options).option("lineSep", "\n").text(path).select("value", "_metadata")
    line = F.regexp_replace(X.valid_utf8(F.col("value")), r"\r\z", "")
    return _positioned(rows.withColumn("line", line).select("line", "_metadata"), feed_order).select(
        F.lit(feed).alias("feed"), F.lit(feed_order).alias("feed_order"), "tie", "line"
    )


def stream_steps(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """New JSON-lines files of (phase, parser, line) rows, each line with its parser and position."""
    rows = spark.readStream.options(**options).schema("phase string, parser string, line string").json(path)
    return _positioned(rows.select("phase", "parser", "line", "_metadata"), 0)


def stream_events(lines: DataFrame, year: int, parser: str | None = None) -> DataFrame:
    """Events of a line stream, through one parser or the one each line names."""
    parsed = N.parse(lines, parser, year) if parser else N.parse_routed(lines, year)
    return N.events(parsed)


def without_repeats(
    events: DataFrame, delay: str, on: tuple[str, ...] = ("ts", "raw")
) -> DataFrame:
    """Events delivered again within the watermark delay are dropped; so are rows later than that."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(on))
