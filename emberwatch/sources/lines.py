"""Raw line tables: (feed, feed_order, line_no, line [, parser])."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.functions import text as X
from emberwatch.operators.staging import staged


def read_lines(
    spark: SparkSession, path: str | Sequence[str], feed: str, feed_order: int = 0
) -> DataFrame:
    """Text files as numbered lines, blank ones dropped but counted.

    Files stay splittable: each split's rows are numbered by their place in the split,
    and the line counts of earlier files (by path) and splits are added from a table with
    one row per split, so numbers are unique over all files of the feed. Spark broadcasts
    that table as long as its size allows. Bytes that are not UTF-8 decode to U+FFFD.
    """
    rows = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.regexp_replace(X.valid_utf8(F.col("value")), r"\r\z", "").alias("line"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    splits = rows.groupBy("_file", "_start").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counted = staged(
        splits.select(
            "_file",
            "_start",
            "_first",
            "_n",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_in_file"),
        )
    )
    files = counted.groupBy("_file").agg(F.sum("_n").alias("_n")).select(
        "_file",
        F.coalesce(
            # one row per file
            F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_files"),
    )
    offsets = counted.join(files, "_file").withColumn(
        "_earlier", F.col("_in_file") + F.col("_files")
    )
    place = F.col("_row") - F.col("_first")
    changed = F.raise_error(
        F.lit(
            "file splits changed between counting and reading lines; "
            "set spark.sql.files.minPartitionNum to pin them"
        )
    ).cast("bigint")
    return (
        rows.join(offsets, ["_file", "_start"], "left")
        .filter(~X.blank(F.col("line")))
        .select(
            F.lit(feed).alias("feed"),
            F.lit(feed_order).alias("feed_order"),
            F.when(
                (place >= 0) & (place < F.col("_n")), place + F.col("_earlier") + 1
            ).otherwise(changed).alias("line_no"),
            "line",
        )
    )


def lines_of_text(
    texts: DataFrame, text: str = "text", feed: str = "feed", feed_order: str | None = None
) -> DataFrame:
    """Line table from a table of whole texts (one row per feed or file)."""
    order = F.col(feed_order) if feed_order else F.lit(0)
    return (
        texts.select(
            F.col(feed).alias("feed"),
            order.cast("int").alias("feed_order"),
            F.posexplode(F.split(text, r"\r?\n")).alias("_at", "line"),
        )
        .filter(~X.blank(F.col("line")))
        .select(
            "feed", "feed_order", (F.col("_at") + 1).cast("bigint").alias("line_no"), "line"
        )
    )


def json_array_lines(texts: DataFrame, text: str = "text", feed: str = "feed") -> DataFrame:
    """One line per element of JSON-array texts, one array a row; an unparsable text gives one line.

    For arrays that fit in a row; `arrays.read_json_array` reads files of any size in splits.
    """
    trimmed = X.trim(F.col(text))
    return (
        texts.filter(trimmed.startswith("["))
        .select(
            F.col(feed).alias("feed"),
            trimmed.alias("_whole"),
            F.from_json(trimmed, "array<string>", {"allowSingleQuotes": "false"}).alias(
                "_items"
            ),
        )
        .select(
            "feed",
            F.posexplode(
                F.coalesce("_items", F.array("_whole"))
            ).alias("_at", "line"),
        )
        .select(
            "feed",
            F.lit(0).alias("feed_order"),
            (F.col("_at") + 1).cast("bigint").alias("line_no"),
            "line",
        )
    )


def union_feeds(feeds: Mapping[str, DataFrame], enabled: Sequence[str] | None = None) -> DataFrame:
    """Rows of the enabled feeds in one table, with the feed's name and order."""
    if enabled is not None:
        unknown = set(enabled) - set(feeds)
        if unknown:
            raise ValueError(f"no such feed: {sorted(unknown)}")
    out: DataFrame | None = None
    for order, (name, rows) in enumerate(feeds.items()):
        if enabled is not None and name not in enabled:
            continue
        part = rows.withColumns({"feed": F.lit(name), "feed_order": F.lit(order)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no feed is enabled")
    return out


def only_feeds(rows: DataFrame, enabled: Sequence[str]) -> DataFrame:
    """Rows of the enabled feeds of a table that carries the feed's name."""
    return rows.filter(F.col("feed").isin(list(enabled)))


# What each format's lines look like.
FORMAT_TESTS = {
    "ssh": [r"sshd\[\d+\]|sudo:"],
    "web": [
        rf'"{X.S}*(GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH){X.S}+{X.NS}+',
        r"\[\d{2}/\w{3}/\d{4}",
    ],
    "windows": [rf"^{X.S}*[\[{{]", r"(?i)event_?id"],
    "firewall": [rf"kernel:{X.ANY}*SRC=|%ASA-\d-\d{{6}}"],
}
SNIFF_LINES = 40


def _looks_like(line: Column, name: str) -> Column:
    hit = F.lit(True)
    for pattern in FORMAT_TESTS[name]:
        hit = hit & line.rlike(pattern)
    return hit


def sniff_feeds(spark: SparkSession, feeds: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """Best-matching parser per feed, a folder or list of files, from the head of its files.

    Files are taken in order of their names, and only as long as a feed still lacks lines. Of a file,
    Spark reads the first split, stops at the last line that is needed, and goes on to further splits
    only for want of lines. At most 40 lines a feed come together.
    """
    rows = []
    for feed, path in feeds.items():
        found: list[str] = []
        for file in sorted(spark.read.text(path).inputFiles()):
            line = F.regexp_replace(X.valid_utf8(F.col("value")), r"\r\z", "").alias("line")
            head = spark.read.option("lineSep", "\n").text(file).select(line).filter(~X.blank(F.col("line")))
            found += [r.line for r in head.limit(SNIFF_LINES - len(found)).collect()]
            if len(found) >= SNIFF_LINES:
                break
        rows += [(feed, i + 1, line) for i, line in enumerate(found)]
    return classify_feeds(spark.createDataFrame(rows, "feed string, line_no bigint, line string"))


def classify_feeds(lines: DataFrame) -> DataFrame:
    """Best-matching parser per feed from its first 40 non-blank lines, for feeds that are in a table.

    Two points per matching line; ties go to the earlier format; no match gives NULL.
    """
    first = Window.partitionBy("feed").orderBy("line_no")
    sample = (
        lines.filter(~X.blank(F.col("line")))
        .select("feed", "line_no", "line")
        .withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= SNIFF_LINES)
    )
    scores = sample.groupBy("feed").agg(
        *(
            F.sum(F.when(_looks_like(F.col("line"), name), 2).otherwise(0)).alias(name)
            for name in FORMAT_TESTS
        )
    )
    best = F.greatest(*FORMAT_TESTS)
    parser = F.lit(None).cast("string")
    for name in reversed(list(FORMAT_TESTS)):
        parser = F.when((best > 0) & (F.col(name) == best), F.lit(name)).otherwise(parser)
    return scores.select("feed", *FORMAT_TESTS, parser.alias("parser"))
