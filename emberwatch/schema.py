"""Event and alert schemas, closed value sets and the severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
SOURCES = ("ssh", "web", "windows", "firewall")
STATUSES = ("success", "failure", "blocked", "allowed", "error", "info")
SEVERITIES = ("critical", "high", "medium", "low", "info")

EVENT_FIELDS = [
    T.StructField("ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("raw", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("user", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("event_id", T.IntegerType()),
    T.StructField("process", T.StringType()),
    T.StructField("msg", T.StringType()),
]
LINEAGE_FIELDS = [
    T.StructField("feed", T.StringType()),
    T.StructField("feed_order", T.IntegerType()),
    T.StructField("line_no", T.LongType()),
]
EVENT_SCHEMA = T.StructType(EVENT_FIELDS + LINEAGE_FIELDS)
EVENT_COLUMNS = [f.name for f in EVENT_FIELDS]
LINEAGE_COLUMNS = [f.name for f in LINEAGE_FIELDS]


def event_struct(**values: Column) -> Column:
    """An event struct from the given columns; fields left out are NULL."""
    unknown = set(values) - set(EVENT_COLUMNS)
    if unknown:
        raise ValueError(f"not event fields: {sorted(unknown)}")
    return F.struct(
        *(
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENT_FIELDS
        )
    )


def severity_rank(severity: Column) -> Column:
    """Position in the severity order, most severe first; NULL when unknown."""
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, F.lit(i)).otherwise(rank)
    return rank


def position(feed_order: Column, line_no: Column) -> Column:
    """One BIGINT that orders events of equal time by feed, then by line.

    Leaves 40 bits for the line number (a trillion lines per feed).
    """
    return F.shiftleft(
        F.coalesce(feed_order, F.lit(0)).cast("bigint"), 40
    ) + F.coalesce(line_no, F.lit(0))
