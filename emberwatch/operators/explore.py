"""Investigation reports over events and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import schema
from emberwatch.functions import times
from emberwatch.functions.share import share
from emberwatch.operators import geo as G
from emberwatch.operators.staging import staged

MINUTE = 60_000_000
SHOWN_EVENTS = 200
SHOWN_TALKERS = 8


def time_order(rows: DataFrame) -> list[Column]:
    """Sort key of events: time, then `tie` or feed and line."""
    ties = ["tie"] if "tie" in rows.columns else ["feed_order", "line_no"]
    return [F.col("ts"), *(F.col(c) for c in ties if c in rows.columns)]


def by_time(events: DataFrame) -> DataFrame:
    """Events in time order, ties in feed and line order."""
    return events.orderBy(*time_order(events))


def newest(events: DataFrame, n: int = SHOWN_EVENTS) -> DataFrame:
    """The newest events, newest first."""
    return events.orderBy(*(c.desc() for c in time_order(events))).limit(n)


def time_range(events: DataFrame) -> DataFrame:
    """First and last time, and how many events."""
    return events.agg(
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.count(F.lit(1)).alias("events"),
    )


def time_buckets(
    events: DataFrame, n: int = 60, sources: Sequence[str] = schema.SOURCES
) -> DataFrame:
    """Event counts per source in n equal buckets over the data's own time range.

    Empty buckets are there with zeros; the last one holds its end; a single instant
    spans one minute; no events give no rows. One pass finds the range (a scalar
    subquery), one counts; only n rows are joined.
    """
    t = times.micros(F.col("ts"))
    ends = events.agg(
        F.struct(
            F.min(t).alias("lo"),
            F.when(F.max(t) == F.min(t), F.min(t) + MINUTE).otherwise(F.max(t)).alias("hi"),
        ).alias("r")
    ).scalar()
    width = (ends["hi"] - ends["lo"]) / n
    at = F.least(F.lit(n - 1), F.floor((t - ends["lo"]) / width)).cast("int")
    counts = (
        events.select(at.alias("bucket"), "source")
        .groupBy("bucket")
        .agg(
            *(F.count_if(F.col("source") == s).alias(s) for s in sources),
            F.count(F.lit(1)).alias("total"),
        )
    )
    every = events.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return (
        every.join(counts, "bucket", "left")
        .select(
            "bucket",
            F.timestamp_micros((ends["lo"] + F.col("bucket") * width).cast("bigint")).alias("t0"),
            F.timestamp_micros(
                (ends["lo"] + (F.col("bucket") + 1) * width).cast("bigint")
            ).alias("t1"),
            *(F.coalesce(c, F.lit(0)).alias(c) for c in (*sources, "total")),
        )
        .filter(F.col("t0").isNotNull())
    )


def top_talkers(
    events: DataFrame, geo: DataFrame | None = None, n: int = SHOWN_TALKERS
) -> DataFrame:
    """The most frequent source addresses with their place.

    Ties go to the address seen first, then to the smaller text.
    """
    place = G.shipped_geo(events.sparkSession) if geo is None else geo
    top = (
        events.filter(F.coalesce(F.col("src_ip") != "", F.lit(False)))
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_seen"))
        .orderBy(F.desc("events"), "first_seen", "src_ip")
        .limit(n)
    )
    label = G.place_label(F.col("city"), F.col("cc"), F.col("org")).alias("place")
    return G.with_place(top, place, "src_ip").select("src_ip", "events", "first_seen", label)


def distinct_addresses(events: DataFrame) -> DataFrame:
    """How many different source addresses there are."""
    return events.agg(
        F.count_distinct(F.nullif(F.col("src_ip"), F.lit(""))).alias("addresses")
    )


def address_sketches(events: DataFrame, precision: int = 12) -> DataFrame:
    """(day, source, sketch): source addresses as sketches that can be stored and merged.

    A sketch has 2^precision small registers, whatever it counts; its relative error is about
    0.83 / sqrt(2^precision), 1.3 % by default.
    """
    address = F.nullif(F.col("src_ip"), F.lit(""))
    return events.groupBy(F.to_date("ts").alias("day"), "source").agg(
        F.hll_sketch_agg(address, F.lit(precision)).alias("sketch")
    )


def estimated_addresses(sketches: DataFrame, *per: str) -> DataFrame:
    """About how many different addresses stored sketches saw, in all or per some of their columns."""
    return sketches.groupBy(*per).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("addresses")
    )


def events_per(events: DataFrame, column: str = "source") -> DataFrame:
    """Event counts per source, or per any other column."""
    return events.groupBy(column).agg(F.count(F.lit(1)).alias("events"))


def severity_mix(alerts: DataFrame) -> DataFrame:
    """Alerts per severity with their share; severities without alerts are there."""
    totals = alerts.agg(
        *(F.count_if(F.col("severity") == s).alias(s) for s in schema.SEVERITIES),
        F.count(F.lit(1)).alias("total"),
    )
    rows = F.array(
        *(
            F.struct(F.lit(s).alias("severity"), F.col(s).alias("alerts"))
            for s in schema.SEVERITIES
        )
    )
    return totals.select(F.explode(rows).alias("r"), "total").select(
        "r.severity", "r.alerts", share(F.col("r.alerts"), F.col("total")).alias("share")
    )


def firing_rules(alerts: DataFrame) -> DataFrame:
    """Alerts per rule, most severe first, then most frequent."""
    return (
        alerts.groupBy("rule_id", "rule_name", "severity")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(schema.severity_rank(F.col("severity")), F.desc("alerts"), "rule_id")
    )


def alerts_per(alerts: DataFrame, column: str = "severity") -> DataFrame:
    """Alert counts per severity, rule or any other column."""
    return alerts.groupBy(column).agg(F.count(F.lit(1)).alias("alerts"))


def alert_order(alerts: DataFrame, newest_first: bool = False) -> DataFrame:
    """Alerts by severity then newest, or by newest alone."""
    return alerts.orderBy(*alert_ordering(newest_first))


def alert_ordering(newest_first: bool = False) -> list[Column]:
    """The columns of `alert_order`."""
    by = [] if newest_first else [schema.severity_rank(F.col("severity"))]
    return [*by, F.desc("last_seen"), F.col("alert_id")]


def with_place(rows: DataFrame, by: Sequence[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in a total order, without one task seeing all rows.

    The rows are dealt out by ranges of the order and sorted there; the row counts of
    earlier ranges (one number per range) are added to the place in the range.
    """
    # the lower 33 bits of the id count a partition's rows, the upper ones number it
    sorted_rows = staged(
        rows.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in sorted_rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    earlier, total = [], 0
    for p in sorted(sizes):
        earlier.append((p, total))
        total += sizes[p]
    table = rows.sparkSession.createDataFrame(earlier, "_part bigint, _earlier bigint")
    in_part = F.col("_id") - F.shiftleft(part, 33)
    return (
        sorted_rows.withColumn("_part", part)
        .join(table, "_part")
        .withColumn(name, (F.col("_earlier") + in_part + 1).cast("int"))
        .drop("_id", "_part", "_earlier")
    )


def feed_stats(parsed: DataFrame) -> DataFrame:
    """Lines, events and skipped lines per feed, from parsed lines."""
    return parsed.groupBy("feed").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("event").alias("events"),
        F.count_if(F.col("event").isNull()).alias("skipped"),
    )


def funnel(parsed: DataFrame, alerts: DataFrame, armed_rules: int) -> DataFrame:
    """From lines to alerts, in one row."""
    found = alerts.agg(
        F.struct(
            F.count(F.lit(1)).alias("alerts"),
            F.count_if(F.col("severity") == "critical").alias("critical"),
            F.count_if(F.col("severity") == "high").alias("high"),
        ).alias("a")
    ).scalar()
    return parsed.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("feed").alias("feeds"),
        F.count_if(F.col("event").isNull()).alias("skipped"),
        F.count("event").alias("events"),
    ).select(
        "lines", "feeds", "skipped", "events",
        F.lit(armed_rules).cast("bigint").alias("armed_rules"),
        found["alerts"].alias("alerts"),
        found["critical"].alias("critical"),
        found["high"].alias("high"),
    )


def alert_places(alerts: DataFrame, geo: DataFrame | None = None) -> DataFrame:
    """Alerts with the place of their source address, where the rule's key has one."""
    place = G.shipped_geo(alerts.sparkSession) if geo is None else geo
    keyed = alerts.withColumn("src_ip", F.try_element_at("entity", F.lit("src_ip")))
    return G.with_place(keyed, place, "src_ip")


def new_since(rows: DataFrame, known: DataFrame, on: str = "alert_id") -> DataFrame:
    """Rows whose id is not among the known ones."""
    return rows.join(known.select(on), on, "left_anti")
