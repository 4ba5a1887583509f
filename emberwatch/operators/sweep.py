"""Sliding-window tallies as one running sum per (key, slice)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.slices import slice_start, touched


def spread(ticks: DataFrame, keys: Sequence[str], w: Column) -> DataFrame:
    """Ticks with each slice in which their window [t, t + w] adds to a tally.

    Shuffled here, by (keys, slice), so that the marks of a sweep need not be.
    """
    t = F.col("t")
    return ticks.select("*", F.explode(touched(t, t + w, w)).alias("slice")).repartition(
        *keys, "slice"
    )


def sweep(
    sliced: DataFrame,
    keys: Sequence[str],
    w: Column,
    on: Column,
    off: Column,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Running tally at the start and at the end of every tick's window.

    Each tick adds `on` at t and takes back `off` just after t + w. A row with `ends`
    false comes at t and holds the tally of earlier ticks in [t - w, t); a row with
    `ends` true comes at t + w and holds the tally of ticks in [t, t + w]. Rows appear
    in the slice that holds their time only. Cost per row does not depend on how many
    rows a window holds.
    """
    t = F.col("t")
    # odd places are ends of windows: they come after every tick of the same time
    tick = F.struct(
        F.lit(False).alias("ends"), (t * 2).alias("at"), on.alias("change")
    )
    end = F.struct(
        F.lit(True).alias("ends"), ((t + w) * 2 + 1).alias("at"), (-off).alias("change")
    )
    ends_here = slice_start(t + w, w) == F.col("slice")
    marks = sliced.select(
        *keys, "slice", "t", w.alias("w"), *carry,
        F.explode(F.when(ends_here, F.array(tick, end)).otherwise(F.array(tick))).alias("m"),
    ).select(*keys, "slice", "t", "w", *carry, "m.*")
    earlier = (
        Window.partitionBy(*keys, "slice")
        .orderBy("at")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    tally = F.coalesce(F.sum("change").over(earlier), F.lit(0))
    at_home = F.col("ends") | (slice_start(t, F.col("w")) == F.col("slice"))
    return marks.withColumn("tally", tally).filter(at_home)


def tallies(ticks: DataFrame, keys: Sequence[str], w: Column) -> DataFrame:
    """Per key and tick: rows in [t - w, t] and in [t, t + w]. `ticks`: keys, t, n."""
    n = F.col("n")
    swept = sweep(spread(ticks, keys, w), keys, w, n, n, ["n"])
    return swept.groupBy(*keys, "t").agg(
        F.max(F.when(~F.col("ends"), F.col("tally") + n)).alias("trailing"),
        F.max(F.when(F.col("ends"), F.col("tally"))).alias("leading"),
    )
