"""Impossible travel: consecutive events of one key, far apart and close in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions import net
from emberwatch.operators import blocks
from emberwatch.operators import geo as G
from emberwatch.operators.staging import staged

_KEY = ["rule_id", "entity_key"]
HOUR = 3_600_000_000


def _with_previous(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows with the row before of the same key (prev).

    Rows of hot keys are cut by count into ranges of time; the first row of a range gets the
    last one of the range before, from a table with one row per key and range.
    """
    here, by_time = F.struct("t", "tie", "src_ip"), Window.partitionBy(*_KEY).orderBy("t", "tie")
    if hot is None:
        return rows.withColumn("prev", F.lag(here).over(by_time))
    cold = rows.join(hot, _KEY, "left_anti").withColumn("prev", F.lag(here).over(by_time))
    warm = staged(rows.join(hot, _KEY, "left_semi"))
    cut = -(-warm.count() // blocks.BLOCK_ROWS)
    dealt = staged(
        warm.repartitionByRange(max(1, cut), *_KEY, "t", "tie").withColumn("block", F.spark_partition_id())
    )
    last = dealt.groupBy(*_KEY, "block").agg(F.max(here).alias("last"))
    earlier = last.select(
        *_KEY, "block", F.lag("last").over(Window.partitionBy(*_KEY).orderBy("block")).alias("earlier")
    )
    inside = F.lag(here).over(Window.partitionBy(*_KEY, "block").orderBy("t", "tie"))
    joined = dealt.withColumn("prev", inside).join(earlier, [*_KEY, "block"])
    return cold.unionByName(
        joined.withColumn("prev", F.coalesce("prev", "earlier")).select(*cold.columns)
    )


def pairs(hits: DataFrame, geo: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Pairs (previous, current) of consecutive events that no traveller can make.

    `hits`: rule_id, entity_key, w, min_km, min_kmh, t, tie, src_ip (public addresses
    only). `hot` names keys whose rows are cut into ranges of time. Addresses are located
    after the time and address tests, so few rows reach the joins.
    """
    t, w = F.col("t"), F.col("w")
    rows = hits.select(*_KEY, "w", "min_km", "min_kmh", "t", "tie", "src_ip")
    near = (
        _with_previous(rows, hot)
        .filter(
            (F.col("prev.src_ip") != F.col("src_ip"))
            & (t > F.col("prev.t"))
            & (t - F.col("prev.t") <= w)
        )
        .select(
            *_KEY, "min_km", "min_kmh", "t", "tie",
            F.col("src_ip").alias("to_ip"),
            F.col("prev.t").alias("prev_t"),
            F.col("prev.tie").alias("prev_tie"),
            F.col("prev.src_ip").alias("from_ip"),
        )
    )
    km = net.great_circle_km(*(F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")))
    hours = (t - F.col("prev_t")) / HOUR
    return (
        G.with_place(G.with_place(near, geo, "from_ip", "from_"), geo, "to_ip", "to_")
        .withColumn("km", km)
        .withColumn("kmh", F.col("km") / hours)
        .filter((F.col("km") >= F.col("min_km")) & (F.col("kmh") >= F.col("min_kmh")))
        .select(
            *_KEY,
            F.col("prev_t").alias("s_t"),
            F.col("prev_tie").alias("s_tie"),
            F.col("t").alias("e_t"),
            F.col("tie").alias("e_tie"),
            "from_ip", "to_ip", "from_city", "from_cc", "to_city", "to_cc", "km", "kmh",
        )
    )
