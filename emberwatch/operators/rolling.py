"""Rolling failure alerts with suppression, per source address."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import times
from emberwatch.operators import blocks, kernels
from emberwatch.operators.staging import staged

# Fixed values.
RULE_ID, SEVERITY, MITRE_ID = "brute-force", "high", "T1110"
_KEY = ["rule_id", "entity_key"]


def _ticks(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*_KEY, "w", "need", "t").agg(F.sum("n").alias("n"))


def rolling_alerts(
    events: DataFrame,
    within: timedelta = timedelta(minutes=5),
    count: int = 5,
    key: str = "src_ip",
) -> DataFrame:
    """An alert when a failure makes `count` of its key in the last `within`.

    After an alert, the key stays quiet for as long. Time is event time. The count in an alert is
    the tally at the row that raises it, the first row of its time from which the count is met.
    """
    address = F.col(key).cast("string")
    number = lambda n: F.lit(n).cast("bigint")
    failures = staged(
        events.filter((F.col("status") == "failure") & F.coalesce(address != "", F.lit(False))).select(
            F.lit(RULE_ID).alias("rule_id"), address.alias("entity_key"), times.micros(F.col("ts")).alias("t"),
            number(times.span_micros(within)).alias("w"), number(count).alias("need"), number(1).alias("n"),
        )
    )
    chosen = blocks.solve(
        failures, kernels.rolling,
        "rule_id string, entity_key string, t bigint, tally bigint, s_t bigint, s_tie bigint, e_t bigint, e_tie bigint", ["t"],
        blocks.hot_keys(failures), before=True, merged=_ticks,
    )
    n = F.col("tally")
    return chosen.select(
        F.timestamp_micros("s_t").alias("timestamp"),
        "rule_id",
        F.lit(SEVERITY).alias("severity"),
        F.col("entity_key").alias("entity"),
        F.concat(
            F.lit("Possible brute-force attack: "), n.cast("string"),
            F.lit(" failed attempts from "), F.col("entity_key"),
        ).alias("description"),
        n.alias("event_count"),
        F.lit(MITRE_ID).alias("mitre_id"),
    )
