"""Writing events, skipped lines and alerts as Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.operators.staging import staged


def write_events(events: DataFrame, path: str) -> None:
    """Append events, partitioned by day and source.

    Rows of a folder come together first, in parts of even size, or each task would write a file to every folder.
    """
    (
        events.withColumn("day", F.to_date("ts"))
        .hint("rebalance", "day", "source")
        .write.mode("append")
        .partitionBy("day", "source")
        .parquet(path)
    )


def write_skipped(skipped: DataFrame, path: str) -> None:
    """Append unusable lines, partitioned by feed."""
    skipped.write.mode("append").partitionBy("feed").parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts, partitioned by the day they began."""
    (
        alerts.withColumn("day", F.to_date("first_seen"))
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def merge_alerts(alerts: DataFrame, path: str) -> None:
    """Bring the table of alerts up to date: new ids are added, known ones replaced.

    The table need not exist yet. An alert that has grown keeps its id and the day it began,
    so only the days of the given alerts are written anew. One writer at a time: of two that run at
    once, the later one overwrites days without the other's alerts.
    """
    spark = alerts.sparkSession
    days = F.to_date("first_seen")
    now = staged(alerts.withColumn("day", days))
    try:
        before = spark.read.schema(now.schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        before = now.limit(0)
    kept = before.join(now.select("day").distinct(), "day", "left_semi").join(
        now.select("alert_id"), "alert_id", "left_anti"
    )
    rows = staged(now.unionByName(kept.select(now.columns)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "day"
    ).parquet(path)
