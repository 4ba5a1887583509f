"""Scans of files of one row group are dealt over the tasks; others stay as they are."""

import pytest
from pyspark.sql import functions as F

from emberwatch.driver import incidents as I
from emberwatch.driver import tables as T
from emberwatch.operators.staging import spread

ROWS = 120_000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("spread")
    spark.range(ROWS).coalesce(1).select(
        F.col("id").alias("event_id"), F.lit("2024-01-05 10:00:00").cast("timestamp_ntz").alias("ts"), (F.col("id") % 9).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    ).write.parquet(str(path / "events.parquet"))
    return str(path)


def sizes(rows):
    return [r.n for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


@pytest.mark.parametrize("made", [T.security_events, I.scenes])
def test_a_row_group_is_worked_on_by_many_tasks(spark, folder, made):
    rows = made(spark, folder)
    found = sizes(rows)
    assert sum(found) == ROWS and max(found) < ROWS / 8
    assert rows.select("tie").distinct().count() == ROWS


def test_what_is_small_or_even_is_not_dealt(spark, folder):
    few = T.read(spark, folder, "events").where("event_id < 40000")
    assert spread(few, "event_id") is few
    even = spark.range(ROWS)
    assert spread(even, "id") is even
    none = spark.createDataFrame([], "id bigint")
    assert spread(none, "id") is none
