"""Cutting lineage where a result is read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a scan from which it matters how they are dealt, and rows of a task once they are.
FEW_ROWS, TASK_ROWS = 50_000, 250_000


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    On a cluster `spark.checkpoint.dir` must name a shared folder, so that results survive lost
    executors. Only a local session without one gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="emberwatch-"))
    return context.getCheckpointDir().rstrip("/")


def staged(rows: DataFrame) -> DataFrame:
    """The rows, computed once and kept as Parquet in the shared folder. Readers take only the columns they need."""
    path = f"{shared_folder(rows.sparkSession)}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def staged_bytes(rows: DataFrame) -> int:
    """The size of a staged table's files, as Spark's planner knows it."""
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a scan, dealt by a hash of `key` if one task would have far more than its share of them.

    A row group is read by one task, however many splits its file has. The rows of each task are
    counted from the files' footers; no column is read for it.
    """
    sizes = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = found["n"] or 0
    if (found["most"] or 0) <= max(FEW_ROWS, 2 * n // cores):
        return rows
    return rows.repartition(max(4 * cores, -(-n // TASK_ROWS)), F.xxhash64(key))
