"""Correlation: matches of one rule and key whose times touch become one alert."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.operators import blocks, kernels
from emberwatch.operators.slices import slice_start
from emberwatch.operators.staging import staged
from emberwatch.packaging import ship

_KEY = ["rule_id", "entity_key"]


def _islands(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Number runs of rows whose first_t is within w of the latest last_t before."""
    by_time = Window.partitionBy(*keys).orderBy(*order)
    before = by_time.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_time.rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col("first_t") - F.max("last_t").over(before)
    return rows.withColumn(
        "_new", F.when(F.coalesce(gap > F.col("w"), F.lit(True)), 1).otherwise(0)
    ).withColumn("_island", F.sum("_new").over(upto))


def with_alert(matches: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Matches with the alert each belongs to (alert_t, the first_t of the alert's first match).

    `matches`: rule_id, entity_key, w, s_t, s_tie, first_t, last_t, no longer than w. Keys are
    folded whole; those that `hot` names, by slices of time.
    """
    ship(matches.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in kernels.whole_groups(batches, _KEY):
            yield from table.append_column("alert_t", pa.array(kernels.islands(table), pa.int64())).to_batches()

    schema = T.StructType([*matches.schema.fields, T.StructField("alert_t", T.LongType())])
    cold = matches if hot is None else matches.join(hot, _KEY, "left_anti")
    folded = blocks.grouped(cold, _KEY, ["first_t", "s_t", "s_tie"]).mapInArrow(task, schema)
    if hot is None:
        return folded
    warm = staged(matches.join(hot, _KEY, "left_semi"))
    return folded.unionByName(warm.join(alert_of(warm), [*_KEY, "s_t", "s_tie"]))


def alert_of(matches: DataFrame) -> DataFrame:
    """Which alert each match belongs to: rule_id, entity_key, s_t, s_tie, alert_t.

    Runs are found per time slice first; only one row per run and slice then comes together per
    key to join runs over slice borders.
    """
    local = _islands(
        matches.select(*_KEY, "w", "s_t", "s_tie", "first_t", "last_t").withColumn(
            "slice", slice_start(F.col("first_t"), F.col("w"))
        ),
        [*_KEY, "slice"],
        ["first_t", "s_t", "s_tie"],
    )
    runs = local.groupBy(*_KEY, "slice", "_island").agg(
        F.max("w").alias("w"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t")
    )
    joined = _islands(
        runs.withColumnRenamed("_island", "_run"), _KEY, ["first_t"]
    )
    whole = Window.partitionBy(*_KEY, "_island")
    run_alert = joined.select(
        *_KEY, "slice", F.col("_run").alias("_island"),
        F.min("first_t").over(whole).alias("alert_t"),
    )
    return local.join(run_alert, [*_KEY, "slice", "_island"]).select(
        *_KEY, "s_t", "s_tie", "alert_t"
    )


def unseen_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence rows of alerts without those an earlier match of the alert has.

    Rows are the same evidence when their raw text and time agree. Rows repeated
    within one match stay.
    """
    same = [*_KEY, "alert_t", "t", "raw"]
    holder = F.struct("s_t", "s_tie")
    first = (
        evidence.groupBy(*same)
        .agg(F.min(holder).alias("_first"))
        .select(*(F.col(c).alias(f"_{c}") for c in same), "_first")
    )
    match = F.lit(True)
    for c in same:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return evidence.join(
        first, match & (holder == F.col("_first")), "left_semi"
    )


def first_values(
    rows: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, int | None]]
) -> DataFrame:
    """Per key, arrays of the first few distinct values of each wanted column.

    `wanted`: name -> (text column, how many; None: all). Values are in order of first appearance.
    Rows are reduced to one per value before anything is ranked.
    """
    items = F.array(
        *(
            F.struct(F.lit(name).alias("kind"), c.cast("string").alias("value"))
            for name, (c, _) in wanted.items()
        )
    )
    firsts = (
        rows.select(*keys, F.struct("t", "tie").alias("at"), F.explode(items).alias("i"))
        .filter(F.col("i.value").isNotNull())
        .groupBy(*keys, F.col("i.kind").alias("kind"), F.col("i.value").alias("value"))
        .agg(F.min("at").alias("at"))
    )
    limits = {name: n for name, (_, n) in wanted.items() if n is not None}
    kept = firsts.filter(~F.col("kind").isin(list(limits)))
    if limits:
        rank = Window.partitionBy(*keys, "kind").orderBy("at", "value")
        limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))
        few = firsts.filter(F.col("kind").isin(list(limits))).withColumn("n", F.row_number().over(rank))
        few = few.filter((F.col("n") <= max(limits.values())) & (F.col("n") <= limit[F.col("kind")]))
        kept = few.drop("n") if len(limits) == len(wanted) else few.drop("n").unionByName(kept)
    picked = F.struct("at", "value")
    return kept.groupBy(*keys).agg(
        *(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("kind") == name, picked))),
                lambda x: x["value"],
            ).alias(name)
            for name in wanted
        )
    )
