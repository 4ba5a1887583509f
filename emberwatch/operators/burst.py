"""Bursts: a tally reaching a threshold inside a sliding window per key.

A burst starts at the first event, not yet used by an earlier burst, whose *forward*
window [t, t + within] reaches the threshold, and takes every event of that window.
(The usual telling, "as soon as the trailing window reaches it, stretch to within of
its start", picks the same events for tallies that never shrink as rows are added.)
So the forward tally of every tick decides who can start, and the greedy choice picks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.operators import blocks, kernels

_KEY = ["rule_id", "entity_key"]
_RULE = ["w", "need", "counts_values"]
LABELS = "rule_id string, entity_key string, t bigint, s_t bigint, s_tie bigint, e_t bigint, e_tie bigint"


def _ticks(rows: DataFrame) -> DataFrame:
    """Rows of one time summed, one per value where values count."""
    value = F.when(F.col("counts_values"), F.col("counted"))
    kind = rows.schema["amount"].dataType
    return rows.groupBy(*_KEY, *_RULE, "t", value.alias("counted")).agg(F.sum("amount").cast(kind).alias("amount"))


def labels(hits: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The ticks inside bursts, with the burst's span: rule_id, entity_key, t, s_t, s_tie, e_t, e_tie.

    `hits`: rule_id, entity_key, w and need (window and threshold of the rule),
    counts_values (whether distinct values count), t, amount (1, or the field to total; not
    negative) and counted (the value). `hot` names keys whose rows are cut into blocks.
    """
    rows = hits.select(*_KEY, *_RULE, "t", "counted", "amount")
    return blocks.solve(rows, kernels.bursts, LABELS, ["t"], hot, merged=_ticks)
