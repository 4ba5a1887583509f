"""Sequences: ordered steps within one window of the first event, per key.

From a first-step event, a step collects its events until it has as many as it needs
and the next step's event arrives. Where that ends depends only on the rows after the
first event, so it is found for all rows at once, last step first: the end from a
row of step k is the end from the next row of step k+1 after step k's need is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators import blocks, kernels

LABELS = (
    "rule_id string, entity_key string, t bigint, tie bigint, mask bigint, "
    "s_t bigint, s_tie bigint, e_t bigint, e_tie bigint"
)


def matches_step(mask: Column, back: int) -> Column:
    """Whether a row matches the step `back` steps before the last."""
    return F.shiftright(mask, back).bitwiseAND(F.lit(1).cast("bigint")) == 1


def labels(hits: DataFrame, needs: dict[str, list[int]], hot: DataFrame | None = None) -> DataFrame:
    """The rows inside completed sequences that match the step open at their place, with the span.

    `hits`: rule_id, entity_key, w, t, tie, mask (bit 0 is the last step). `needs` gives each
    rule's counts, first step first. `hot` names keys whose rows are cut into blocks.
    """
    rows = hits.select("rule_id", "entity_key", "w", "t", "tie", "mask")
    return blocks.solve(rows, kernels.sequences(needs), LABELS, ["t", "tie", "mask"], hot)
