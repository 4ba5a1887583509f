"""A bitmap of hashed keys that thins out a large table before it is joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map; it has at most BITS / 64 rows of two longs, so it can always be sent to tasks.
BITS = 1 << 24


def _place(columns: Sequence[str | Column]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BITS))


def bitmap(keys: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    """(word, bits) of the keys' hashes, summed up per task before any shuffle."""
    bit = F.expr("shiftleft(1L, cast(_at % 64 as int))")
    return (
        keys.select(_place(columns).alias("_at"))
        .groupBy(F.floor(F.col("_at") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    )


def maybe_in(rows: DataFrame, columns: Sequence[str | Column], marks: DataFrame) -> DataFrame:
    """Rows whose key may be among the map's keys: all that are, and few others while keys are few for BITS."""
    at = rows.withColumn("_at", _place(columns)).withColumn("_word", F.floor(F.col("_at") / 64))
    kept = at.join(F.broadcast(marks), "_word").where(F.expr("getbit(_bits, cast(_at % 64 as int)) = 1"))
    return kept.select(*rows.columns)
