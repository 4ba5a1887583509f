"""Time slices: how a hot key is spread over many tasks.

A window of length w over one key never needs rows more than w away. So a key's time
line is cut into slices of SLICE_WINDOWS * w, each row goes to the slice it lies in,
and rows within w of a border also go to the neighbour that needs them. Work is then
partitioned by (rule, key, slice) instead of (rule, key), at the price of repeating
one row in SLICE_WINDOWS.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_WINDOWS = 8


def slice_start(t: Column, w: Column) -> Column:
    """Start of the slice that holds time t, for windows of length w (microseconds)."""
    return t - F.pmod(t, w * SLICE_WINDOWS)


def touched(first: Column, last: Column, w: Column) -> Column:
    """Array of the slices of two times at most w apart."""
    return F.array_distinct(F.array(slice_start(first, w), slice_start(last, w)))
