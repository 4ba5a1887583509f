"""Log time formats, epoch arithmetic and human-readable spans."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MONTHS = (
    "jan", "feb", "mar", "apr", "may", "jun",
    "jul", "aug", "sep", "oct", "nov", "dec",
)


def month_number(name: Column) -> Column:
    """1..12 from the first three letters, NULL when unknown."""
    at = F.array_position(
        F.array(*(F.lit(m) for m in MONTHS)), F.lower(F.substring(name, 1, 3))
    )
    return F.nullif(at, F.lit(0)).cast("int")


def _at(date: Column, clock: Column) -> Column:
    """Date plus hh:mm:ss as a UTC instant; out-of-range clock values roll over."""
    h, m, s = (F.split_part(clock, F.lit(":"), F.lit(i)).try_cast("bigint") for i in (1, 2, 3))
    days = F.unix_date(date) * F.lit(86400).cast("bigint")
    return F.timestamp_seconds(days + h * 3600 + m * 60 + s)


def syslog_time(month: Column, day: Column, clock: Column, year: int | Column) -> Column:
    """Year-less syslog time as UTC, of the given year. Days past the month's end roll over."""
    first = F.make_date(F.lit(year), month_number(month), F.lit(1))
    return _at(F.date_add(first, day.try_cast("int") - 1), clock)


def clf_time(text: Column) -> Column:
    """Common-log-format time ('12/Mar/2025:08:14:22 +0000', zone optional) as UTC.

    Days past the month's end roll over.
    """
    valid = text.rlike(r"^\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}\s*([+-]\d{4})?\z")
    first = F.make_date(
        F.substring(text, 8, 4).try_cast("int"), month_number(F.substring(text, 4, 3)), F.lit(1)
    )
    local = _at(
        F.date_add(first, F.substring(text, 1, 2).try_cast("int") - 1), F.substring(text, 13, 8)
    )
    zone = F.when(F.char_length(text) > 20, F.right(text, F.lit(5)))
    minutes = (
        F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    )
    ahead = F.when(zone.startswith("-"), -minutes).otherwise(minutes)
    return F.when(
        valid, F.timestamp_seconds(F.unix_seconds(local) - F.coalesce(ahead, F.lit(0)) * 60)
    )


def iso_time(text: Column) -> Column:
    """ISO-8601 time as UTC, NULL when malformed or without a date. Needs session zone UTC."""
    return F.when(text.rlike(r"^\s*[+-]?\d{4,}(-|\s*$)"), text.try_cast("timestamp"))


def micros(ts: Column) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ."""
    return F.unix_micros(ts.cast("timestamp"))


def span_micros(span: timedelta) -> int:
    """A timedelta in microseconds."""
    return span // timedelta(microseconds=1)


def human_span(ms: Column) -> Column:
    """'400ms', '45s', '3m', '3m14s', '1h5m' from milliseconds."""
    s = F.floor(ms / 1000 + 0.5)
    m = F.floor(s / 60)
    rest = s % 60

    def text(c: Column) -> Column:
        return c.cast("bigint").cast("string")

    minutes = F.when(
        rest != 0, F.concat(text(m), F.lit("m"), text(rest), F.lit("s"))
    ).otherwise(F.concat(text(m), F.lit("m")))
    return (
        F.when(ms < 1000, F.concat(text(ms), F.lit("ms")))
        .when(s < 60, F.concat(text(s), F.lit("s")))
        .when(m < 60, minutes)
        .otherwise(F.concat(text(F.floor(m / 60)), F.lit("h"), text(m % 60), F.lit("m")))
    )
