"""Two-valued predicates over events, as Column builders.

A missing field never makes a predicate NULL: it is simply no match, so `ne`,
`not_matches` and `~` hold for it. Text compares without regard to case. Predicates
are bound to a schema when used, because they depend on whether a field is a number
or text, and because a field the schema lacks counts as missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberwatch.functions import text as X

Literal = str | int | float


class Predicate:
    """A condition that becomes a non-null boolean Column once bound to a schema."""

    def __init__(self, build: Callable[[T.StructType], Column]):
        self._build = build

    def bind(self, schema: T.StructType) -> Column:
        return self._build(schema)

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(lambda s: self.bind(s) & other.bind(s))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(lambda s: self.bind(s) | other.bind(s))

    def __invert__(self) -> Predicate:
        return Predicate(lambda s: ~self.bind(s))


def keep(rows: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows for which the predicate holds."""
    return rows.filter(predicate.bind(rows.schema))


def _no_null(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _kind(schema: T.StructType, name: str) -> str:
    if name not in schema.names:
        return "missing"
    data_type = schema[name].dataType
    if isinstance(data_type, T.NumericType):
        return "number"
    return "text" if isinstance(data_type, T.StringType) else "other"


def _number_text(value: float | int) -> str:
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def _field_text(name: str, data_type: T.DataType) -> Column:
    """A number as text, whole numbers without a fraction."""
    c = F.col(name)
    if isinstance(data_type, T.IntegralType):
        return c.cast("string")
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _as_number(value: Literal) -> float | int | None:
    if not isinstance(value, str):
        return value
    try:
        return float(value) if not re.fullmatch(r"[+-]?\d+", value) else int(value)
    except ValueError:
        return None


def eq(name: str, value: Literal) -> Predicate:
    def build(s: T.StructType) -> Column:
        kind = _kind(s, name)
        if kind == "number":
            if isinstance(value, str):
                return _no_null(_field_text(name, s[name].dataType) == value)
            return _no_null(F.col(name) == value)
        if kind == "text":
            if isinstance(value, str):
                return _no_null(F.lower(name) == value.lower())
            return _no_null(F.col(name) == _number_text(value))
        return F.lit(False)

    return Predicate(build)


def ne(name: str, value: Literal) -> Predicate:
    return ~eq(name, value)


def _compare(name: str, value: Literal, op: Callable[[Column, object], Column]) -> Predicate:
    def build(s: T.StructType) -> Column:
        bound = _as_number(value)
        if _kind(s, name) != "number" or bound is None:
            return F.lit(False)
        return _no_null(op(F.col(name), bound))

    return Predicate(build)


def gt(name: str, value: Literal) -> Predicate:
    return _compare(name, value, lambda c, v: c > v)


def lt(name: str, value: Literal) -> Predicate:
    return _compare(name, value, lambda c, v: c < v)


def ge(name: str, value: Literal) -> Predicate:
    return _compare(name, value, lambda c, v: c >= v)


def le(name: str, value: Literal) -> Predicate:
    return _compare(name, value, lambda c, v: c <= v)


def matches(name: str, pattern: str) -> Predicate:
    r"""Unanchored regex. `\s` in Java is ASCII only; use functions.text.WS for more."""

    def build(s: T.StructType) -> Column:
        if _kind(s, name) != "text":
            return F.lit(False)
        return _no_null(
            X.by_script(F.col(name), pattern, lambda t, p: t.rlike(f"(?i){p}"))
        )

    return Predicate(build)


def not_matches(name: str, pattern: str) -> Predicate:
    return ~matches(name, pattern)


def contains(name: str, value: Literal) -> Predicate:
    wanted = (value if isinstance(value, str) else _number_text(value)).lower()

    def build(s: T.StructType) -> Column:
        if _kind(s, name) != "text":
            return F.lit(False)
        return _no_null(F.contains(F.lower(name), F.lit(wanted)))

    return Predicate(build)


def one_of(name: str, values: Iterable[Literal]) -> Predicate:
    values = list(values)

    def build(s: T.StructType) -> Column:
        kind = _kind(s, name)
        if not values or kind in ("missing", "other"):
            return F.lit(False)
        if kind == "text":
            wanted = [
                v.lower() if isinstance(v, str) else _number_text(v) for v in values
            ]
            return _no_null(F.lower(name).isin(wanted))
        numbers = [v for v in values if not isinstance(v, str)]
        texts = [v for v in values if isinstance(v, str)]
        out = F.lit(False)
        if numbers:
            out = out | F.col(name).isin(numbers)
        if texts:
            out = out | _field_text(name, s[name].dataType).isin(texts)
        return _no_null(out)

    return Predicate(build)


def exists(name: str) -> Predicate:
    def build(s: T.StructType) -> Column:
        return F.lit(False) if name not in s.names else F.col(name).isNotNull()

    return Predicate(build)


def all_of(*predicates: Predicate) -> Predicate:
    out = predicates[0]
    for p in predicates[1:]:
        out = out & p
    return out


def any_of(*predicates: Predicate) -> Predicate:
    out = predicates[0]
    for p in predicates[1:]:
        out = out | p
    return out


# --- Attack signatures over the decoded path --------------------------------------

# Fixed values.
SQLI = (
    rf"(union[{X.WS}/*]+select|select{X.ANY}+from{X.S}+information_schema|"
    rf"\bor\b{X.S}+1{X.S}*={X.S}*1|sleep{X.S}*\({X.S}*\d|benchmark{X.S}*\(|"
    rf"';{X.S}*(drop|update|insert){X.S})"
)
XSS = (
    rf"(<script|<{X.S}*img[^>]+onerror|javascript:|onload{X.S}*=|onerror{X.S}*=|"
    r"<svg[^>]+on)"
)
TRAVERSAL = r"(\.\./\.\./|/etc/passwd|/proc/self/environ|c:\\windows\\win.ini)"


# --- Console filters ----------------------------------------------------------------

SEARCHED_EVENT_FIELDS = (
    "src_ip", "dst_ip", "user", "path", "action", "host", "msg", "raw",
)
SEARCHED_ALERT_FIELDS = (
    "rule_name", "rule_id", "narrative", "mitre_id", "mitre_name",
)


def search_events(events: DataFrame, query: str) -> DataFrame:
    """Events with the text in any searched field; an empty query keeps all."""
    if not query:
        return events
    return keep(events, any_of(*(contains(f, query) for f in SEARCHED_EVENT_FIELDS)))


def search_alerts(alerts: DataFrame, query: str) -> DataFrame:
    """Alerts with the text in a searched field or in any entity value."""
    if not query:
        return alerts
    in_fields = any_of(*(contains(f, query) for f in SEARCHED_ALERT_FIELDS))
    in_entity = F.exists(
        F.map_values("entity"), lambda v: F.contains(F.lower(v), F.lit(query.lower()))
    )
    return alerts.filter(
        in_fields.bind(alerts.schema) | F.coalesce(in_entity, F.lit(False))
    )


def with_sources(events: DataFrame, sources: Iterable[str]) -> DataFrame:
    """Events of the given sources; an empty set keeps all."""
    wanted = list(sources)
    return events.filter(F.col("source").isin(wanted)) if wanted else events


def alerts_with(
    alerts: DataFrame, severities: Iterable[str] = (), sources: Iterable[str] = ()
) -> DataFrame:
    """Alerts of the given severities that have any of the given sources."""
    severities, sources = list(severities), list(sources)
    if severities:
        alerts = alerts.filter(F.col("severity").isin(severities))
    if sources:
        wanted = F.array(*(F.lit(s) for s in sources))
        alerts = alerts.filter(F.arrays_overlap("sources", wanted))
    return alerts
