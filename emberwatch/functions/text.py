"""Regular-expression and text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space class of the log formats, for use inside [...].
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
S = f"[{WS}]"
NS = f"[^{WS}]"
ANY = r"[^\n\r\u2028\u2029]"
END = r"\z"

# Separates captured groups. A Unicode noncharacter: no text may hold it, and it is
# left out of captured fields should a line hold it all the same.
_MARK = "\uFFFF"


def _quick(pattern: str) -> str:
    """The pattern with Java's own classes, which mean the same in ASCII text."""
    return (
        pattern.replace(NS, r"\S").replace(S, r"\s").replace(WS, r"\s").replace(ANY, ".")
    )


def by_script(text: Column, pattern: str, build: Callable[[Column, str], Column]) -> Column:
    """`build(text, pattern)`, with a much faster equal pattern for ASCII text."""
    if _quick(pattern) == pattern:
        return build(text, pattern)
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, build(text, _quick(pattern))).otherwise(build(text, pattern))


def capture(text: Column, pattern: str, *slots: str) -> Column:
    """Array whose item i is slot i for text that matches, one item only otherwise.

    A slot is a replacement text such as '$2' or 'session $1'; groups that took no part
    are ''. The pattern is anchored at the start of the text. One regex pass per row
    instead of one per group: matching text is rewritten to its slots and split. Keep
    the array as a column of its own and read it with `group`, so that it is computed
    once.
    """
    joined = "".join(_MARK + slot for slot in slots)

    def split(value: Column, regex: str) -> Column:
        clean = F.translate(value, _MARK, "") if regex == pattern else value
        return F.split(F.regexp_replace(clean, rf"{regex}[\s\S]*", joined), _MARK)

    return by_script(text, pattern, split)


def extract(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, '' without one."""
    return by_script(text, pattern, lambda t, p: F.regexp_extract(t, p, 1))


def groups(n: int) -> list[str]:
    """Slots for groups 1..n."""
    return [f"${i}" for i in range(1, n + 1)]


def group(captured: Column, i: int) -> Column:
    """Slot i of a captured array, NULL without a match."""
    return F.get(captured, F.lit(i))


def nonempty(text: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(text, F.lit(""))


def blank(text: Column) -> Column:
    """True for lines of white space only."""
    return ~by_script(text, NS, lambda t, p: t.rlike(p))


def trim(text: Column) -> Column:
    """Strip the white-space class from both ends."""
    return by_script(
        text, rf"^{S}+|{S}+{END}", lambda t, p: F.regexp_replace(t, p, "")
    )


def words(text: Column) -> Column:
    """The text split at white space."""
    return by_script(text, S, lambda t, p: F.split(t, p))


def kv_last(parts: Column, key: str) -> Column:
    """Value of KEY=VALUE among words, NULL when absent; the last duplicate wins.

    A word gives one pair: the name that ends at its first '=', and all that follows.
    """
    start = f"{key}="
    inside = rf"^(?:[^=]*[^=A-Za-z0-9_])?[0-9]*{start}"
    hits = F.filter(
        parts,
        lambda w: w.startswith(start) | (F.contains(w, F.lit(start)) & w.rlike(inside)),
    )
    last = F.try_element_at(hits, F.lit(-1))
    return F.when(last.startswith(start), F.substr(last, F.lit(len(start) + 1))).otherwise(
        F.regexp_replace(last, inside, "")
    )


def apart(value: Column, build: Callable[[Column], Column]) -> Column:
    """`build(value)`, kept out of the generated code of the surrounding plan stage.

    Large expressions push a stage's generated method past the size that the JVM still
    compiles; a higher-order function over a one-item array runs on its own.
    """
    return F.get(F.transform(F.array(value), build), F.lit(0))


def safe_int(text: Column, to: str = "bigint") -> Column:
    """Integer value of a text, NULL when it is not one."""
    return text.try_cast(to)


def url_decode(text: Column) -> Column:
    """Percent-decode with '+' as space; malformed escapes leave the text as it was."""
    bad_escape = text.rlike("%(?![0-9A-Fa-f]{2})")
    decoded = F.try_url_decode(text)
    # invalid UTF-8 decodes to U+FFFD, which the text must have had already
    gained = (F.length(decoded) - F.length(F.replace(decoded, F.lit("\uFFFD"), F.lit("")))) > (
        F.length(text) - F.length(F.replace(text, F.lit("\uFFFD"), F.lit("")))
        + F.regexp_count(text, F.lit("(?i)%EF%BF%BD"))
    )
    return F.when(bad_escape | decoded.isNull() | gained, text).otherwise(decoded)


def template(text: str, value_of) -> Column:
    """Fill {name} placeholders; `value_of(name)` gives a Column or None.

    A placeholder without a column, or whose column is NULL, stays as written.
    """
    import re

    parts: list[Column] = []
    at = 0
    for hit in re.finditer(r"\{(\w+)\}", text):
        if hit.start() > at:
            parts.append(F.lit(text[at : hit.start()]))
        value = value_of(hit.group(1))
        parts.append(
            F.lit(hit.group(0))
            if value is None
            else F.coalesce(value.cast("string"), F.lit(hit.group(0)))
        )
        at = hit.end()
    if at < len(text):
        parts.append(F.lit(text[at:]))
    return F.concat(*parts) if parts else F.lit("")


def valid_utf8(text: Column) -> Column:
    """Text whose bytes that are not UTF-8 have become U+FFFD."""
    return F.call_function("make_valid_utf8", text)
