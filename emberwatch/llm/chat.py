"""Chat formatting: tool calls linked with their results, ordered, validated, as canonical JSON.

DataFrame functions only, but for checking arguments against schemas, which is Arrow-batched.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

_SURROGATE = re.compile("[\ud800-\udfff]")
_KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float),
}


def _plain(value: Any) -> Any:
    """The value with whole numbers as integers, however they were written."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(value: Any) -> str:
    """JSON with sorted keys, no white space, whole numbers without a fraction, characters as they are but for lone surrogates."""
    text = json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _same(a: Any, b: Any) -> bool:
    """Equality of JSON values: true and 1 differ, 1 and 1.0 do not."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise OverflowError(text)
    return value


def _no_number(text: str) -> None:
    raise ValueError(text)


def violations(value: Any, schema: dict[str, Any], at: str = "$") -> list[str]:
    """Where value breaks a JSON schema of type, enum, required, properties, additionalProperties, items,
    minimum, maximum, minLength and maxLength. Nothing is of a type that JSON does not have."""
    found = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        fits = lambda k: isinstance(value, _KINDS.get(k, ())) and not (isinstance(value, bool) and k in ("integer", "number"))
        if not any(fits(k) or (k == "integer" and isinstance(value, float) and value.is_integer()) for k in kinds):
            return [f"{at}: not of type {'|'.join(kinds)}"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        found.append(f"{at}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: not allowed")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: too long")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            found.append(f"{at}: too large")
    return found


def _serialised(schemas: dict[str, dict[str, Any]], role: str | None, call: str | None, name: str | None, body: str | None) -> tuple[str, str | None]:
    """The message as canonical JSON and what is wrong with its arguments, if anything.

    Arguments that are not JSON, hold a number beyond a double's range, or are nested too deeply to be read, stay text.
    """
    if role != "call":
        message = {"role": "tool", "tool_call_id": call, "content": body} if role == "result" else {"role": role, "content": body}
        return canonical(message), None

    def told(arguments: Any) -> str:
        function = {"name": name, "arguments": arguments}
        return canonical({"role": "assistant", "tool_calls": [{"id": call, "type": "function", "function": function}]})

    try:
        arguments = json.loads(body or "", parse_float=_number, parse_constant=_no_number)
        wrong = "; ".join(violations(arguments, schemas[name])) or None if name in schemas else "unknown tool"
        return told(arguments), wrong
    except ValueError:
        return told(body), "arguments are not JSON"
    except OverflowError:
        return told(body), "arguments hold a number out of range"
    except RecursionError:
        return told(body), "arguments are nested too deeply"


def linked(messages: DataFrame) -> DataFrame:
    """messages and link: a call's state (answered, unanswered, repeated) or a result's (linked, orphan, repeated), and call_turn.

    messages: (conv_id, turn, role, call_id, name, body, needs), role `call` or `result` for tool calls and
    results, any other for plain messages; needs: the ids of calls that a call uses the results of. Calls and results of a
    conversation meet in a join by identifier. Of several calls, or results, with one id the
    first counts (then by body); the others are `repeated`. Null conversations are one conversation; a null id links nothing.
    Other columns are left out.
    """
    shared_folder(messages.sparkSession)
    messages = messages.select("conv_id", "turn", "role", "call_id", "name", "body", "needs")
    keyed = messages.withColumns({"_conv": F.coalesce("conv_id", F.lit(-1 << 62)), "_key": F.xxhash64("turn", "name", "body")})
    one = keyed.where(F.col("role").isin("call", "result") & F.col("call_id").isNotNull()).groupBy("_conv", "call_id", "role").agg(
        F.min(F.struct("turn", "_key")).alias("first")
    )
    ends = one.groupBy("_conv", "call_id").agg(
        F.max(F.when(F.col("role") == "call", F.col("first"))).alias("call"), F.max(F.when(F.col("role") == "result", F.col("first"))).alias("result")
    ).checkpoint()
    plain = keyed.where(~F.coalesce(F.col("role").isin("call", "result"), F.lit(False)) | F.col("call_id").isNull())
    plain = plain.withColumns({"link": F.when(F.col("role") == "call", "unanswered").when(F.col("role") == "result", "orphan"), "call_turn": F.lit(None).cast("long")})
    tool = keyed.where(F.col("role").isin("call", "result") & F.col("call_id").isNotNull()).join(ends, ["_conv", "call_id"])
    own = F.struct("turn", "_key")
    mine = F.when(F.col("role") == "call", F.col("call")).otherwise(F.col("result"))
    link = (
        F.when(own != mine, "repeated").when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered")
        .when(F.col("role") == "call", "answered").otherwise("linked")
    )
    tool = tool.withColumns({"link": link, "call_turn": F.col("call.turn")})
    names = [*messages.columns, "_conv", "link", "call_turn"]
    return plain.select(*names).union(tool.select(*names))


def ordered(rows: DataFrame) -> DataFrame:
    """rows of `linked` with level and cyclic: a place such that results follow their calls, and calls what they need.

    A plain message's level is its turn. A call's level is at least its turn and one more than the
    result of each call it needs; a result's is one more than its call's, at least its turn. Each round of joins
    places the calls whose needs are all placed (so there are as many rounds as the longest chain of needs has calls);
    calls that no round can place are on a cycle, or after one: they keep their turn as level, marked cyclic.
    Needed ids that no call has are ignored. Order by (conv_id, level, turn).
    """
    calls = rows.where("role = 'call' and link <> 'repeated' and call_id is not null").select("_conv", "call_id", "turn", "needs")
    results = rows.where("role = 'result' and link = 'linked'").select("_conv", "call_id", F.col("turn").alias("result_turn"))
    base = calls.join(results, ["_conv", "call_id"], "left").select("_conv", "call_id", "turn", "result_turn", "needs").checkpoint()
    needs = base.select("_conv", "call_id", F.explode("needs").alias("need")).distinct().checkpoint()
    waiting = needs.join(base.select("_conv", F.col("call_id").alias("need")), ["_conv", "need"]).checkpoint()
    after = lambda level: F.greatest(level + 1, F.coalesce("result_turn", F.lit(-1 << 62)))
    done = base.join(waiting.select("_conv", "call_id").distinct(), ["_conv", "call_id"], "left_anti").select(
        "_conv", "call_id", F.col("turn").alias("level"), after(F.col("turn")).alias("result_level")
    ).checkpoint()
    todo = base.join(done.select("_conv", "call_id"), ["_conv", "call_id"], "left_anti").checkpoint()
    while not todo.isEmpty():  # one level of the needs a round; what is left without progress is cyclic
        met = waiting.join(todo.select("_conv", "call_id"), ["_conv", "call_id"]).join(
            done.select("_conv", F.col("call_id").alias("need"), "result_level"), ["_conv", "need"], "left"
        ).groupBy("_conv", "call_id").agg(F.max("result_level").alias("high"), F.count_if(F.col("result_level").isNull()).alias("open")).where("open = 0")
        level = F.greatest(F.col("turn"), F.col("high") + 1)
        ready = todo.join(met, ["_conv", "call_id"]).select("_conv", "call_id", level.alias("level"), after(level).alias("result_level")).checkpoint()
        if ready.isEmpty():
            break
        done = done.union(ready).checkpoint()
        todo = todo.join(ready.select("_conv", "call_id"), ["_conv", "call_id"], "left_anti").checkpoint()
    levels = done.withColumn("cyclic", F.lit(False)).union(
        todo.select("_conv", "call_id", "turn", after(F.col("turn")), F.lit(True))
    ).select("_conv", F.col("call_id").alias("_id"), "level", "result_level", "cyclic").checkpoint()
    linked_in = F.when(F.col("link").isin("answered", "unanswered", "linked"), F.col("call_id"))
    tool = F.coalesce(linked_in.isNotNull(), F.lit(False))
    names = [c for c in rows.columns if c != "_conv"]
    joined = rows.where(tool).withColumn("_id", linked_in).join(levels, ["_conv", "_id"])
    placed = joined.select(*names, F.when(F.col("role") == "call", F.col("level")).otherwise(F.col("result_level")).alias("level"), "cyclic")
    rest = rows.where(~tool).select(*names, F.col("turn").alias("level"), F.lit(False).alias("cyclic"))
    return placed.union(rest)


def formatted(messages: DataFrame, schemas: dict[str, dict[str, Any]]) -> DataFrame:
    """(conv_id, level, turn, role, call_id, link, call_turn, cyclic, problem, message), a row per message.

    message is canonical JSON; problem says how a call's arguments break its tool's schema (null
    if they do not). A conversation is read by ordering its rows by (level, turn); it is not
    gathered into one row, as one may hold any share of the table. Null bodies are JSON null. Extra columns are
    left out; repeated rows are `repeated` or stay as they are.
    """
    columns = ["conv_id", "level", "turn", "role", "call_id", "link", "call_turn", "cyclic"]
    rows = ordered(linked(messages.select("conv_id", "turn", "role", "call_id", "name", "body", "needs"))).select(*columns, "name", "body")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_serialised(schemas, *x) for x in zip(*(batch.column(c).to_pylist() for c in ("role", "call_id", "name", "body")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([p for _, p in made], pa.string()), pa.array([m for m, _ in made], pa.string())],
                names=[*columns, "problem", "message"],
            )

    return rows.mapInArrow(emit, "conv_id long, level long, turn long, role string, call_id string, link string, call_turn long, cyclic boolean, problem string, message string")


#: The one tool of `turns_as_calls`.
REPLY_SCHEMAS = {
    "reply": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """messages for `formatted` from (conv_id, turn, role, text): each user turn is a call of the tool
    `reply`, the assistant turn right after it the result with the call's id. Calls need
    the one of turn 0, if that is a call. Other turns are plain messages."""
    is_call, is_result = F.col("role") == "user", F.col("role") == "assistant"
    call_id = F.when(is_call, F.concat(F.lit("t"), F.col("turn"))).when(is_result, F.concat(F.lit("t"), F.col("turn") - 1))
    arguments = F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt")))
    return conversations.select(
        "conv_id", "turn", F.when(is_call, "call").when(is_result, "result").otherwise(F.col("role")).alias("role"), call_id.alias("call_id"),
        F.when(is_call, "reply").alias("name"), F.when(is_call, arguments).otherwise(F.col("text")).alias("body"),
        F.when(is_call & (F.col("turn") > 0), F.array(F.lit("t0"))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
