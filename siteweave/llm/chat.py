"""Chat formatting: tool calls joined to their results, ordered, checked, canonical.

Messages are parsed where they stand.  Calls and results become two slim
tables that are hash-joined on (conversation, call id).  Calls that name other
calls in their arguments are ordered by peeling and pointer doubling: in each
round the calls whose prerequisites are done get their level, and a call that
waits for one that itself waits for a single other looks past it, so a chain of
n calls takes log n rounds.  A message's place in its
conversation is a sort key made from its own turn, the turn of the call it
answers and its level, so no conversation is ever gathered in one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import small_batches, written

#: JSON schemas of the tools' arguments; a caller's own replace them.
SCHEMAS: dict[str, dict] = {
    "search": {
        "type": "object",
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}},
        "required": ["query"],
        "additionalProperties": False,
    },
    "fetch": {
        "type": "object",
        "properties": {"url": {"type": "string", "pattern": "^https?://"}, "timeout": {"type": "number", "minimum": 0}},
        "required": ["url"],
        "additionalProperties": False,
    },
    "calculate": {
        "type": "object",
        "properties": {"op": {"enum": ["add", "sub", "mul", "div"]}, "args": {"type": "array", "items": {}}},
        "required": ["op", "args"],
    },
}
#: An argument value of this form is the result of the call with that id.
REFERENCE = re.compile(r"^\$([A-Za-z0-9_.:-]+)$")
_SURROGATE = re.compile("[\ud800-\udfff]")
_CALL = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.DOTALL)
_RESULT = re.compile(r"<tool_response>\s*(.*?)\s*</tool_response>", re.DOTALL)


def _number(text: str):
    """A JSON number; whole ones lose their fraction and exponent."""
    value = Decimal(text)
    if not value.is_finite() or abs(value.adjusted()) > 300:
        raise ValueError(f"number out of range: {text[:40]}")
    return int(value) if value == value.to_integral_value() and abs(value) < 2**53 else float(value)


def _refuse(name: str):
    raise ValueError(f"not JSON: {name}")


def parsed(text: str):
    return json.loads(text, parse_float=_number, parse_constant=_refuse)


def _escaped(text: str) -> str:
    """Lone surrogates, which no encoding has, as their six-character escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Keys sorted by code point, no spare white space, whole numbers without fraction."""
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema; a reference to a result fits anything."""
    # an empty schema fits anything, however deep: recursion ends with the schema
    if not schema or isinstance(value, str) and REFERENCE.match(value):
        return []
    out = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_TYPES[k](value) for k in kinds):
            return [f"{at}: not of type {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the listed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the constant")
    if _TYPES["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{at}: below the minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{at}: above the maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            out.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: does not match the pattern")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: too few items")
        if "maxItems" in schema and len(value) > schema["maxItems"]:
            out.append(f"{at}: too many items")
        for i, item in enumerate(value):
            out += violations(item, schema.get("items", {}), f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            extra = schema.get("additionalProperties", True)
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif extra is False:
                out.append(f"{at}: {k} is not known")
            elif isinstance(extra, dict):
                out += violations(value[k], extra, f"{at}.{k}")
    return out


def _references(value) -> list[str]:
    found, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            m = REFERENCE.match(v)
            found += [m[1]] if m else []
        elif isinstance(v, dict):
            stack += v.values()
        elif isinstance(v, list):
            stack += v
    return found


def _one_call(raw, schemas: dict) -> dict:
    """Id, name, canonical arguments, references and errors of one call."""
    errors = []
    if not isinstance(raw, dict):
        raw, errors = {}, ["call: not an object"]
    inner = raw.get("function") if isinstance(raw.get("function"), dict) else raw
    name, arguments = inner.get("name"), inner.get("arguments", {})
    if isinstance(arguments, str):
        try:
            arguments = parsed(arguments)
        except (ValueError, RecursionError):
            errors.append("arguments: not JSON")
    call = raw.get("id")
    if call is None:
        errors.append("call: no id")
    if not isinstance(name, str) or name not in schemas:
        errors.append("call: unknown tool")
    elif not errors:
        errors += violations(arguments, schemas[name])
    return {
        "id": None if call is None else _name(call),
        "name": _escaped(name) if isinstance(name, str) else None,
        "arguments": canonical(arguments),
        "references": sorted(set(_references(arguments))),
        "errors": [_escaped(e) for e in errors],
    }


def _name(value) -> str:
    """A call id as text; ids that are no strings are named by their JSON."""
    return _escaped(value) if isinstance(value, str) else canonical(value)


def parse_message(role: str | None, text: str | None, schemas: dict) -> dict:
    """Content, calls and answered call of a message.

    Calls come as ``<tool_call>{...}</tool_call>`` blocks or as a JSON object
    with ``tool_calls``; results as a message of role tool with a JSON object
    that has ``tool_call_id``, or as a ``<tool_response>`` block of one.  A
    message nested too deep to be read is content, with a problem.
    """
    try:
        return _parsed_message(role, text, schemas) | {"problems": []}
    except RecursionError:
        message = canonical({"role": role, "content": text})
        return {"calls": [], "answers": None, "message": message, "problems": ["message: nested too deep"]}


def _parsed_message(role: str | None, text: str | None, schemas: dict) -> dict:
    text = text or ""
    calls, answers, content = [], None, text
    whole = None
    if text.lstrip()[:1] == "{":
        try:
            whole = parsed(text)
        except (ValueError, RecursionError):
            whole = None
    if isinstance(whole, dict) and isinstance(whole.get("tool_calls"), list):
        calls = [_one_call(c, schemas) for c in whole["tool_calls"]]
        content = whole.get("content") if isinstance(whole.get("content"), str) else ""
    elif isinstance(whole, dict) and whole.get("tool_call_id") is not None:
        answers = _name(whole["tool_call_id"])
        content = whole["content"] if isinstance(whole.get("content"), str) else canonical(whole.get("content"))
    elif "<tool_call>" in text:
        for m in _CALL.finditer(text):
            try:
                calls.append(_one_call(parsed(m[1]), schemas))
            except (ValueError, RecursionError):
                calls.append(_one_call(None, schemas) | {"errors": ["call: not JSON"]})
        content = _CALL.sub("", text).strip() if calls else text
    elif "<tool_response>" in text:
        m = _RESULT.search(text)
        try:
            found = parsed(m[1]) if m else None
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, dict) and found.get("tool_call_id") is not None:
            answers = _name(found["tool_call_id"])
            content = found["content"] if isinstance(found.get("content"), str) else canonical(found.get("content"))
    message: dict = {"role": role, "content": content}
    if calls:
        message["tool_calls"] = [{"id": c["id"], "name": c["name"], "arguments": json.loads(c["arguments"])} for c in calls]
    if answers is not None:
        message["tool_call_id"] = answers
    return {"calls": calls, "answers": answers, "message": canonical(message)}


_CALLS = "array<struct<id: string, name: string, arguments: string, references: array<string>, errors: array<string>>>"


def _parsed(conversations: DataFrame, schemas: dict) -> DataFrame:
    kind = pa.list_(
        pa.struct(
            [
                ("id", pa.string()),
                ("name", pa.string()),
                ("arguments", pa.string()),
                ("references", pa.list_(pa.string())),
                ("errors", pa.list_(pa.string())),
            ]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_message(r.as_py(), t.as_py(), schemas) for r, t in zip(batch.column("role"), batch.column("text"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("conv_id", "turn", "role")],
                    pa.array([f["calls"] for f in found], kind),
                    pa.array([f["answers"] for f in found], pa.string()),
                    pa.array([f["message"] for f in found], pa.string()),
                    pa.array([f["problems"] for f in found], pa.list_(pa.string())),
                ],
                ["conv_id", "turn", "role", "calls", "answers", "message", "problems"],
            )

    small_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    return rows.mapInArrow(run, f"conv_id long, turn long, role string, calls {_CALLS}, answers string, message string, problems array<string>")


def _levels(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """Level and place of each calling message: (conv_id, turn, level, place).

    ``needs`` has a row for each message and message it waits for: conv_id,
    turn, needed, result_turn.  Level is 0 without prerequisites, else one more
    than theirs, and null on or behind a cycle; place is the turn by which the
    message's own turn and all results it refers to are there.

    A waiting row says level(turn) >= level(needed) + add and place(turn) >=
    max(place(needed), floor); a message's level0 and place0 are the most that
    is known from rows already met.  If ``needed`` waits for one message only,
    the row is put past it, which doubles ``add`` along a chain.
    """
    key = ["conv_id", "turn"]
    floor = F.greatest("turn", F.coalesce("result_turn", "turn"))
    rows = written(needs.withColumn("floor", floor).groupBy(*key, "needed").agg(F.max("floor").alias("floor")).withColumn("add", F.lit(1).cast("long")))
    start = nodes.withColumns({"level0": F.lit(0).cast("long"), "place0": F.col("turn")})
    ended = lambda df: df.select(*key, F.col("level0").cast("int").alias("level"), F.col("place0").alias("place"))
    if rows.isEmpty():
        return ended(start)
    done = [written(ended(start.join(rows, key, "left_anti")))]
    known = written(start.join(rows, key, "left_semi"))
    while True:
        # what the last messages that got a level settle
        last = done[-1].select("conv_id", F.col("turn").alias("needed"), F.col("level").alias("n_level"), F.col("place").alias("n_place"))
        met = written(rows.join(last, ["conv_id", "needed"], "left"))
        gains = met.where("n_level is not null").select(*key, F.expr("n_level + add as level0"), F.greatest("n_place", "floor").alias("place0"))
        waiting = met.where("n_level is null").select(*key, "needed", "add", "floor")
        most = [F.max("level0").alias("level0"), F.max("place0").alias("place0")]
        known = written(known.unionByName(gains).groupBy(*key).agg(*most))
        ready = written(ended(known.join(waiting, key, "left_anti")))
        if ready.isEmpty():
            # what is left is on a cycle or behind one
            cyclic = known.select(*key, F.lit(None).cast("int").alias("level"), F.col("turn").alias("place"))
            done.append(cyclic)
            break
        done.append(ready)
        known = written(known.join(waiting, key, "left_semi"))
        if known.isEmpty():
            break
        single = waiting.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n"), F.max("needed").alias("past"), F.max("add").alias("past_add"), F.max("floor").alias("past_floor")
        )
        single = single.where("n = 1").join(known, key).withColumnRenamed("turn", "needed").drop("n")
        jumped = written(waiting.join(single, ["conv_id", "needed"], "left"))
        gains = jumped.where("past is not null").select(*key, F.expr("level0 + add as level0"), F.greatest("place0", "floor").alias("place0"))
        known = written(known.unionByName(gains).groupBy(*key).agg(*most))
        # around a cycle add only grows, far beyond any level
        add = F.least(F.col("add") + F.coalesce("past_add", F.lit(0)), F.lit(1 << 40))
        past = jumped.select(*key, F.coalesce("past", "needed").alias("needed"), add.alias("add"), F.greatest("floor", F.coalesce("past_floor", "floor")).alias("floor"))
        rows = written(past.groupBy(*key, "needed").agg(F.max("add").alias("add"), F.max("floor").alias("floor")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def format_chats(conversations: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row per message: its place in the conversation and its canonical JSON.

    Returns conv_id, turn, role, place_turn, place_level, place_step (sort by
    them for an order in which every result follows its call and every call
    what it refers to), n_calls, n_answered, answers (the id of the call that
    the message is the result of), linked (whether that call exists), errors
    (of arguments, schemas, duplicate ids, cycles and missing links, sorted and
    joined by "; ") and message.

    Edge cases: a null conv_id or turn links with nothing.  An id used by
    several calls of a conversation belongs to the earliest turn, the others
    have an error.  A result without call, and a call without result, stay and
    have an error.  Calls in a cycle keep their turn's place and have an error.
    Text that is no valid call is content, also if it is nested too deep to be
    read, which is an error.  Lone surrogates of JSON escapes, which no text can
    hold, stay escapes.  A null role is null in the JSON, a
    null text is an empty content.  Repeated rows are all returned.  An empty
    table gives no rows.  Other columns are ignored, whatever their names.
    """
    rows = written(_parsed(conversations, SCHEMAS if schemas is None else schemas))
    each = rows.where("size(calls) > 0 and conv_id is not null and turn is not null").select(
        "conv_id", "turn", F.explode("calls").alias("c")
    )
    each = written(each.where("c.id is not null").select("conv_id", "turn", F.col("c.id").alias("id"), F.col("c.references").alias("references")))
    calls = each.groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"), F.count_distinct("turn").alias("uses"), F.min_by("references", "turn").alias("references"))
    results = (
        rows.where("answers is not null and conv_id is not null")
        .groupBy("conv_id", F.col("answers").alias("id"))
        .agg(F.count(F.lit(1)).alias("results"), F.max("turn").alias("result_turn"))
    )
    linked = written(calls.join(results, ["conv_id", "id"], "left").withColumn("results", F.coalesce("results", F.lit(0))))
    needs = linked.select("conv_id", F.col("call_turn").alias("turn"), F.explode("references").alias("id")).join(
        linked.select("conv_id", "id", F.col("call_turn").alias("needed"), "result_turn"), ["conv_id", "id"]
    )
    levels = _levels(linked.select("conv_id", F.col("call_turn").alias("turn")).distinct(), written(needs.drop("id")))
    levels = written(levels.withColumnRenamed("turn", "call_turn"))
    known = written(linked.join(levels, ["conv_id", "call_turn"]))
    # what each message learns about its calls, and about the call it answers
    first = F.col("turn") == F.col("call_turn")
    said = F.array(
        F.when(~first, F.concat(F.lit("duplicate id "), "id")),
        F.when(first & (F.col("results") == 0), F.concat(F.lit("no result for "), "id")),
        F.when(first & F.col("level").isNull(), F.concat(F.lit("cycle at "), "id")),
    )
    own = (
        each.select("conv_id", "turn", "id").distinct()
        .join(known, ["conv_id", "id"])
        .groupBy("conv_id", "turn")
        .agg(
            F.sum(F.when(first & (F.col("results") > 0), 1).otherwise(0)).alias("n_answered"),
            F.max(F.when(first, F.col("level"))).alias("level"),
            F.max(F.when(first, F.col("place"))).alias("place"),
            F.flatten(F.collect_set(F.filter(said, lambda x: x.isNotNull()))).alias("link_errors"),
        )
    )
    asked = known.select("conv_id", F.col("id").alias("answers"), F.col("place").alias("call_place"), F.col("level").alias("call_level"))
    none = F.array().cast("array<string>")
    place = F.greatest("turn", "place", "call_place")
    # only messages that take part in tool use are joined, the others are as they are
    part = F.col("answers").isNotNull() | (F.size("calls") > 0)
    used = rows.where(part).join(own, ["conv_id", "turn"], "left").join(asked, ["conv_id", "answers"], "left")
    plain = rows.where(~part)
    for name, kind in (("n_answered", "long"), ("level", "int"), ("place", "long"), ("link_errors", "array<string>"), ("call_place", "long"), ("call_level", "int")):
        plain = plain.withColumn(name, F.lit(None).cast(kind))
    parse_errors = F.flatten(F.transform("calls", lambda c: c["errors"]))
    lost = F.when(F.col("answers").isNotNull() & F.col("call_place").isNull(), F.array(F.concat(F.lit("no call for "), "answers"))).otherwise(none)
    return used.unionByName(plain).select(
        "conv_id",
        "turn",
        "role",
        place.alias("place_turn"),
        F.coalesce("level", "call_level", F.lit(0)).cast("long").alias("place_level"),
        F.when(F.col("answers").isNotNull(), 1).otherwise(0).cast("long").alias("place_step"),
        F.size("calls").cast("long").alias("n_calls"),
        F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"),
        "answers",
        F.when(F.col("answers").isNotNull(), F.col("call_place").isNotNull()).alias("linked"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("problems", parse_errors, F.coalesce("link_errors", none), lost))), "; ").alias("errors"),
        "message",
    )
