"""Chat formatting: tool calls linked with their results.

Calls and results are joined by a hash of conversation and identifier, ordered
topologically (a call comes after the calls whose results it has seen; chains are
contracted by pointer doubling, so that a conversation of any length takes a
logarithmic number of joins and never meets in one task, and calls that wait for
several are settled in rounds), their arguments validated against
the tools' schemas, and written as canonical JSON: keys sorted, no blanks, one
line for each call or other message.

Messages: a text that is a JSON object with "tool_calls" holds calls (id, name,
arguments, after: an identifier or a list of them), one with "tool_call_id" a
result.  In plain conversations a
user's turn is a call of the tool "reply", and the assistant's next turn its
result.

Defined results: wholly equal rows count once, and every distinct message has a
line or is the result in one; where one turn has several texts, the smallest
role is the one that neighbours see; a null conversation is one of its own;
null texts are empty; a text that is no strict JSON (NaN, infinities, too deep)
is plain; names and identifiers that are no strings are written as JSON, and
lone surrogates become U+FFFD; a call without result is "unanswered", a result without
call "orphan", other messages "message"; of several calls or several results
with one identifier the first by turn, part and content is linked, and the
others are "repeated", with lines of their own and without depth; calls without
identifier are "unanswered" and have no depth, as are calls that are no objects,
whose arguments are what they are; calls that wait for each other are "cyclic"
and have no depth; arguments that are not JSON
are invalid; tables without rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: The schema of the tool that plain conversations call.
SCHEMAS = {
    "reply": {
        "type": "object",
        "required": ["text"],
        "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What a JSON value breaks of a schema (type, enum, bounds, lengths, items, required and further properties)."""
    kind = schema.get("type")
    if kind == "integer":
        fits = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    elif kind == "number":
        fits = isinstance(value, (int, float)) and not isinstance(value, bool)
    else:
        fits = kind is None or isinstance(value, _TYPES[kind])
    if not fits:
        return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf) or value > schema.get("maximum", math.inf):
            found.append(f"{at}: out of bounds")
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        found.append(f"{at}: length")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += violations(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                found += violations(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: not known")
    return found


def whole(text: str) -> str:
    """The text, with U+FFFD for halves of characters that JSON escapes can leave."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(value) -> str:
    """Keys sorted, no blanks; ValueError where JSON has no form for the value."""
    return whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _never(name: str):
    raise ValueError(f"{name} is not JSON")


def strict(text: str):
    """The value of a JSON text without NaN and infinities, and not so deep that it could not be written again."""
    value = json.loads(text, parse_constant=_never)
    canonical(value)
    return value


#: What makes a text or value no strict JSON.
ODD = (ValueError, TypeError, AttributeError, KeyError, RecursionError)


def named(value) -> str | None:
    """An identifier or name as a string."""
    return value if value is None else whole(value) if isinstance(value, str) else canonical(value)


EVENTS = "conv_id long, turn long, part int, kind string, call_id string, tool string, arguments string, after array<string>, output string, role string, message long"


def events(messages: DataFrame) -> DataFrame:
    """EVENTS: a row for each call, result or other message of conversations (conv_id, turn, role, text)."""
    once = messages.select("conv_id", "turn", "role", "text").distinct()
    once = once.withColumn("message", F.xxhash64("role", F.col("text").isNull(), "text"))
    light = messages.where("turn is not null").groupBy("conv_id", "turn").agg(F.min(F.struct("role")).alias("m")).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("m.role").alias("role_before"))
    one = once.where("turn is not null").join(light, F.col("conv_id").eqNullSafe(F.col("c")) & (F.try_subtract("turn", F.lit(1)) == F.col("t")), "left").drop("c", "t")
    two = light.withColumnRenamed("role_before", "role_before2")
    both = one.join(two, F.col("conv_id").eqNullSafe(F.col("c")) & (F.try_subtract("turn", F.lit(2)) == F.col("t")), "left").select("conv_id", "turn", "role", "text", "role_before", "role_before2", "message")
    # rows without a turn have no neighbours and are not joined, as they would all meet in one task
    both = both.unionByName(once.where("turn is null").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("role_before"), F.lit(None).cast("string").alias("role_before2"), "message"))

    def rows(conv, turn, role, text, before, before2) -> Iterator[tuple]:
        text = text or ""
        # keys can be written with escapes
        if text.lstrip(" \t\n\r").startswith("{") and ('"tool_call' in text or "\\u" in text):
            found = []
            try:
                got = strict(text)
                if isinstance(got.get("tool_calls"), list):
                    for i, c in enumerate(got["tool_calls"]):
                        if not isinstance(c, dict):
                            found.append((conv, turn, i, "call", None, None, canonical(c), [], None, role))
                            continue
                        after = c.get("after")
                        after = after if isinstance(after, list) else [] if after is None else [after]
                        found.append((conv, turn, i, "call", named(c.get("id")), named(c.get("name")), named(c.get("arguments")) or "null", sorted({named(x) or "null" for x in after}), None, role))
                elif "tool_call_id" in got:
                    found.append((conv, turn, 0, "result", named(got["tool_call_id"]), None, None, None, named(got.get("content")) or "", role))
            except ODD:
                found = []
            if found:
                yield from found
                return
        if role == "user" and turn is not None:
            after = [f"turn-{turn - 2}"] if before == "assistant" and before2 == "user" else []
            yield conv, turn, 0, "call", f"turn-{turn}", "reply", canonical({"text": text, "turn": turn}), after, None, role
        elif role == "assistant" and turn is not None and before == "user":
            yield conv, turn, 0, "result", f"turn-{turn - 1}", None, None, None, text, role
        elif role == "assistant":
            yield conv, turn, 0, "result", None, None, None, None, text, role
        else:
            yield conv, turn, 0, "message", None, None, None, None, text, role

    names = [x.split()[0] for x in EVENTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), *[pa.string()] * 2, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(*r, message) for *row, message in zip(*(c.to_pylist() for c in batch.columns)) for r in rows(*row)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), types)], names)

    return both.mapInArrow(run, EVENTS)


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth: the most calls in a row that come before each call (null: in or behind a cycle), from columns conv_id, call_id, after (a list).

    A call that waits for one other points to it; doubling brings every pointer
    to a call that waits for none, or for several.  Those are settled in rounds,
    as many as there are of them in a row.
    """
    wide = F.coalesce("conv_id", F.lit(0)), F.col("conv_id").isNull()
    nodes = calls.select(F.sha2(F.concat_ws(":", *wide, "call_id"), 256).alias("k"), "conv_id", "call_id", "after")
    keys = nodes.select("k")
    waits = nodes.select("k", "conv_id", F.explode("after").alias("other")).select("k", F.sha2(F.concat_ws(":", *wide, "other"), 256).alias("after")).distinct()
    waits = C.stored(waits.join(keys.withColumnRenamed("k", "after"), "after").select("k", "after"), "waits")
    counted = waits.groupBy("k").agg(F.count("*").alias("n"), F.min("after").alias("after"))
    at = C.stored(keys.join(counted, "k", "left").select("k", F.when(F.col("n") == 1, F.col("after")).alias("after"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("depth"), F.when(F.col("n") == 1, F.col("after")).otherwise(F.col("k")).alias("end"), (F.coalesce("n", F.lit(0)) > 1).alias("several")), "depths")
    total, left, several = at.agg(F.count("*"), F.count("after"), F.count(F.when(F.col("several"), 1))).first()
    for _ in range(math.ceil(math.log2(total + 1)) + 2):
        if not left:
            break
        there = at.select(F.col("k").alias("after"), F.col("after").alias("next"), F.col("depth").alias("more"), F.col("end").alias("last"))
        # only calls that still point somewhere are joined
        moved = at.where("after is not null").join(there, "after").select("k", F.col("next").alias("after"), (F.col("depth") + F.col("more")).alias("depth"), F.col("last").alias("end"), "several")
        past, at = at, C.stored(at.where("after is null").unionByName(moved), "depths")
        C.discard(past)
        left = at.where("after is not null").count()
    ends = at.where("after is null")
    known = ends.where("end = k and not several").select(F.col("k").alias("end"), F.lit(0).cast("long").alias("start"))
    if several:
        begins = ends.select(F.col("k").alias("after"), "end", "depth")
        # what each call that waits for several waits for; null ends are behind a cycle
        open_ = C.stored(waits.join(at.where("several").select("k"), "k").join(begins, "after", "left").select("k", "end", "depth"), "open")
        known = C.stored(known, "known")
        while True:
            settled = open_.join(known, "end", "left").groupBy("k").agg(F.max(F.col("start").isNull()).alias("waits"), F.max(F.col("start") + F.col("depth") + 1).alias("start")).where("not waits").select(F.col("k").alias("end"), "start")
            settled = C.stored(settled, "settled")
            if not settled.count():
                break
            known = C.stored(known.unionByName(settled), "known")
            open_ = C.stored(open_.join(settled.select(F.col("end").alias("k")), "k", "left_anti"), "open")
    found = ends.join(known, "end").select("k", (F.col("depth") + F.col("start")).alias("depth"))
    return nodes.join(found, "k", "left").select("conv_id", "call_id", "depth")


def link(found: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conv_id, turn, part, call_id, status, depth, valid, errors, line: one row for each call, orphan or repeated result, or other message."""
    spark = found.sparkSession
    called = found.where("kind in ('call', 'result') and call_id is not null")
    order = F.struct("turn", "part", "tool", "arguments", "after", "output", "role", "message")
    first = C.stored(called.groupBy("conv_id", "kind", "call_id").agg(F.min(order).alias("x"), F.count("*").alias("n")), "first")
    calls = first.where("kind = 'call'").select("conv_id", "call_id", "x.*")
    results = first.where("kind = 'result'").select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("x").alias("r"))
    same = F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri"))
    depth = depths(calls).select(F.col("conv_id").alias("dc"), F.col("call_id").alias("di"), "depth")
    full = calls.join(results.hint("shuffle_hash"), same, "left").join(depth, F.col("conv_id").eqNullSafe(F.col("dc")) & (F.col("call_id") == F.col("di")))
    linked = full.select("conv_id", "turn", "part", "call_id", F.when(F.col("depth").isNull(), "cyclic").when(F.col("r").isNull(), "unanswered").otherwise("linked").alias("status"), "depth", "tool", "arguments", F.col("r.output").alias("output"), "role")
    orphans = results.join(calls.select("conv_id", "call_id"), same, "left_anti").select(F.col("rc").alias("conv_id"), "r.turn", "r.part", F.col("ri").alias("call_id"), F.lit("orphan").alias("status"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("tool"), F.lit(None).cast("string").alias("arguments"), "r.output", "r.role")
    # only identifiers that occur more than once are joined with their messages
    several = first.where("n > 1").select(F.col("conv_id").alias("sc"), F.col("kind").alias("sk"), F.col("call_id").alias("si"), "x")
    again = called.join(several, F.col("conv_id").eqNullSafe(F.col("sc")) & (F.col("kind") == F.col("sk")) & (F.col("call_id") == F.col("si"))).where(~order.eqNullSafe(F.col("x")))
    again = again.select("conv_id", "turn", "part", "call_id", F.lit("repeated").alias("status"), F.lit(None).cast("long").alias("depth"), "tool", "arguments", "output", "role")
    # what has no identifier is linked with nothing, and not joined, as it would all meet in one task
    alone = F.when(F.col("kind") == "message", "message").when(F.col("kind") == "call", "unanswered").otherwise("orphan")
    rest = found.where("kind = 'message' or call_id is null").select("conv_id", "turn", "part", "call_id", alone.alias("status"), F.lit(None).cast("long").alias("depth"), "tool", "arguments", "output", "role")
    every = linked.unionByName(orphans).unionByName(again).unionByName(rest)
    shared = spark.sparkContext.broadcast(schemas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, lines = [], [], []
            for conv, turn, part, call, status, depth, tool, arguments, output, role in zip(*(c.to_pylist() for c in batch.columns)):
                line: dict = {"conversation": conv, "turn": turn, "status": status, "role": role}
                wrong = None
                if arguments is not None or tool is not None:
                    schema = shared.value.get(tool)
                    try:
                        value = strict(arguments)
                        wrong = ["$: no such tool"] if schema is None else violations(value, schema)
                    except ODD:
                        value, wrong = arguments, ["$: not JSON"]
                    line |= {"call": {"id": call, "name": tool, "arguments": value}, "depth": depth}
                elif call is not None:
                    line["call"] = {"id": call}
                if output is not None:
                    line["content"] = output
                valid.append(None if wrong is None else not wrong)
                errors.append(whole("; ".join(wrong or [])))
                lines.append(canonical(line))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "part", "call_id", "status", "depth")), pa.array(valid, pa.bool_()), pa.array(errors), pa.array(lines)], ["conv_id", "turn", "part", "call_id", "status", "depth", "valid", "errors", "line"])

    return every.mapInArrow(run, "conv_id long, turn long, part int, call_id string, status string, depth long, valid boolean, errors string, line string")


def format_chats(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    return link(C.stored(events(messages), "events"), schemas)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(C.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
