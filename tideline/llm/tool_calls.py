"""Chat formatting with tool-call linking (operator 10).

Messages hold turns, calls (identifier, tool, arguments, the call they wait for) and results (identifier of their call). Results are hash-joined to
calls by (conversation, identifier); calls are ordered topologically by joins (chains by pointer doubling, meeting chains round by round), so a
conversation of any length is never gathered in one task; arguments are checked against the tools' schemas and every message becomes one line of canonical JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tideline.llm.tables import stored

TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with keys sorted by code point, no blanks, no escapes beyond the needed ones, numbers as Python's shortest form; not-a-number is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def is_a(value: object, kind: str) -> bool:
    """Whether a JSON value has a schema type; truth values are no numbers, and a number without a fraction is an integer."""
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, TYPES[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def same(a: object, b: object) -> bool:
    """Equality of JSON values: ``true`` is not ``1``, but ``1.0`` is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def violations(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``: type (one or a list), enum, required, properties, additionalProperties, items, minimum, maximum, minLength, maxLength."""
    out: list[str] = []
    kinds = schema.get("type") or []
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_a(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * ("maxLength" in schema and len(value) > schema["maxLength"])
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def check_arguments(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, str]:
    """(canonical arguments or null, ``ok`` or what is wrong). Escapes that make no character (lone surrogates) and nesting too deep to read count as no JSON."""
    if name not in schemas:
        return None, "unknown tool"
    try:
        value = json.loads(arguments or "", parse_constant=_refuse)
        text = canonical(value)
        text.encode()
        return text, "; ".join(violations(value, schemas[name])) or "ok"
    except (ValueError, RecursionError):
        return None, "arguments are not JSON"


def chains(now: DataFrame, rounds: int) -> DataFrame:
    """Pointers (conv, call, up, depth, peak) moved to the end of their chain: doubled, so a chain of n calls takes log2(n) rounds. Those on a circle keep one."""
    total, reach = now.where("up is not null").count(), 1
    for _ in range(rounds):
        if total == 0 or reach > 2 * total:
            break
        above = now.select("conv", F.col("call").alias("up"), F.col("up").alias("next"), F.col("root").alias("end"), F.col("depth").alias("more"), F.col("peak").alias("high"))
        moved = now.where("up is not null").join(above, ["conv", "up"])
        # of an end only its peak is taken: the pointer's own step already counts it
        moved = moved.select("conv", "call", F.col("next").alias("up"), F.col("end").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.greatest("peak", "high").alias("peak"))
        now = stored(moved.unionByName(now.where("up is null")), "chains")
        reach *= 2
        if now.where("up is not null").isEmpty():
            break
    return now


def ordered(calls: DataFrame, rounds: int = 64) -> DataFrame:
    """(conv, call, depth, peak) from (conv, call, after, turn): the longest way of waiting behind a call, and the last turn of it and all it waits for.

    ``after`` is an array of calls; unknown ones and repeats count for nothing. Both results are null on a circle and behind one. Calls that wait for one call form chains, which are
    contracted by pointer doubling; those that wait for several settle round by round once all they wait for have, so there are as many rounds as such calls
    stand one behind the other. Sorting by (peak, depth) puts every call behind all it waits for.
    """
    known = calls.select("conv", F.col("call").alias("before"))
    edges = stored(calls.select("conv", "call", F.explode("after").alias("before")).distinct().join(known, ["conv", "before"]), "waits")
    counts = edges.groupBy("conv", "call").agg(F.count(F.lit(1)).alias("n"), F.min("before").alias("one"))
    base = stored(calls.select("conv", "call", "turn").join(counts, ["conv", "call"], "left"), "calls-waiting")
    alone = F.col("n") == 1
    start = base.select("conv", "call", F.when(alone, F.col("one")).alias("up"), F.col("call").alias("root"), F.when(alone, 1).otherwise(0).cast("bigint").alias("depth"), F.col("turn").alias("peak"))
    # where each call's chain ends, how far, and the last turn on the way, the end's own included
    ends = chains(stored(start, "chains"), rounds).where("up is null").select("conv", "call", "root", F.col("depth").alias("far"), F.col("peak").alias("high"))
    ends = stored(ends, "chain-ends")
    several = stored(base.where("n > 1").select("conv", "call", "n", "turn"), "meeting")
    settled = stored(base.where("n is null").select("conv", "call", F.lit(0).cast("bigint").alias("depth"), F.col("turn").alias("peak")), "settled")
    if not several.isEmpty():
        ways = edges.join(several.select("conv", "call"), ["conv", "call"], "left_semi").join(ends.withColumnRenamed("call", "before"), ["conv", "before"])
        ways = stored(ways.select("conv", "call", "root", "far", "high"), "ways")
        while True:
            open_ = ways.join(settled.select("conv", "call"), ["conv", "call"], "left_anti")
            there = open_.join(settled.select("conv", F.col("call").alias("root"), "depth", "peak"), ["conv", "root"])
            new = there.groupBy("conv", "call").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("depth") + F.col("far") + 1).alias("depth"), F.max(F.greatest("peak", "high")).alias("peak"))
            new = new.join(several, ["conv", "call"]).where("m = n").select("conv", "call", "depth", F.greatest("peak", "turn").alias("peak"))
            new = stored(new, "newly-settled")
            if new.isEmpty():
                break
            settled = stored(settled.unionByName(new), "settled")
    of = settled.select("conv", F.col("call").alias("root"), "depth", F.col("peak").alias("above"))
    found = ends.join(of, ["conv", "root"]).select("conv", "call", (F.col("depth") + F.col("far")).alias("depth"), F.greatest("above", "high").alias("peak"))
    return calls.select("conv", "call").join(found, ["conv", "call"], "left")


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per message: conv, turn, ``kind``, ``call``, ``status``, ``depth``, ``place`` (array to sort a conversation by) and ``json``.

    ``messages`` has conv, turn, role, text, call, tool, arguments, after (a call or an array of calls), result_of; a row with ``call`` is a call, one with ``result_of`` a result, others
    are text. Status: ``ok``; of calls what is wrong with their arguments, ``no result``, ``cycle`` or ``repeated`` (only an identifier's first
    row, by turn then JSON, is its call); of results ``orphan``, or ``repeated`` for all but a call's first result. A call is placed after the calls it waits for, a result behind its call, text at its
    turn; nulls of any column serialise as null, null conversations or identifiers never link. Empty tables are fine; other columns are ignored.
    """
    cols = ["conv", "turn", "role", "text", "call", "tool", "arguments", "after", "result_of"]
    if isinstance(messages.schema["after"].dataType, StringType):
        messages = messages.withColumn("after", F.when(F.col("after").isNotNull(), F.array("after")))
    rows = messages.select(*cols).withColumn("kind", F.when(F.col("call").isNotNull(), "call").when(F.col("result_of").isNotNull(), "result").otherwise("text"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            args, state = [], []
            for kind, tool, raw in zip(*(batch.column(c).to_pylist() for c in ("kind", "tool", "arguments"))):
                value, said = check_arguments(tool, raw, schemas) if kind == "call" else (None, "ok")
                args.append(value)
                state.append(said)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(args, pa.string()), pa.array(state, pa.string())], names=[*batch.schema.names, "args", "state"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "args string, state string"])
    checked = rows.mapInArrow(prepare, schema).withColumn("key", F.struct(F.coalesce("turn", F.lit(1 << 62)).alias("t"), F.xxhash64("role", "text", "tool", "arguments", F.array_join("after", "\x00", "\x01")).alias("h")))
    checked = stored(checked, "messages")
    calls = checked.where("kind = 'call'").groupBy("conv", "call").agg(F.min(F.struct("key", "after")).alias("m")).select("conv", "call", F.col("m.key").alias("ckey"), F.col("m.after").alias("after"))
    calls = stored(calls.where("conv is not null"), "calls")
    depth = ordered(calls.select("conv", "call", "after", F.col("ckey.t").alias("turn")))
    results = checked.where("kind = 'result'").groupBy("conv", F.col("result_of").alias("call")).agg(F.min("key").alias("rkey"))
    linked = calls.join(depth, ["conv", "call"]).join(results, ["conv", "call"], "left")
    linked = stored(linked.select("conv", F.col("call").alias("id"), "ckey", "rkey", "depth", "peak"), "linked")
    joined = checked.withColumn("id", F.coalesce("call", "result_of")).join(linked, ["conv", "id"], "left")
    status = (
        F.when(F.col("kind") == "text", "ok")
        .when((F.col("kind") == "result") & F.col("ckey").isNull(), "orphan").when((F.col("kind") == "result") & (F.col("rkey") != F.col("key")), "repeated").when(F.col("kind") == "result", "ok")
        .when(F.col("ckey").isNull(), "no conversation").when(F.col("ckey") != F.col("key"), "repeated").when(F.col("depth").isNull(), "cycle")
        .when(F.col("state") != "ok", F.col("state")).when(F.col("rkey").isNull(), "no result").otherwise("ok")
    )
    own = F.coalesce("turn", F.lit(1 << 62)).cast("bigint")
    turn = F.coalesce(F.col("peak").cast("bigint"), own)
    place = F.array(turn, F.coalesce("depth", F.lit(-1)).cast("bigint"), F.when(F.col("kind") == "result", 1).otherwise(0).cast("bigint"), own)
    shown = joined.select("conv", "turn", "kind", "id", "role", "text", "tool", "args", "arguments", "after", status.alias("status"), F.when(F.col("kind") != "text", F.col("depth")).alias("depth"), place.alias("place"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.to_pylist():
                if m["kind"] == "call":
                    known = m["args"]
                    body = {"role": m["role"], "content": m["text"], "tool_call": {"id": m["id"], "name": m["tool"], "arguments": json.loads(known) if known is not None else m["arguments"], "after": m["after"][0] if m["after"] and len(m["after"]) == 1 else m["after"]}}
                elif m["kind"] == "result":
                    body = {"role": m["role"], "content": m["text"], "tool_call_id": m["id"]}
                else:
                    body = {"role": m["role"], "content": m["text"]}
                out.append(canonical(body))
            names = ["conv", "turn", "kind", "id", "status", "depth", "place"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "json"])

    kinds = {f.name: f.dataType.simpleString() for f in shown.schema.fields}
    return shown.mapInArrow(write, ", ".join(f"{c} {kinds[c]}" for c in ("conv", "turn", "kind", "id", "status", "depth", "place")) + ", json string").withColumnRenamed("id", "call")
