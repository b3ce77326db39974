"""Tool calls in conversations: linked to their results, ordered, validated and serialised."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spikeloom.llm.graph import settled
from spikeloom.llm.mixing import running
from spikeloom.operators.ordered import in_order

#: Levels, and turns, that are summed up or ordered in one task.
STRETCH = 1024
KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
HALF = re.compile("[\ud800-\udfff]")


def whole(text: str) -> str:
    """Text with the halves of letters that stand alone written as escapes."""
    return HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """JSON with keys in code point order, no white space and unescaped letters; a half letter stays an escape."""
    return whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def parsed(text: str):
    """The value of a JSON text; NaN and infinities are no JSON."""

    def refused(name: str):
        raise ValueError(f"{name} is no JSON")

    return json.loads(text, parse_constant=refused)


def is_a(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int | float if kind == "number" else int) and not isinstance(value, bool)
    return isinstance(value, KINDS[kind])


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """What of ``value`` breaks ``schema`` (type, enum, bounds, required, properties, items), by path.

    ``type`` is one name or a list of names; a name that JSON has no type for is a fault of the schema.
    """
    if not isinstance(schema, dict):
        return [] if schema is True else [f"{at}: schema allows nothing" if schema is False else f"{at}: schema is no object"]
    kind = schema.get("type")
    kinds = kind if isinstance(kind, list) else [] if kind is None else [kind]
    if strange := [k for k in kinds if not isinstance(k, str) or k not in (*KINDS, "integer", "number")]:
        return [f"{at}: schema has the unknown type {canonical(strange[0])}"]
    if kinds and not any(is_a(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, int | float) and not isinstance(value, bool):
        found += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        found += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in faults(v, schema["items"], f"{at}[{i}]")]
    return found


def checked(arguments: str | None, schema: str | None) -> tuple[object, list[str]]:
    """(value, errors) of a call's arguments; the value is null where they can't be read or written again."""
    try:
        value = None if arguments is None else parsed(arguments)
        canonical(value)
    except RecursionError:
        return None, ["arguments are nested too deep"]
    except ValueError:
        return None, ["arguments are not JSON"]
    if schema is None:
        return value, ["no schema"]
    try:
        return value, faults(value, parsed(schema))
    except RecursionError:
        return None, ["arguments are nested too deep"]
    except ValueError:
        return value, ["schema is not JSON"]


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 without known predecessors, else one more than the highest of them.

    A call with one predecessor finds its way back to the first call that has none or several by
    pointer doubling, so the rounds grow with the logarithm of a chain.  Kahn's rounds then place the
    calls with several predecessors, as many as the most of these on one path.  Calls on or behind a
    cycle get no row.
    """
    key = ["conv_id", "call_id"]
    one = settled(calls.groupBy(*key).agg(F.flatten(F.collect_set("after")).alias("after")))
    need = one.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("on"))
    need = settled(need.join(one.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi"))
    back = one.select(*key).join(need.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("on").alias("on")), key, "left")
    lone = F.coalesce(F.col("n") == 1, F.lit(False))
    back = settled(back.select(*key, F.when(lone, F.col("on")).otherwise(F.col("call_id")).alias("to"), lone.cast("long").alias("far"), (~lone).alias("ended"), F.coalesce("n", F.lit(0)).alias("open")))
    # A chain is shorter than its conversation; what hasn't ended after these rounds runs in a cycle.
    most = one.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length()):
        if back.where(~F.col("ended")).isEmpty():
            break
        step = back.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("ended").alias("_ended"))
        step = back.where(~F.col("ended")).join(step, ["conv_id", "to"]).select(*key, F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_ended").alias("ended"), "open")
        back = settled(back.where("ended").union(step))
    back = back.where("ended")

    ends = back.where(F.col("call_id") == F.col("to"))
    waiting = ends.select(*key, "open", F.lit(0).cast("long").alias("level"))
    forks = need.join(ends.where(F.col("open") > 1).select(*key), key, "left_semi")
    # An edge from a call behind a cycle isn't among these, so it is never taken off.
    forks = settled(forks.join(back.select("conv_id", F.col("call_id").alias("on"), "to", "far"), ["conv_id", "on"]).select(*key, "to", "far"))
    done = None
    while True:
        ready = waiting.where(F.col("open") == 0).select(*key, "level")
        done = ready if done is None else done.union(ready)
        waiting = waiting.where(F.col("open") > 0)
        if ready.isEmpty() or waiting.isEmpty():
            break
        freed = forks.join(ready.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("_level")), ["conv_id", "to"])
        freed = freed.groupBy(*key).agg(F.count(F.lit(1)).alias("_got"), F.max(F.col("_level") + F.col("far") + 1).alias("_level"))
        waiting = settled(waiting.join(freed, key, "left").select(*key, (F.col("open") - F.coalesce("_got", F.lit(0))).alias("open"), F.greatest("level", "_level").alias("level")))
    out = back.join(done.select("conv_id", F.col("call_id").alias("to"), "level"), ["conv_id", "to"])
    return out.select(*key, (F.col("level") + F.col("far")).cast("int").alias("level"))


def places(order: DataFrame) -> DataFrame:
    """``levels`` with ``place``, the position in the conversation by level, then identifier.

    Calls are ranked within their level; the sizes of the levels are summed by stretches of STRETCH
    levels, so neither a wide level nor a long chain is all of a conversation in one task.
    """
    sizes = order.groupBy("conv_id", "level").agg(F.count(F.lit(1)).alias("_n"))
    before = running(sizes, "conv_id", ["level"], F.col("_n"), "_start", F.floor(F.col("level") / STRETCH).cast("long")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("conv_id", "level").orderBy("call_id"))
    out = order.withColumn("_rank", rank).join(before, ["conv_id", "level"])
    return out.select("conv_id", "call_id", "level", (F.col("_start") + F.col("_rank") - 1).alias("place"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Every call with its results in topological order, validated, as canonical JSON.

    ``calls(conv_id, call_id, name, arguments, after)``: arguments is JSON, after the identifiers it
    depends on (unknown ones don't count); ``results(conv_id, call_id, content)``; ``schemas(name,
    schema)``, one JSON schema a name.  Calls and results meet by hash-join on the identifier.

    Returns conv_id, call_id, level, place (position in its conversation by level, then identifier;
    both null on or behind a cycle), n_results, valid, errors and record.  A call without result has
    n_results 0 and null content in its record; several results are an array in code point order.
    Arguments that are null, not JSON (NaN and infinities, or numbers beyond doubles, are not) or nested deeper
    than the reader goes, and names without a readable schema, are invalid with an error that says so.  Results without a call give a row with an error and no level.  Repeated calls are one
    row (the least of name and arguments); a null conv_id or call_id gives no row.
    """
    key = ["conv_id", "call_id"]
    has = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(has).groupBy(*key).agg(F.min(F.struct("name", "arguments")).alias("call"))
    got = results.where(has).groupBy(*key).agg(F.sort_array(F.collect_list("content")).alias("content"))
    order = levels(calls.where(has).select(*key, F.coalesce("after", F.array().cast("array<string>")).alias("after")))
    rows = one.join(got, key, "full").join(places(settled(order)), key, "left").withColumn("name", F.col("call.name")).join(schemas, "name", "left")
    rows = rows.select(*key, "level", "place", "name", F.col("call.arguments").alias("arguments"), F.col("call").isNotNull().alias("called"), "content", "schema")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r in b.select(["conv_id", "call_id", "name", "arguments", "called", "content", "schema"]).to_pylist():
                wrong, value = [], None
                if not r["called"]:
                    wrong.append("result without call")
                else:
                    value, wrong = checked(r["arguments"], r["schema"])
                content = r["content"] or []
                record = {"arguments": value, "conversation": r["conv_id"], "id": r["call_id"], "name": r["name"], "result": content[0] if len(content) == 1 else content or None}
                made.append((len(content), not wrong, wrong, canonical(record)))
            n, valid, errors, record = zip(*made) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("conv_id", "call_id", "level", "place")), pa.array(n, pa.int64()), pa.array(valid, pa.bool_()), pa.array([[whole(x) for x in e] for e in errors], pa.list_(pa.string())), pa.array(record, pa.string())],
                ["conv_id", "call_id", "level", "place", "n_results", "valid", "errors", "record"],
            )

    kind = dict(rows.dtypes)
    return rows.mapInArrow(task, f"conv_id {kind['conv_id']}, call_id string, level int, place {kind['place']}, n_results long, valid boolean, errors array<string>, record string")


#: Schemas of the calls that ``from_turns`` makes.
SCHEMAS = {
    "ask": {"type": "object", "required": ["text", "words"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1, "maxLength": 1000}, "words": {"type": "integer", "minimum": 1}}},
    "configure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}},
}


def from_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from ``conversations(conv_id, turn, role, text)``.

    User and system turns call ``ask`` and ``configure``; an assistant turn is the result of the turn
    before it.  A call depends on the call before it in its conversation, by turn; calls of one turn
    on the same one.
    """
    at = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.col("text"))
    ask = at.where(F.col("role").isin("user", "system"))
    call_id = lambda t: F.lpad(t.cast("string"), 12, "0")
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    args = F.when(F.col("role") == "user", F.to_json(F.struct("text", words.alias("words")))).otherwise(F.to_json(F.struct("text")))
    turns = ask.select("conv_id", "turn").where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).distinct()
    ask = ask.join(in_order(turns, ["conv_id"], "turn", STRETCH, lag={"before": "turn"}), ["conv_id", "turn"], "left")
    after = F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array(call_id(F.col("before"))))
    name = F.when(F.col("role") == "user", "ask").otherwise("configure")
    calls = ask.select("conv_id", call_id(F.col("turn")).alias("call_id"), name.alias("name"), args.alias("arguments"), after.alias("after"))
    results = at.where(F.col("role") == "assistant").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results
