"""Chat formatting: tool calls are linked with their results, put in order, validated and serialised."""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, written

TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int,
}
#: Words of JSON Schema that are understood, and those that say nothing about a value. Others are refused.
KNOWN = {
    "type", "enum", "const", "anyOf", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength",
    "pattern", "items", "minItems", "maxItems", "properties", "required", "additionalProperties",
}
SILENT = {"$schema", "$id", "title", "description", "default", "examples"}
#: Arguments that are nested deeper are not valid, and are left out.
DEEPEST = 100


def checked(schema) -> dict:
    """A schema, if all its words are understood."""
    if not isinstance(schema, dict):
        raise ValueError("a schema is an object")
    unknown = set(schema) - KNOWN - SILENT
    if unknown or schema.get("additionalProperties") not in (None, True, False):
        raise ValueError(f"schema words are not understood: {', '.join(sorted(unknown)) or 'additionalProperties'}")
    for k in (schema["type"] if isinstance(schema.get("type"), list) else [schema["type"]] if "type" in schema else []):
        if k not in TYPES:
            raise ValueError(f"type {k} is not understood")
    for part in (*schema.get("properties", {}).values(), *schema.get("anyOf", ()), *([schema["items"]] if "items" in schema else [])):
        checked(part)
    return schema


def _is_reference(value) -> bool:
    """A call that uses another call's result names it so inside its arguments, by nothing but this key."""
    return isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str)


def references(arguments) -> set[str]:
    """The calls that parsed arguments refer to. The whole arguments are no reference."""
    found, stack = set(), [x for x in (arguments.values() if isinstance(arguments, dict) else arguments if isinstance(arguments, list) else ())]
    while stack:
        value = stack.pop()
        if _is_reference(value):
            found.add(value["$ref"])
        elif isinstance(value, dict):
            stack += value.values()
        elif isinstance(value, list):
            stack += value
    return found


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, call_id, needs) of calls; arguments that are no JSON or are nested too deep refer to nothing."""
    for batch in sliced(batches):
        out = []
        for conv_id, call_id, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "call_id", "arguments")), strict=True):
            try:
                arguments = json.loads(text)
                out += [(conv_id, call_id, _printable(x)) for x in references(arguments)] if _depth(arguments) <= DEEPEST else []
            except (ValueError, RecursionError):
                continue
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "call_id", "needs"])


def errors_of(value, schema: dict, at: str = "$") -> list[str]:
    """What of `value` a JSON schema forbids. A reference to a call stands for any value, but not for the whole arguments."""
    if at != "$" and _is_reference(value):
        return []
    found = []
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        fits = any(isinstance(value, TYPES[k]) and not (isinstance(value, bool) and k in ("number", "integer")) for k in kinds)
        if not fits and not ("integer" in kinds and isinstance(value, float) and value.is_integer()):
            return [f"{at}: not {'/'.join(kinds)}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{at}: not the constant")
    if "anyOf" in schema and all(errors_of(value, x, at) for x in schema["anyOf"]):
        found.append(f"{at}: none of anyOf")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]:
            found.append(f"{at}: below minimum")
        if value > schema.get("maximum", value) or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]:
            found.append(f"{at}: above maximum")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            found.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: pattern")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            found.append(f"{at}: number of items")
        for k, x in enumerate(value if "items" in schema else ()):
            found += errors_of(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, x in value.items():
            if k in known:
                found += errors_of(x, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: not allowed")
    return found


def _printable(text: str) -> str:
    """Half characters, which UTF-8 can't have, as their escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def _depth(value) -> int:
    """How deep a value is nested, without recursion."""
    depth, level = 0, [value]
    while level := [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
    return depth


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and whole floats as integers."""

    def plain(x):
        if isinstance(x, float):
            return int(x) if math.isfinite(x) and x.is_integer() and abs(x) < 1 << 53 else x if math.isfinite(x) else None
        if isinstance(x, list):
            return [plain(y) for y in x]
        return {k: plain(y) for k, y in x.items()} if isinstance(x, dict) else x

    return _printable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def order(edges: list[tuple[str, str]]) -> dict[str, int]:
    """The level of each call of `edges` (call, call that it refers to): 0 without references, else one more than the highest it refers to; -1 in a cycle or behind one."""
    users, open_, level = defaultdict(list), defaultdict(int), {}
    for a, b in edges:
        users[b].append(a)
        open_[a] += 1
    ready = [b for b in users if not open_[b]]
    for b in ready:
        level[b] = 0
    while ready:
        b = ready.pop()
        for a in users[b]:
            open_[a] -= 1
            level[a] = max(level.get(a, 0), level[b] + 1)
            if not open_[a]:
                ready.append(a)
    return {k: -1 if open_[k] else level[k] for k in open_.keys() | level.keys()}


def _ordered(group: pa.Table) -> pa.Table:
    found = order(list(zip(group["call_id"].to_pylist(), group["needs"].to_pylist(), strict=True)))
    return pa.table({"conv_id": pa.array([group["conv_id"][0].as_py()] * len(found), pa.int64()), "call_id": pa.array(list(found), pa.string()), "level": pa.array(list(found.values()), pa.int32())})


#: References of a conversation that are ordered in one group; larger conversations are ordered by rounds of joins.
GROUP = 200_000


def levels(edges: DataFrame, group: int = GROUP) -> DataFrame:
    """(conv_id, call_id, level) of `edges` (conv_id, call_id, needs), distinct references to calls of the same conversation; see `order`.

    A conversation of up to `group` references is ordered at once. In larger ones each round settles the calls
    whose references were all settled before, so there are as many rounds as the longest chain has links.
    """
    size = edges.groupBy("conv_id").count()
    large = written(edges.join(size.where(F.col("count") > group).select("conv_id"), "conv_id").select("conv_id", "call_id", "needs"))
    small = edges.join(size.where(F.col("count") <= group).select("conv_id"), "conv_id").select("conv_id", "call_id", "needs")
    small = small.groupBy("conv_id").applyInArrow(_ordered, "conv_id long, call_id string, level int")
    if large.isEmpty():
        return small
    nodes = written(large.select("conv_id", "call_id").distinct())
    free = large.select("conv_id", F.col("needs").alias("call_id")).distinct().join(nodes, ["conv_id", "call_id"], "left_anti")
    done = written(free.withColumn("level", F.lit(0)))
    while True:
        left = nodes.join(done, ["conv_id", "call_id"], "left_anti")
        met = large.join(left, ["conv_id", "call_id"]).join(done.select("conv_id", F.col("call_id").alias("needs"), "level"), ["conv_id", "needs"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.count(F.when(F.col("level").isNull(), 1)).alias("open"), F.max("level").alias("most")).where("open = 0")
        new = written(ready.select("conv_id", "call_id", (F.col("most") + 1).cast("int").alias("level")))
        if new.isEmpty():
            return small.unionByName(done).unionByName(left.withColumn("level", F.lit(-1)))
        done = written(done.unionByName(new))


def _serialise(batches: Iterator[pa.RecordBatch], schemas: dict[str, str]) -> Iterator[pa.RecordBatch]:
    known = {name: json.loads(s) for name, s in schemas.items()}
    for batch in sliced(batches):
        out = []
        for row in batch.to_pylist():
            faults: list[str] = []
            arguments = None
            if row["status"] != "orphan":
                try:
                    arguments = json.loads(row["arguments"] if row["arguments"] is not None else "null")
                    if _depth(arguments) > DEEPEST:
                        raise RecursionError
                    faults = errors_of(arguments, known[row["name"]]) if row["name"] in known else [f"unknown tool {row['name']}"]
                    faults += [f"no call {x}" for x in sorted(row["lost"] or ())]
                except RecursionError:
                    arguments, faults = None, ["arguments are nested too deep"]
                except ValueError:
                    arguments, faults = None, ["arguments are not JSON"]
            record = {"id": row["call_id"], "level": row["level"], "name": row["name"], "arguments": arguments, "result": row["result"], "results": row["results"], "status": row["status"]}
            valid = not faults and row["status"] != "orphan"
            out.append((row["conv_id"], row["turn"], row["call_id"], row["status"], row["level"], row["results"], valid, _printable("; ".join(faults)), canonical(record)))
        columns = list(zip(*out, strict=True)) if out else [()] * len(COLUMNS)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, COLUMNS.values(), strict=True)], names=list(COLUMNS))


COLUMNS = {
    "conv_id": pa.int64(), "turn": pa.int64(), "call_id": pa.string(), "status": pa.string(), "level": pa.int32(), "results": pa.int64(),
    "valid": pa.bool_(), "errors": pa.string(), "json": pa.string(),
}


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, str], group: int = GROUP) -> DataFrame:
    """One row for each call, and for each result without a call: conv_id, turn, call_id, status, level, results, valid, errors, json.

    `calls` has conv_id, turn, call_id, name, arguments (JSON); `results` conv_id, turn, call_id, result; other
    columns are ignored. They are joined by conversation and id: status is linked, pending (no result) or orphan
    (no call). `results` counts an id's results; of several the first by turn, then text, is the one shown; calls
    that repeat an id each get it, so copies never multiply. Rows without an id or conversation stay alone. Rows
    of a conversation in the order of level, turn, call_id are in topological order; level is 0 without
    references, and -1 in a cycle. Arguments that are no JSON, are nested deeper than 100, refer to a call that
    the conversation lacks, or are forbidden by the tool's schema, are not valid; half characters are escaped.
    A schema with words that are not understood is an error. Empty tables give no rows.
    """
    for s in schemas.values():
        checked(json.loads(s))
    named = calls.where("conv_id is not null and call_id is not null")
    # A key may be written with escapes.
    asking = named.where(F.col("arguments").contains("$ref") | F.col("arguments").contains("\\u"))
    asking = asking.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), "arguments")
    asked = asking.mapInArrow(_needed, "conv_id long, call_id string, needs string").distinct()
    ids = named.select("conv_id", F.col("call_id").alias("needs")).distinct().withColumn("_there", F.lit(True))
    asked = written(asked.join(ids, ["conv_id", "needs"], "left"))
    edges, lost = asked.where("_there").select("conv_id", "call_id", "needs"), asked.where("_there is null")
    lost = lost.groupBy("conv_id", "call_id").agg(F.collect_set("needs").alias("lost"))
    first = results.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id")
    first = first.agg(F.min(F.struct("turn", "result")).alias("r"), F.count(F.lit(1)).alias("results"))
    first = first.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), "r.result", "results")
    of = calls.select("conv_id", "turn", "call_id", "name", "arguments")
    for side in (first, levels(edges, group), lost):
        of = of.join(side, ["conv_id", "call_id"], "left")
    nothing, no_one = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    linked = of.select(
        "conv_id", "turn", "call_id", "name", "arguments", "result", F.when(F.col("results").isNotNull(), "linked").otherwise("pending").alias("status"),
        F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("results", F.lit(0).cast("long")).alias("results"), "lost",
    )
    known = ids.select("conv_id", F.col("needs").alias("call_id"))
    lone = first.join(known, ["conv_id", "call_id"], "left_anti").select("conv_id", F.col("result_turn").alias("turn"), "call_id", "result", "results")
    lone = lone.unionByName(results.where("conv_id is null or call_id is null").select("conv_id", "turn", "call_id", "result", F.lit(1).cast("long").alias("results")))
    lone = lone.select("conv_id", "turn", "call_id", nothing.alias("name"), nothing.alias("arguments"), "result", F.lit("orphan").alias("status"), F.lit(0).alias("level"), "results", no_one.alias("lost"))
    schema = "conv_id long, turn long, call_id string, status string, level int, results long, valid boolean, errors string, json string"
    return linked.unionByName(lone).mapInArrow(partial(_serialise, schemas=schemas), schema)
