"""Tool-call linking: calls meet their results by identifier, are put in dependency order, checked and serialised.

Calls and results are joined on (conversation, call id). A call's `level` is the length of the longest chain of calls
that it needs; (level, turn, call_id) is a topological order of a conversation. Conversations with up to GROUP_NEEDS
needs are ordered in one step, a bounded row each, however long their chains; the needs of larger ones are followed in rounds over all
of them at once, a join and an aggregate for each step of the longest chain, of which only the new front is written.
Arguments are validated against the schema of the tool, and each call with its result is written as canonical JSON:
keys sorted, no spaces, characters as they are but for lone surrogates, which stay escaped, and one form for each number:
whole ones as integers with all digits, others with the fewest digits that give the same double.

Defined cases: one row comes out for each call id; of repeated call rows the smallest (turn, name, arguments) stays,
of repeated results the smallest (turn, content), and `n_calls`, `n_results` tell their numbers; null ids are ordinary
values; results without a call are in `orphans`; needs that no call of the conversation has are reported as `missing`
and do not hold a call up; calls on a cycle or after one have no level and `status` cycle; null arguments count as
missing, and arguments that are not JSON stay as text; a number beyond the doubles or of more than NUMBER_DIGITS digits, and
nesting deeper than DEPTH, are errors of the row, whose arguments stay as text; of equal keys in one object the last counts;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowfeat.llm.common import by_value, stored, tuned

by_value(__name__)

GROUP_NEEDS = 100_000  # needs of one conversation that may meet in one row
DEPTH = 200
NUMBER_DIGITS = 1000
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_LONE = re.compile("[\ud800-\udfff]")

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def complaints(value, schema: dict, at: str = "$") -> list[str]:
    """What of a JSON value breaks a schema: type, enum, required, properties, additionalProperties, items, minimum,
    maximum, minLength and maxLength are known."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "integer":
        good = number and (isinstance(value, int) or value.is_integer())
    elif kind == "number":
        good = number
    else:
        good = kind is None or isinstance(value, _KINDS[kind])
    if not good:
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if number:
        out += [f"{at}: below minimum"] if value < schema.get("minimum", value) else []
        out += [f"{at}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += complaints(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += complaints(item, schema["items"], f"{at}[{i}]")
    return out


def _constant(name: str):
    raise ValueError(name)


def _integer(digits: str) -> int:
    if len(digits) > NUMBER_DIGITS:
        raise ValueError("number out of range")
    return int(digits)


def _double(digits: str) -> int | float:
    """Whole numbers become integers, so that equal numbers have one form."""
    value = float(digits)
    if math.isinf(value):
        raise ValueError("number out of range")
    return int(value) if value.is_integer() else value


def depth(text: str) -> int:
    """The deepest nesting of brackets outside of strings."""
    plain = np.frombuffer(_QUOTED.sub("", text).encode(errors="replace"), np.uint8)
    opens, closes = (plain == 0x5B) | (plain == 0x7B), (plain == 0x5D) | (plain == 0x7D)
    return int(np.cumsum(opens.astype(np.int64) - closes).max(initial=0))


def parsed(text: str | None):
    """The JSON value of a text, or a ValueError that says why not; NaN and infinities are not JSON."""
    if text is None:
        raise ValueError("missing")
    if text.count("[") + text.count("{") > DEPTH and depth(text) > DEPTH:
        raise ValueError("nested too deep")
    try:
        return json.loads(text, parse_constant=_constant, parse_int=_integer, parse_float=_double)
    except ValueError as error:
        raise ValueError("number out of range" if "out of range" in str(error) else "not JSON") from None


def plain(text: str) -> str:
    """Lone surrogates, which no encoding can carry, as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return plain(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _key() -> Column:
    return F.to_json(F.struct("conv_id", "call_id"))


def _ordered(needs: dict) -> dict:
    """Level of every key of `needs` (key to the set it needs); None on a cycle or after one."""
    waiting, users, level = {}, defaultdict(list), {}
    for key, wanted in needs.items():
        waiting[key] = len(wanted)
        for w in wanted:
            users[w].append(key)
    front = [w for w in users if w not in needs]
    reached = dict.fromkeys(front, 0)
    while front:
        after = []
        for done in front:
            for key in users[done]:
                reached[key] = max(reached.get(key, 0), reached[done] + 1)
                waiting[key] -= 1
                if not waiting[key]:
                    level[key] = reached[key]
                    after.append(key)
        front = after
    return {key: level.get(key) for key in needs}


def levels(needs: DataFrame, group: int = GROUP_NEEDS) -> DataFrame:
    """`key`, `level` (null on a cycle or after one) of all calls that need others: `needs` has conv, key, need."""
    needs = stored(needs.distinct())
    sizes = stored(needs.groupBy("conv").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > group).select(F.col("conv").alias("c"))
    listed = needs.join(large, F.col("conv").eqNullSafe(F.col("c")), "left_anti")
    listed = listed.groupBy("conv").agg(F.collect_list(F.struct("key", "need")).alias("pairs")).select("pairs")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs in batch.column("pairs"):
                wanted = defaultdict(set)
                for pair in pairs.as_py():
                    wanted[pair["key"]].add(pair["need"])
                found = _ordered(wanted)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], names=["key", "level"])

    small = listed.mapInArrow(order, "key string, level int")
    if large.isEmpty():
        return small
    rest = needs.join(large, F.col("conv").eqNullSafe(F.col("c")), "left_semi").select("key", "need")
    return small.unionByName(_levels_in_rounds(rest))


def _levels_in_rounds(needs: DataFrame) -> DataFrame:
    """The same for conversations of any size, a round for each step of the longest chain."""
    needs = stored(needs)
    keys = needs.select("key").distinct()
    wanted = stored(needs.groupBy("key").agg(F.count("*").alias("wanted")))
    front = stored(needs.select(F.col("need").alias("key")).distinct().join(keys, "key", "left_anti").select("key", F.lit(0).alias("level")))
    out, pending = None, None
    while not front.isEmpty():
        # a call is ready when the last of its needs is done; kept from round to round are those with some done
        add = front.select(F.col("key").alias("need"), "level").join(needs, "need").select("key", F.lit(1).alias("have"), "level")
        add = (add if pending is None else add.unionByName(pending)).groupBy("key").agg(F.sum("have").alias("have"), F.max("level").alias("level"))
        both = stored(add.join(wanted, "key"))
        front = both.where("have = wanted").select("key", (F.col("level") + 1).alias("level"))
        pending = both.where("have < wanted").select("key", "have", "level")
        out = front if out is None else out.unionByName(front)
    found = keys.withColumn("level", F.lit(None).cast("int")) if out is None else keys.join(out, "key", "left")
    return found


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], group: int = GROUP_NEEDS) -> DataFrame:
    """One row for each call: conv_id, call_id, turn, name, level, status, errors, missing, n_calls, n_results, message.

    `calls`: conv_id, turn, call_id, name, arguments (JSON text), needs (array of call ids). `results`: conv_id, turn,
    call_id, content. `schemas`: the tools, a parameter of fixed size. `status` is ok, pending (no result), invalid
    (the arguments break the schema or there is no such tool) or cycle.
    """
    tuned(calls.sparkSession)
    call = F.struct("turn", "name", "arguments", F.array_sort("needs").alias("needs"))
    calls = calls.withColumn("key", _key()).groupBy("key", "conv_id", "call_id").agg(F.min(call).alias("call"), F.count("*").alias("n_calls"))
    calls = stored(calls.select("key", "conv_id", "call_id", "call.*", "n_calls"))
    result = F.struct("turn", "content")
    results = results.withColumn("key", _key()).groupBy("key").agg(F.min(result).alias("result"), F.count("*").alias("n_results"))
    edges = calls.select("key", "conv_id", F.explode("needs").alias("call_id")).select("key", "conv_id", _key().alias("need"), "call_id")
    known = calls.select(F.col("key").alias("need"), F.lit(True).alias("known"))
    edges = stored(edges.join(known, "need", "left"))
    missing = edges.where("known IS NULL").groupBy("key").agg(F.array_sort(F.collect_set("call_id")).alias("missing"))
    order = levels(edges.where("known").select(F.col("conv_id").alias("conv"), "key", "need"), group)
    order = order.select("key", F.lit(True).alias("needs_some"), "level")
    joined = calls.join(results, "key", "left").join(order, "key", "left").join(missing, "key", "left")
    joined = joined.select(
        "conv_id", "call_id", "turn", "name", "arguments", F.when(F.col("needs_some").isNull(), 0).otherwise(F.col("level")).alias("level"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
        "n_calls", F.coalesce("n_results", F.lit(0).cast("bigint")).alias("n_results"),
        F.col("result.turn").alias("result_turn"), F.col("result.content").alias("content"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            status, errors, messages = [], [], []
            for row in batch.to_pylist():
                try:
                    value = parsed(row["arguments"])
                    wrong = complaints(value, schemas[row["name"]]) if row["name"] in schemas else ["$: no such tool"]
                except ValueError as error:
                    value, wrong = row["arguments"], [f"$: {error}"]
                if row["level"] is None:
                    state = "cycle"
                else:
                    state = "invalid" if wrong else "ok" if row["n_results"] else "pending"
                status.append(state)
                errors.append([plain(x) for x in wrong])
                message = {"call": {"arguments": value, "id": row["call_id"], "name": row["name"], "turn": row["turn"]}}
                if row["n_results"]:
                    message["result"] = {"content": row["content"], "turn": row["result_turn"]}
                messages.append(canonical(message | {"level": row["level"], "status": state}))
            kept = {c: batch.column(c) for c in ("conv_id", "call_id", "turn", "name", "level", "missing", "n_calls", "n_results")}
            kept |= {"status": pa.array(status, pa.string()), "errors": pa.array(errors, pa.list_(pa.string())), "message": pa.array(messages, pa.string())}
            yield pa.RecordBatch.from_arrays(list(kept.values()), list(kept))

    schema = (
        f"conv_id {dict(calls.dtypes)['conv_id']}, call_id string, turn bigint, name string, level int, missing array<string>, "
        "n_calls bigint, n_results bigint, status string, errors array<string>, message string"
    )
    return joined.mapInArrow(write, schema)


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results that no call of their conversation has the id of."""
    keys = calls.select(_key().alias("__key")).distinct()
    return results.join(keys, _key() == F.col("__key"), "left_anti")
