"""Chat formatting: tool calls linked to their results, ordered, validated, written as canonical JSON."""

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmill.llm.common import cut, free, only, spread_rank, without

#: Calls up to which one task orders a conversation.
LONG = 100_000

#: Keywords of a schema that count; titles and the like that decide nothing are let through, any other stops the job.
_KEYWORDS = {"type", "enum", "minimum", "maximum", "minLength", "maxLength", "required", "properties", "additionalProperties", "items"}
_NOTES = {"title", "description", "default", "examples", "$comment"}
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: object) -> str:
    """Keys sorted by code point, no spaces, text as it is."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fault(value: object, schema: dict, at: str = "") -> str | None:
    """The first way in which a value breaks a JSON schema, or None.

    Known: type, enum, minimum, maximum, minLength, maxLength, required,
    properties, additionalProperties (false), items.
    """
    if kind := schema.get("type"):
        ok = isinstance(value, _TYPES[kind]) and not (kind in ("integer", "number") and isinstance(value, bool))
        if not ok:
            return f"{at or '.'}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at or '.'}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            return f"{at or '.'}: below minimum"
        if value > schema.get("maximum", value):
            return f"{at or '.'}: above maximum"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at or '.'}: length out of range"
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        known = schema.get("properties", {})
        for name in sorted(value):
            if name in known:
                if found := fault(value[name], known[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := fault(x, schema["items"], f"{at}[{i}]"):
                return found
    return None


def check_schema(schema: dict, at: str = "") -> None:
    """Raises ValueError where a schema holds a keyword that fault does not know."""
    if strange := set(schema) - _KEYWORDS - _NOTES:
        raise ValueError(f"unknown schema keywords at {at or '.'}: {sorted(strange)}")
    for name, part in {**schema.get("properties", {}), **({"[]": schema["items"]} if "items" in schema else {})}.items():
        check_schema(part, f"{at}.{name}")
    if schema.get("additionalProperties", False) not in (True, False):
        raise ValueError(f"additionalProperties at {at or '.'} must be true or false")


def call_levels(waits: dict, least: dict | None = None, held: frozenset = frozenset()) -> dict:
    """Level of each call: 0, or its ``least``, for calls that wait for none, else one more than the highest they wait for, if that is more.

    Calls on a cycle, held ones, and those behind them are absent; references
    to others are not waited for.
    """
    open_, after = {}, {}
    for call, wait in waits.items():
        known = {w for w in wait if w in waits}
        open_[call] = len(known) + (call in held)
        for w in known:
            after.setdefault(w, []).append(call)
    level = {call: (least or {}).get(call, 0) for call in waits}
    queue = [call for call, n in open_.items() if n == 0]
    for call in queue:  # grows while it is read
        for c in after.get(call, ()):
            level[c] = max(level[c], level[call] + 1)
            open_[c] -= 1
            if open_[c] == 0:
                queue.append(c)
    return {c: level[c] for c in queue}


def levels(calls: DataFrame, conv: str, call_id: str, after: str, order: str | None = None) -> DataFrame:
    """(conv, call_id, level) of distinct calls, see call_levels.

    A conversation of up to LONG calls is ordered in one task, one conversation
    at a time; longer ones in blocks of ``order`` (the identifier, if not
    given), see level_blocks.
    """
    kind = calls.schema[conv].dataType.simpleString()
    sizes = calls.groupBy(conv).agg(F.count("*").alias("_n"))
    long_ = cut(sizes.filter(F.col("_n") > LONG).select(conv))
    short = without(calls.select(conv, call_id, after), long_, [conv])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by conversation."""
        now, waits = None, {}

        def placed() -> list[tuple]:
            return [(now, call, level) for call, level in call_levels(waits).items()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            c, i, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, conv_type), pa.array(i, pa.string()), pa.array(n, pa.int32())], names=[conv, call_id, "level"])

        conv_type = None
        for b in batches:
            conv_type, rows = b.schema.field(0).type, []
            for c, i, a in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if c != now:
                    rows += placed()
                    now, waits = c, {}
                waits[i] = a
            if rows:
                yield batch(rows)
        if rows := placed():
            yield batch(rows)

    done = short.repartition(conv).sortWithinPartitions(conv).mapInArrow(whole, f"{conv} {kind}, {call_id} string, level int")
    return done if long_.isEmpty() else done.unionByName(level_blocks(only(calls, long_, [conv]), conv, call_id, after, order or call_id))


def level_blocks(calls: DataFrame, conv: str, call_id: str, after: str, order: str) -> DataFrame:
    """The same in ranges of about LONG calls by conversation and ``order``.

    In a round each range places all calls that wait, directly or through calls
    of the same range, only for calls placed so far. So a chain takes as many
    rounds as it changes from one range to another, and one: few where calls
    wait for earlier ones. Calls on cycles stay when a round places none.
    """
    kind = calls.schema[conv].dataType.simpleString()
    rows = calls.select(conv, call_id, after, F.col(order).alias("_order"))
    n = -(-rows.count() // max(1, LONG))
    rows = cut(rows.repartitionByRange(max(1, n), conv, "_order", call_id).withColumn("_block", F.spark_partition_id()).drop("_order"))
    there = rows.select(F.col(conv).alias("_c"), F.col(call_id).alias("_q"), F.col("_block").alias("_from"))
    edges = rows.select(conv, call_id, "_block", F.explode(after).alias("_p")).distinct()
    edges = cut(edges.join(there, edges[conv].eqNullSafe(there["_c"]) & (edges["_p"] == there["_q"])).drop("_c", "_q"))
    left = rows.select(conv, call_id, "_block", F.lit(0).alias("_least"))
    placed = []
    while True:
        inside = F.col("_from") == F.col("_block")
        wait = edges.groupBy(F.col(conv).alias("_c"), F.col(call_id).alias("_q")).agg(F.collect_list(F.when(inside, F.col("_p"))).alias("_waits"), F.bool_or(~inside).alias("_held"))
        work = left.join(wait, left[conv].eqNullSafe(wait["_c"]) & (left[call_id] == wait["_q"]), "left")
        work = work.select(conv, call_id, "_block", "_least", F.coalesce("_waits", F.array().cast("array<string>")).alias("_waits"), F.coalesce("_held", F.lit(False)).alias("_held"))
        now = cut(work.repartition("_block").sortWithinPartitions("_block").mapInArrow(_place, f"{conv} {kind}, {call_id} string, level int"))
        if now.isEmpty():
            free(now, rows, edges, left)
            break
        placed.append(now)
        known = now.select(F.col(conv).alias("_c"), F.col(call_id).alias("_q"), "level")
        met = edges.join(known, edges[conv].eqNullSafe(known["_c"]) & (edges["_p"] == known["_q"]))
        least = met.groupBy(edges[conv].alias("_lc"), edges[call_id].alias("_lq")).agg((F.max("level") + 1).alias("_new"))
        old = (left, edges)
        left = left.join(known, left[conv].eqNullSafe(known["_c"]) & (left[call_id] == known["_q"]), "left_anti")
        left = left.join(least, left[conv].eqNullSafe(least["_lc"]) & (left[call_id] == least["_lq"]), "left")
        left = cut(left.select(conv, call_id, "_block", F.greatest("_least", "_new").alias("_least")))
        edges = cut(edges.join(known, edges[conv].eqNullSafe(known["_c"]) & (edges["_p"] == known["_q"]), "left_anti"))
        free(*old)
    empty = calls.select(conv, call_id, F.lit(0).alias("level")).limit(0)
    return reduce(DataFrame.unionByName, placed, empty)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, call_id, block, least, waits, held), sorted by block, to the calls that can be placed, with their levels."""
    now, waits, least, held, names = None, {}, {}, set(), None

    def placed() -> Iterator[pa.RecordBatch]:
        if found := call_levels(waits, least, frozenset(held)):
            c, i = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, names.field(0).type), pa.array(i, pa.string()), pa.array(list(found.values()), pa.int32())], names=[names.field(0).name, names.field(1).name, "level"])

    for b in batches:
        names = b.schema
        for c, i, block, n, w, h in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if block != now:
                yield from placed()
                now, waits, least, held = block, {}, {}, set()
            waits[(c, i)], least[(c, i)] = [(c, p) for p in w], n
            if h:
                held.add((c, i))
    yield from placed()


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], conv: str = "conv_id") -> DataFrame:
    """One row per distinct (conversation, call_id), and one for each orphan identifier among the results.

    calls(conv, turn, call_id, name, arguments (JSON text), after (array of
    call_ids)); results(conv, turn, call_id, content). Of repeated calls with
    one identifier the first by turn, name, arguments counts, of several
    results the first by turn and content; n_calls and n_results say how many
    there were. Calls without an identifier are dropped, as nothing can answer
    them.

    Returns conv, call_id, level, position (calls of a conversation by level,
    turn, identifier, from 0; null for orphans and cycles), name, status
    (linked, unanswered, cycle, orphan), valid, error, n_calls, n_results,
    record. valid: arguments are a JSON object that fits the schema of the
    name; a name without a schema is invalid. record: canonical JSON of id,
    name, arguments (null if not JSON), after and result; null for orphans.
    """
    c = calls.filter("call_id is not null").groupBy(conv, "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))).alias("f"), F.count("*").alias("n_calls"))
    c = cut(c.select(conv, "call_id", "f.turn", "f.name", "f.arguments", F.array_distinct("f.after").alias("after"), "n_calls"))
    r = results.filter("call_id is not null").groupBy(conv, "call_id").agg(F.min(F.struct("turn", "content")).alias("f"), F.count("*").alias("n_results"))
    r = r.select(F.col(conv).alias("_c"), F.col("call_id").alias("_i"), F.col("f.content").alias("content"), "n_results")
    both = c.join(r, c[conv].eqNullSafe(r["_c"]) & (c["call_id"] == r["_i"]), "full")
    is_call = F.col("n_calls").isNotNull()
    both = both.select(F.when(is_call, F.col(conv)).otherwise(F.col("_c")).alias(conv), F.coalesce("call_id", "_i").alias("call_id"), "turn", "name", "arguments", "after", "content", "n_calls", "n_results")
    lv = levels(c, conv, "call_id", "after", "turn").select(F.col(conv).alias("_c"), F.col("call_id").alias("_i"), "level")
    both = both.join(lv, both[conv].eqNullSafe(lv["_c"]) & (both["call_id"] == lv["_i"]), "left").drop("_c", "_i")

    known = dict(schemas)
    for name, schema in known.items():
        check_schema(schema, name)

    @F.pandas_udf("valid boolean, error string, record string")
    def written(i: pd.Series, name: pd.Series, arguments: pd.Series, after: pd.Series, content: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = []
        for call, what, args, wait, result, m in zip(i, name, arguments, after, content, n, strict=True):
            if pd.isna(m):
                out.append((None, None, None))
                continue
            try:
                value, error = json.loads(args or "", parse_constant=_no_constant), None
            except (ValueError, RecursionError):
                value, error = None, ".: not JSON"
            if error is None:
                error = fault(value, {"type": "object"} | known[what]) if what in known else "name without a schema"
            record = {"id": call, "name": what, "arguments": value, "after": list(wait), "result": result}
            out.append((error is None, error, canonical(record)))
        return pd.DataFrame(out, columns=["valid", "error", "record"]).astype({"valid": "boolean"})

    both = both.withColumn("_w", written("call_id", "name", "arguments", "after", "content", "n_calls"))
    call = F.col("n_calls").isNotNull()
    status = F.when(~call, "orphan").when(F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    both = both.select(conv, "call_id", "turn", "level", "name", status.alias("status"), "_w.valid", "_w.error", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "_w.record")
    both = cut(both)
    # nulls may not be parts of a rank: conversations without an identifier are one
    keyed = both.filter("level is not null").withColumns({"_part": F.coalesce(F.col(conv).cast("string"), F.lit("")), "_null": F.col(conv).isNull(), "_one": F.lit(1).cast("long")})
    placed = spread_rank(keyed, ["_part", "_null"], "level", ["turn", "call_id"], "_one", "position").drop("_part", "_null", "_one")
    rest = both.filter("level is null").withColumn("position", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(conv, "call_id", "level", "position", "name", "status", "valid", "error", "n_calls", "n_results", "record")


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations(conv_id, turn, role, text), which hold none of their own.

    A user turn calls ``ask``, a system turn ``configure``, with the text and
    its number of words as arguments; either waits for the two turns before it.
    An assistant turn is the result of the turn before it. Turns of any other
    role, null too, are neither and are left out; of turns that repeat, both are
    given on, and a null text has no words and null as its argument.
    """
    def name(turn: F.Column) -> F.Column:
        return F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))

    turn = F.col("turn")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    calls = conversations.filter(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", name(turn).alias("call_id"), F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.to_json(F.struct("text", words.alias("words"))).alias("arguments"), F.array(name(turn - 2), name(turn - 1)).alias("after"),
    )
    results = conversations.filter("role = 'assistant'").select("conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


#: Schemas of the two calls above.
SCHEMAS = {
    "ask": {"required": ["text", "words"], "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 2}}, "additionalProperties": False},
    "configure": {"required": ["text", "words"], "properties": {"text": {"type": "string"}, "words": {"type": "integer", "maximum": 40}}, "additionalProperties": False},
}
