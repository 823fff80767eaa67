"""Tool-call linking for chat data.

Calls and results are hash-joined by conversation and call identifier, calls are ordered
topologically by the calls they depend on, arguments are validated against the tools' schemas, and
each linked pair is serialised as canonical JSON.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

#: Most bytes of tool schemas; they are held on the driver and sent to the executors.
MAX_SCHEMA_BYTES = 4 << 20
#: Turns of a conversation that are put in order together.
PIECE = 256

_types = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and shortest numbers; integral floats become integers."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("number is not finite")
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What of a JSON value breaks a schema (type, enum, const, required, properties,
    additionalProperties, items, and the bounds of lengths, sizes and numbers)."""
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds

        def fits(kind: str) -> bool:
            if kind in ("number", "integer"):
                return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
            return isinstance(value, _types.get(kind, ()))

        if not any(fits(k) for k in kinds):
            return [f"{path}: not of type {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if "const" in schema and value != schema["const"]:
        out.append(f"{path}: not the constant")
    if isinstance(value, (str, list, dict)):
        low, high = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems"), dict: ("minProperties", "maxProperties")}[type(value)]
        if len(value) < schema.get(low, 0):
            out.append(f"{path}: below {low}")
        if high in schema and len(value) > schema[high]:
            out.append(f"{path}: above {high}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            out.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            out.append(f"{path}: above maximum")
    if isinstance(value, dict):
        props = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in props:
                out += violations(value[k], props[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{k}: not allowed")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    return out


def topological_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, depends_on array<string>): 0 without
    known dependencies, else one more than the highest among them; null on or behind a cycle.

    Calls with one dependency form chains, which pointer doubling shortens to their heads in a number
    of rounds that grows with the logarithm of the longest; Kahn's rounds are left for calls with
    several dependencies, one per level of those. Dependencies on calls that do not exist are
    ignored."""
    key = ["conv_id", "call_id"]
    nodes = calls.select(*key).where("conv_id is not null and call_id is not null").distinct()
    edges = calls.select(*key, F.explode("depends_on").alias("dep")).distinct()
    edges = materialize(edges.join(nodes.select("conv_id", F.col("call_id").alias("dep")), ["conv_id", "dep"], "left_semi"), "topo")
    counts = edges.groupBy(*key).agg(F.count("*").alias("n"), F.min("dep").alias("up"))
    chain = materialize(counts.where("n = 1").select(*key, "up", F.lit(1).alias("dist"), F.lit(True).alias("moved")), "topo")
    longest = chain.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):  # what moves after that goes round in a cycle
        if chain.where("moved").isEmpty():
            break
        head = chain.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"))
        step = chain.join(head, ["conv_id", "up"], "left")
        chain = materialize(step.select(*key, F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.col("up2").isNotNull().alias("moved")), "topo")

    heads = nodes.join(edges.select(*key).distinct(), key, "left_anti").withColumn("level", F.lit(0))
    several = edges.join(counts.where("n > 1").select(*key), key)
    via = chain.select("conv_id", F.col("call_id").alias("dep"), "up", "dist", "moved")
    several = several.join(via, ["conv_id", "dep"], "left").select(*key, F.coalesce("up", "dep").alias("up"), F.coalesce("dist", F.lit(0)).alias("dist"))
    several = materialize(several, "topo")
    found = materialize(heads, "topo")
    while not several.isEmpty():
        known = several.join(found.select("conv_id", F.col("call_id").alias("up"), "level"), ["conv_id", "up"], "left")
        ready = known.groupBy(*key).agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.count_if(F.col("level").isNull()).alias("open"))
        new = materialize(ready.where("open = 0").select(*key, F.col("level").cast("int")), "topo")
        if new.isEmpty():
            break
        found = materialize(found.unionByName(new), "topo")
        several = materialize(several.join(new.select(*key), key, "left_anti"), "topo")
    tails = chain.join(found.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base")), ["conv_id", "up"], "left")
    tails = tails.select(*key, F.when(~F.col("moved"), F.col("base") + F.col("dist")).cast("int").alias("level"))
    stuck = several.select(*key).distinct().withColumn("level", F.lit(None).cast("int"))
    return found.unionByName(tails).unionByName(stuck)


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, call_id, turn, level, name, result_turn, n_results, valid, errors, json), one row per
    call and one per result without a call; sorting by conv_id, level, turn, call_id gives a
    topological order of each conversation.

    calls: conv_id, call_id, turn, name, arguments (JSON text), depends_on array<string>. results:
    conv_id, call_id, turn, content. tools: name, schema (JSON text). Of several results of a call
    the earliest is linked (ties: the smallest content) and ``n_results`` counts them. ``errors``
    names what is wrong: missing or repeated identifiers, unknown tools, arguments that are no JSON
    or break the schema, cycles, results that are missing or have no call. Null arguments are an
    empty object. Other columns are ignored; empty tables give no rows."""
    spark = calls.sparkSession
    tune(spark)
    known = tools.select("name", "schema").where("name is not null")
    if (known.agg(F.sum(F.octet_length("schema"))).first()[0] or 0) > MAX_SCHEMA_BYTES:
        raise ValueError(f"tool schemas hold more than {MAX_SCHEMA_BYTES} bytes")
    schemas = {r["name"]: json.loads(r["schema"]) for r in known.collect()}

    key = ["conv_id", "call_id"]
    calls = calls.select(*key, "turn", "name", "arguments", "depends_on")
    levels = topological_levels(calls)
    first = results.select(*key, F.struct(F.col("turn"), F.col("content")).alias("r"))
    named = first.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min("r").alias("r"), F.count("*").alias("n_results"))
    lost = first.where("conv_id is null or call_id is null").withColumn("n_results", F.lit(1).cast("bigint"))
    copies = calls.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.count("*").alias("n_calls"))
    # Calls lead and results are built into the hash tables; identifiers make the keys fine enough that none is hot.
    rows = calls.withColumn("is_call", F.lit(True)).join(named.unionByName(lost).hint("shuffle_hash"), key, "full_outer")
    rows = rows.join(levels, key, "left").join(copies, key, "left")

    def run(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(10)]
            errors, texts = [], []
            for conv, call, turn, name, args, is_call, result, n_results, level, n_calls in zip(*cols, strict=True):
                found, value = [], None
                if conv is None or call is None:
                    found.append("identifier missing")
                if not is_call:
                    found.append("result without call")
                else:
                    if n_calls is not None and n_calls > 1:
                        found.append("identifier repeated")
                    if conv is not None and call is not None and level is None:
                        found.append("dependency cycle")
                    if n_results is None:
                        found.append("result missing")
                    try:
                        value = json.loads(args) if args is not None else {}
                        canonical(value)
                    except (ValueError, RecursionError):
                        value = None
                        found.append("arguments are not JSON")
                    else:
                        if name not in schemas:
                            found.append("unknown tool")
                        else:
                            found += violations(value, schemas[name])
                pair = {"conversation": conv, "id": call, "result": None if result is None else {"turn": result["turn"], "content": result["content"]}}
                if is_call:
                    pair |= {"turn": turn, "call": {"name": name, "arguments": args if value is None else value}}
                errors.append(found)
                texts.append(canonical(pair))
            yield pa.record_batch(
                [*(b.column(k) for k in (0, 1, 2, 8, 3)), pa.array([r and r["turn"] for r in cols[6]], b.schema.field(6).type.field(0).type), b.column(7), pa.array([not x for x in errors], pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=["conv_id", "call_id", "turn", "level", "name", "result_turn", "n_results", "valid", "errors", "json"],
            )

    kinds = dict(rows.dtypes)
    turn = dict(results.dtypes)["turn"]
    rows = rows.select(*key, "turn", "name", "arguments", F.coalesce("is_call", F.lit(False)).alias("is_call"), "r", "n_results", "level", "n_calls")
    return rows.mapInArrow(run, f"conv_id {kinds['conv_id']}, call_id string, turn {kinds['turn']}, level int, name string, result_turn {turn}, n_results bigint, valid boolean, errors array<string>, json string")


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) in the common JSON form:
    ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}`` and
    ``{"tool_call_id", "content"}``; other messages hold neither."""
    call = "array<struct<id string, name string, arguments string, depends_on array<string>>>"
    found = messages.select("conv_id", "turn", F.from_json("text", f"tool_calls {call}, tool_call_id string, content string").alias("m"))
    calls = found.select("conv_id", "turn", F.explode("m.tool_calls").alias("c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), "turn", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on"))
    results = found.where("m.tool_call_id is not null").select("conv_id", F.col("m.tool_call_id").alias("call_id"), "turn", F.col("m.content").alias("content"))
    return calls, results


def is_tool_message(messages: DataFrame):
    """Whether a message is tool-call JSON of a role other than user and system: whether parse_messages finds something in it."""
    m = F.from_json("text", "tool_calls array<struct<id string>>, tool_call_id string")
    return F.coalesce(~F.col("role").isin("user", "system") & ((F.size(m["tool_calls"]) > 0) | m["tool_call_id"].isNotNull()), F.lit(False))


def _turns_before(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, user, reply): the last user turn and the last assistant turn before each turn.
    Pieces of a conversation are handled apart and joined by their last turns, so that a long one
    makes no large task."""
    is_user, is_reply = F.col("role") == "user", F.col("role") == "assistant"
    turns = conversations.where((is_user | is_reply) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    turns = turns.groupBy("conv_id", "turn").agg(F.max(F.when(is_user, F.col("turn"))).alias("u"), F.max(F.when(is_reply, F.col("turn"))).alias("r"))
    turns = turns.withColumn("piece", F.floor(F.col("turn") / PIECE))
    ends = turns.groupBy("conv_id", "piece").agg(F.max("u").alias("u"), F.max("r").alias("r"))
    past = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("conv_id", "piece", F.max("u").over(past).alias("u0"), F.max("r").over(past).alias("r0"))
    past = Window.partitionBy("conv_id", "piece").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select("conv_id", "piece", "turn", F.max("u").over(past).alias("u"), F.max("r").over(past).alias("r"))
    return turns.join(ends, ["conv_id", "piece"]).select("conv_id", "turn", F.coalesce("u", "u0").alias("user"), F.coalesce("r", "r0").alias("reply"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain dialogues in the same form: each user turn calls the tool ``respond``, depending on the
    last user turn before it, and the first assistant turn after it is its result, whatever turns of
    other roles stand between. Further assistant turns, and those before any user turn, are results
    without a call. Turns of other roles are left to other_messages."""

    def ident(turn):
        return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))

    # Only turns that don't alternate are looked up: few as a rule, so no text is moved for them.
    turn, linked = F.col("turn"), F.coalesce(F.col("reply") < F.col("user"), F.col("user").isNotNull())
    odd = _turns_before(conversations).select("conv_id", "turn", "user", F.when(linked, F.col("user")).alias("call"))
    usual = F.col("user").eqNullSafe(F.when(turn >= 2, turn - 2))
    asked = F.col("call").eqNullSafe(turn - 1)
    odd = materialize(odd.select("conv_id", "turn", "user", "call", usual.alias("usual"), asked.alias("asked")).where("not (usual and asked)"), "turns")
    user = conversations.where("role = 'user'").join(odd.where("not usual").select("conv_id", "turn", "user", F.lit(True).alias("odd")), ["conv_id", "turn"], "left")
    before = F.when(F.col("odd"), F.col("user")).when(turn >= 2, turn - 2)
    depends = F.when(before.isNotNull(), F.array(ident(before))).otherwise(F.array().cast("array<string>"))
    calls = user.select("conv_id", ident(turn).alias("call_id"), "turn", F.lit("respond").alias("name"), F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), "turn")).alias("arguments"), depends.alias("depends_on"))
    reply = conversations.where("role = 'assistant'").join(odd.where("not asked").select("conv_id", "turn", "call"), ["conv_id", "turn"], "left")
    results = reply.select("conv_id", ident(F.coalesce("call", turn - 1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def other_messages(conversations: DataFrame) -> DataFrame:
    """The rows of turns whose role is neither user nor assistant (system, tool, none), in the columns of
    link_tool_calls: the role as the name, level 0, no result, the message in ``json``."""
    role = F.col("role")
    rest = conversations.where(role.isNull() | ~role.isin("user", "assistant"))
    ident = F.concat(F.lit("message_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    rest = rest.select("conv_id", ident.alias("call_id"), "turn", F.lit(0).alias("level"), role.alias("name"), "text")

    def run(batches):
        for b in batches:
            found = [canonical({"conversation": conv, "id": i, "turn": turn, "message": {"role": name, "content": t}}) for conv, i, turn, _, name, t in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True)]
            yield pa.record_batch([*(b.column(k) for k in range(5)), pa.array(found, pa.string())], names=["conv_id", "call_id", "turn", "level", "name", "json"])

    kinds = dict(rest.dtypes)
    rows = rest.mapInArrow(run, f"conv_id {kinds['conv_id']}, call_id string, turn {kinds['turn']}, level int, name string, json string")
    ok = F.col("call_id").isNotNull()
    errors = F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.lit("identifier missing")))
    return rows.select("conv_id", "call_id", "turn", "level", "name", F.lit(None).cast(kinds["turn"]).alias("result_turn"), F.lit(None).cast("bigint").alias("n_results"), ok.alias("valid"), errors.alias("errors"), "json")


def format_conversations(conversations: DataFrame, tools: DataFrame) -> DataFrame:
    """link_tool_calls over whole conversations (conv_id, turn, role, text): tool-call JSON goes through
    parse_messages, other user and assistant turns through turns_as_calls, and each turn of another
    role has a row of its own."""
    tune(conversations.sparkSession)
    conversations = conversations.select("conv_id", "turn", "role", "text")
    made = is_tool_message(conversations)
    plain = conversations.where(~made)
    calls, results = (a.unionByName(b) for a, b in zip(turns_as_calls(plain), parse_messages(conversations.where(made)), strict=True))
    return link_tool_calls(calls, results, tools).unionByName(other_messages(plain))
