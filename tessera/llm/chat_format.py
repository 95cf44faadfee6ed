"""Chat formatting: tool-call linking, topological order, argument checks and canonical JSON (DataFrame functions only).

Messages hold calls and results as JSON, or, without any, a user's turn calls for a reply and the assistant's next turn
is its result. Calls and results are hash-joined by conversation and identifier through one row per identifier,
aggregated before the join, so a call that is repeated any number of times meets no group. Order: a message's place is
the largest turn among itself and all that it depends on, its level the longest chain of dependencies below it; (place,
level, turn) is a topological order at any depth. Chains of single dependencies are followed by pointer doubling; calls
with several leave round by round as they get ready, until a round frees none. What never settles, on a cycle or
behind one, keeps its turn as place, a null level and the error "cycle".

Defined cases: a null conversation, turn or role links with nothing; null text is null in the JSON; identifiers
hold within their conversation; those that several calls claim are linked to each of them, have all their
dependencies, and are marked "ambiguous"; results without a call and calls without a
result are "unlinked"; arguments that are no JSON object, or repeat a key below their first level, are "malformed", those
that repeat one on it a "repeated key", and either stay as text; words beside calls are the first call's content; blanks
before a JSON message don't matter; repeated rows are formatted each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KEY = ["conv_id", "id"]
#: After so many rounds the settled calls are written as one table; it bounds a plan's length, not the rounds.
KEPT_ROUNDS = 16
#: Of each tool: its parameters as (name, JSON type, required).
Schemas = dict[str, Sequence[tuple[str, str, bool]]]
REPLY: Schemas = {"reply": (("n_chars", "BIGINT", True), ("text", "STRING", True))}
CALLS = "struct<content: string, tool_calls: array<struct<id: string, name: string, arguments: string, depends_on: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"
#: What a message that is a JSON object begins with; JSON's own blanks may stand before it.
OBJECT = r"^[ \t\n\r]*\{"


def canonical(**fields: Column) -> Column:
    """Compact JSON with keys in order and nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def with_raw(fields: dict[str, Column], raw: dict[str, Column]) -> Column:
    """canonical(fields) with more members whose values are JSON already."""
    whole = {k: canonical(**{k: c}) for k, c in fields.items()}
    members = {k: c.substr(F.lit(2), F.length(c) - 2) for k, c in whole.items()} | {k: F.concat(F.lit(f'"{k}":'), c) for k, c in raw.items()}
    return F.concat(F.lit("{"), F.concat_ws(",", *[members[k] for k in sorted(members)]), F.lit("}"))


def messages(conversations: DataFrame) -> DataFrame:
    """One row per message and tool call: conv_id, turn, role, text, content, kind, id, name, arguments, depends_on."""
    text, whole = F.col("text"), F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("role").isNotNull()
    json = whole & text.rlike(OBJECT)
    base = conversations.select("conv_id", "turn", "role", "text").select(
        "*",
        F.when(json & (F.col("role") == "assistant"), F.from_json(text, CALLS)).alias("said"),
        F.when(json & F.col("role").isin("tool", "user"), F.from_json(text, RESULT)).alias("answer"),
    )
    turn_id = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    none = F.lit(None).cast("string")
    calls = F.col("said")["tool_calls"]
    no_deps = F.array().cast("array<string>")
    implied = F.when(~whole, F.struct(F.lit("plain").alias("kind"), none.alias("id"), none.alias("name"), none.alias("arguments"), no_deps.alias("depends_on")))
    implied = implied.when(F.col("answer")["tool_call_id"].isNotNull(), F.struct(F.lit("result").alias("kind"), F.col("answer")["tool_call_id"].alias("id"), none.alias("name"), none.alias("arguments"), no_deps.alias("depends_on")))
    arguments = F.to_json(F.struct(F.length(text).cast("long").alias("n_chars"), text.alias("text")))
    implied = implied.when(F.col("role") == "user", F.struct(F.lit("call").alias("kind"), turn_id(F.col("turn")).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), no_deps.alias("depends_on")))
    implied = implied.when(F.col("role") == "assistant", F.struct(F.lit("result").alias("kind"), turn_id(F.col("turn") - 1).alias("id"), none.alias("name"), none.alias("arguments"), no_deps.alias("depends_on")))
    implied = implied.otherwise(F.struct(F.lit("plain").alias("kind"), none.alias("id"), none.alias("name"), none.alias("arguments"), no_deps.alias("depends_on")))
    explicit = F.transform(calls, lambda c: F.struct(F.lit("call").alias("kind"), c["id"].alias("id"), c["name"].alias("name"), c["arguments"].alias("arguments"), F.coalesce(c["depends_on"], no_deps).alias("depends_on")))
    many = F.size(calls) > 0
    each = F.when(many, explicit).otherwise(F.array(implied))
    # what a message says beside its calls stands with the first of them, a result's words in its content
    content = F.when(many, F.when(F.col("place") == 0, F.col("said")["content"])).otherwise(
        F.when(F.col("answer")["tool_call_id"].isNotNull(), F.col("answer")["content"]).otherwise(text))
    apart = base.select("conv_id", "turn", "role", "text", "said", "answer", F.posexplode(each).alias("place", "m"))
    return apart.select("conv_id", "turn", "role", "text", content.alias("content"), "m.*")


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted errors of a call's arguments: malformed, repeated key, unknown tool, and per parameter missing, unknown or wrong type."""
    parsed = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    out = F.when(keys.isNull(), F.array(F.lit("malformed"))).when(repeated, F.array(F.lit("repeated key"))).when(parsed.isNull(), F.array(F.lit("malformed")))
    for tool, parameters in sorted(schemas.items()):
        checks = []
        for parameter, kind, required in parameters:
            value = F.try_variant_get(parsed, f"$.{parameter}", "variant")
            found = F.schema_of_variant(value)
            absent = value.isNull() | (found == "VOID")
            checks.append(F.when(absent, F.lit(f"{parameter}: missing") if required else F.lit(None).cast("string")).when(found != kind, F.lit(f"{parameter}: wrong type")))
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(p[0]) for p in parameters])), lambda k: F.concat(k, F.lit(": unknown")))
        out = out.when(name == tool, F.array_sort(F.concat(F.array_compact(F.array(*checks)), unknown)))
    return out.otherwise(F.array(F.lit("unknown tool")))


def chains(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, id, top, steps, most, open) of each call: the end of its chain of single dependencies, by pointer doubling.

    A chain ends at a call without dependencies or with several; most is the largest turn on it. Open ones lead into a cycle.
    """
    needs = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("needs").alias("up"))
    single = F.coalesce(F.col("n") == 1, F.lit(False))
    now = stored(calls.join(needs, KEY, "left").select(
        *KEY, F.when(single, F.col("up")).otherwise(F.col("id")).alias("top"), F.when(single, 1).otherwise(0).alias("steps"), F.col("at").alias("most"),
        single.alias("open"), F.lit(False).alias("ended")), "chat-chains")
    while True:
        above = now.select("conv_id", F.col("id").alias("top"), F.col("top").alias("top2"), F.col("steps").alias("steps2"), F.col("most").alias("most2"), F.col("open").alias("open2"))
        moved = now.where("open").join(above, ["conv_id", "top"]).select(
            *KEY, F.col("top2").alias("top"), (F.col("steps") + F.col("steps2")).alias("steps"), F.greatest("most", "most2").alias("most"),
            F.col("open2").alias("open"), (~F.col("open2")).alias("ended"))
        now = stored(now.where("not open").withColumn("ended", F.lit(False)).unionByName(moved), "chat-chains")
        if now.where("ended").isEmpty():  # a chain that still runs has its earlier calls end in every round
            return now.drop("ended")


def settled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, id, place, level) of calls (conv_id, id, at) along edges (conv_id, id, needs); null for what never settles."""
    if edges.isEmpty():
        return calls.select(*KEY, F.col("at").alias("place"), F.lit(0).alias("level"))
    edges = stored(edges.join(calls.select("conv_id", F.col("id").alias("needs")), ["conv_id", "needs"], "left_semi").distinct(), "chat-edges")
    calls = stored(calls, "chat-calls")
    runs = chains(calls, edges)
    # calls with several dependencies: ready ones leave round by round
    several = edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY)
    below = runs.select("conv_id", F.col("id").alias("needs"), "top", "steps", "most")
    null = F.lit(None)
    waits = stored(edges.join(several, KEY, "left_semi").join(below, ["conv_id", "needs"]).join(calls, KEY).select(
        *KEY, "at", "top", "steps", "most", null.cast("long").alias("place"), null.cast("int").alias("level")), "chat-waits")
    fresh = runs.where("not open and steps = 0").select(*KEY, F.col("most").cast("long").alias("place"), F.lit(0).alias("level")).join(several, KEY, "left_anti")
    known, rounds = stored(fresh, "chat-known"), 0
    fresh = known
    while True:
        last = fresh.select("conv_id", F.col("id").alias("top"), F.col("place").alias("p"), F.col("level").alias("l"))
        met = stored(waits.join(last, ["conv_id", "top"], "left").select(
            *KEY, "at", "top", "steps", "most", F.coalesce("place", F.when(F.col("p").isNotNull(), F.greatest("most", "p"))).alias("place"),
            F.coalesce("level", F.col("l") + F.col("steps") + 1).cast("int").alias("level")), "chat-waits")
        ready = met.groupBy(*KEY).agg(F.count_if(F.col("level").isNull()).alias("left"), F.max(F.greatest("at", "place")).alias("place"), F.max("level").alias("level"))
        fresh = stored(ready.where("left = 0").select(*KEY, F.col("place").cast("long").alias("place"), "level"), "chat-ready")
        if fresh.isEmpty():
            break
        waits, known, rounds = met.join(fresh.select(*KEY), KEY, "left_anti"), known.unionByName(fresh), rounds + 1
        if rounds % KEPT_ROUNDS == 0:
            known = stored(known, "chat-known")
    ends = stored(known.withColumnRenamed("id", "top"), "chat-known")
    return runs.join(ends, ["conv_id", "top"], "left").select(*KEY, F.when(F.col("level").isNotNull(), F.greatest("most", "place")).alias("place"), (F.col("level") + F.col("steps")).alias("level"))


def linked(rows: DataFrame, schemas: Schemas) -> DataFrame:
    """rows of messages() with linked, ambiguous, place, level, errors."""
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    by_id = rows.where("id is not null").groupBy(*KEY).agg(
        F.count_if(is_call).alias("n_calls"), F.count_if(is_result).alias("n_results"), F.min(F.when(is_call, F.col("turn"))).alias("at"),
    )
    edges = rows.where(is_call & F.col("id").isNotNull()).select(*KEY, F.explode("depends_on").alias("needs")).where("needs is not null")
    order = settled(by_id.where("n_calls > 0").select(*KEY, "at"), edges)
    links = by_id.select(*KEY, "n_calls", "n_results").join(order, KEY, "left")
    both = (F.col("n_calls") > 0) & (F.col("n_results") > 0)
    errors = F.when(is_call, argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    marks = F.array_compact(F.array(
        F.when(F.col("kind").isin("call", "result") & ~F.coalesce(both, F.lit(False)), F.lit("unlinked")),
        F.when(F.col("n_calls") > 1, F.lit("ambiguous")), F.when((F.col("n_calls") > 0) & F.col("level").isNull(), F.lit("cycle")),
    ))
    depth = F.when(is_call, F.col("level")).when(is_result, F.coalesce(F.col("level") + 1, F.lit(0))).otherwise(F.lit(0))
    links = stored(links.withColumnsRenamed({"id": "__id", "conv_id": "__conv"}), "chat-links")  # written first, so that a hot id can be split in the join
    spread = F.coalesce("id", F.concat(F.lit("\0"), F.xxhash64("conv_id", "turn", "text").cast("string")))  # messages without an id meet nowhere
    # one row an id on the hashed side; the file's size says little of the table's, so no broadcast is left to it
    return rows.join(links.hint("shuffle_hash"), (F.col("conv_id") == F.col("__conv")) & (spread == F.col("__id")), "left").select(
        "conv_id", "turn", "role", "content", "kind", "id", "name", "arguments", "depends_on",
        F.coalesce(both, F.lit(False)).alias("linked"), F.greatest("turn", "place").cast("long").alias("place"), depth.cast("int").alias("level"),
        F.concat(errors, marks).alias("errors"),
    )


def formatted(conversations: DataFrame, schemas: Schemas = REPLY) -> DataFrame:
    """One row per message or tool call: conv_id, turn, role, kind, call_id, linked, place, level, valid, errors, json."""
    rows = linked(messages(conversations), schemas)
    errors = F.array_join("errors", ",")
    valid = F.size("errors") == 0
    # a variant keeps its objects' keys in order; arguments that are no JSON stay as text
    text_of = canonical(a=F.col("arguments"))
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), text_of.substr(F.lit(6), F.length(text_of) - 6))
    fields = dict(
        call_id=F.col("id"), content=F.col("content"), conv_id=F.col("conv_id"), errors=errors, kind=F.col("kind"), level=F.col("level"),
        linked=F.col("linked"), name=F.col("name"), place=F.col("place"), role=F.col("role"), turn=F.col("turn"), valid=valid,
    )
    call = with_raw(fields, {"arguments": arguments, "depends_on": F.to_json(F.array_sort(F.array_distinct("depends_on")))})
    json = F.when(F.col("kind") == "call", call).otherwise(canonical(**fields))
    return rows.select("conv_id", "turn", "role", "kind", F.col("id").alias("call_id"), "linked", "place", "level", valid.alias("valid"), errors.alias("errors"), json.alias("json"))


#: For tables whose messages hold no JSON calls.
SQL = """
WITH m AS (
  SELECT *, conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AS whole FROM conversations),
k AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN whole AND role = 'user' THEN 'call' WHEN whole AND role = 'assistant' THEN 'result' ELSE 'plain' END AS kind,
    CASE WHEN whole AND role = 'user' THEN conv_id || ':' || turn WHEN whole AND role = 'assistant' THEN conv_id || ':' || (turn - 1) END AS id
  FROM m),
ids AS (SELECT id, count(*) FILTER (kind = 'call') AS n_calls, count(*) FILTER (kind = 'result') AS n_results, min(turn) FILTER (kind = 'call') AS called FROM k WHERE id IS NOT NULL GROUP BY id),
j AS (
  SELECT k.*, coalesce(n_calls > 0 AND n_results > 0, false) AS linked, greatest(turn, called) AS place, CAST(CASE WHEN kind = 'result' AND n_calls > 0 THEN 1 ELSE 0 END AS INTEGER) AS level,
    concat_ws(',', CASE WHEN kind = 'call' AND text IS NULL THEN 'n_chars: missing,text: missing' END,
      CASE WHEN kind <> 'plain' AND NOT coalesce(n_calls > 0 AND n_results > 0, false) THEN 'unlinked' END, CASE WHEN n_calls > 1 THEN 'ambiguous' END) AS errors,
    CASE WHEN kind = 'call' THEN 'reply' END AS name
  FROM k LEFT JOIN ids USING (id))
SELECT conv_id, turn, role, kind, id AS call_id, linked, place, level, errors = '' AS valid, errors,
  CASE WHEN kind = 'call' THEN CAST(json_object('arguments', CASE WHEN text IS NULL THEN json('{}') ELSE json_object('n_chars', length(text), 'text', text) END, 'call_id', id, 'content', text, 'conv_id', conv_id,
      'depends_on', json('[]'), 'errors', errors, 'kind', kind, 'level', level, 'linked', linked, 'name', name, 'place', place, 'role', role, 'turn', turn, 'valid', errors = '') AS VARCHAR)
    ELSE CAST(json_object('call_id', id, 'content', text, 'conv_id', conv_id, 'errors', errors, 'kind', kind, 'level', level, 'linked', linked, 'name', name, 'place', place, 'role', role, 'turn', turn, 'valid', errors = '') AS VARCHAR) END AS json
FROM j
"""
