"""Chat formatting of tool calls: linked by identifier, ordered by dependence, validated, as canonical JSON; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.session import cut_lineage
from ..operators.ranking import grouped_index

LAST = (1 << 62) - 1
#: Types of a schema and what a parsed value of them is called.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT", "null": "VOID"}


def json_text(value: Column) -> Column:
    """A string as a JSON literal."""
    quoted = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    return F.when(value.isNull(), "null").otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def first_of(df: DataFrame, order: list[str], rest: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that define their (conv, id), the earliest of each, and the number of other rows with it."""
    row = F.struct(*order, *[c for c in rest if c not in order])
    kept = df.groupBy("conv", "id").agg(F.min(row).alias("r"), F.count("*").alias("n"))
    return kept.select("conv", "id", "r.*", (F.col("n") - 1).alias("repeats"))


def errors(arguments: Column, spec: Column) -> Column:
    """What is wrong with parsed arguments, sorted: missing:x, type:x, unknown:x; ``json`` if they are no object, ``tool`` without a schema."""
    given = F.expr("try_cast(parsed AS MAP<STRING, VARIANT>)")
    kind = lambda s: F.schema_of_variant(F.element_at(given, s["name"]))
    fits = lambda s: F.when(s["type"] == "number", kind(s).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")).otherwise(
        kind(s).startswith(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TYPES.items() for x in p]), s["type"]), F.lit("?")))
    )
    has = lambda s: F.map_contains_key(given, s["name"])
    missing = F.transform(F.filter(spec, lambda s: s["required"] & ~has(s)), lambda s: F.concat(F.lit("missing:"), s["name"]))
    wrong = F.transform(F.filter(spec, lambda s: has(s) & ~fits(s)), lambda s: F.concat(F.lit("type:"), s["name"]))
    unknown = F.transform(F.array_except(F.map_keys(given), F.transform(spec, lambda s: s["name"])), lambda x: F.concat(F.lit("unknown:"), x))
    found = F.array_sort(F.concat(missing, wrong, unknown))
    return F.when(given.isNull(), F.array(F.lit("json"))).when(spec.isNull(), F.array(F.lit("tool"))).otherwise(found)


def ordered_calls(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, id, at, depth) of the calls that can run: after all calls they need and those calls' results.

    ``calls``: conv, id, turn, result_turn (null without a result); ``needs``:
    conv, id, need.  ``at`` is the earliest turn by which all that a call needs
    is there; needs that go along the turns hold by that alone.  ``depth``
    orders the calls of one ``at``: the longest path of needs within it.  Calls
    on a cycle, or behind one, are left out.  The rounds follow the needs that go
    against the turns or stay within one, not the length of a conversation.
    """
    inner = needs.join(calls.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_semi").distinct()
    inner = cut_lineage(inner)
    state = calls.select("conv", "id", "result_turn", F.col("turn").alias("at"))
    there = F.greatest("at", F.coalesce("result_turn", "at"))
    moved = state
    while True:  # later starts travel along needs until nothing changes
        came = inner.join(moved.select("conv", F.col("id").alias("need"), there.alias("there")), ["conv", "need"]).groupBy("conv", "id").agg(F.max("there").alias("there"))
        moved = cut_lineage(state.join(came, ["conv", "id"]).filter(F.col("there") > F.col("at")).select("conv", "id", "result_turn", F.col("there").alias("at")))
        if moved.isEmpty():
            break
        later = moved.select("conv", "id", F.col("at").alias("new"))
        state = cut_lineage(state.join(later, ["conv", "id"], "left").withColumn("at", F.coalesce("new", "at")).drop("new"))
    ends = inner.join(state.select("conv", "id", F.col("at").alias("own")), ["conv", "id"])
    ends = ends.join(state.select("conv", F.col("id").alias("need"), F.col("at").alias("its"), "result_turn", there.alias("there")), ["conv", "need"])
    ends = ends.filter(F.col("there") == F.col("own"))
    step = 1 + F.col("result_turn").isNotNull().cast("bigint")
    # A needed call of an earlier turn only matters by its result, which begins the turn.
    close = cut_lineage(ends.select("conv", "id", "need", (F.col("its") == F.col("own")).alias("same"), step.alias("step")))
    waits = close.groupBy("conv", "id").agg(F.count_if("same").alias("waits"), F.max(F.when(F.col("same"), 0).otherwise(1)).cast("bigint").alias("depth"))
    state = state.join(waits, ["conv", "id"], "left").select("conv", "id", "at", F.coalesce("waits", F.lit(0)).alias("waits"), F.coalesce("depth", F.lit(0)).alias("depth"))
    state = cut_lineage(state)
    ready, state = state.filter("waits = 0").drop("waits"), state.filter("waits > 0")
    done, chain = ready, close.filter("same").drop("same")
    while not state.isEmpty() and not ready.isEmpty():
        came = chain.join(ready.select("conv", F.col("id").alias("need"), "depth"), ["conv", "need"])
        news = came.groupBy("conv", "id").agg(F.count("*").alias("n"), F.max(F.col("depth") + F.col("step")).alias("depth2"))
        state = cut_lineage(state.join(news, ["conv", "id"], "left").select(
            "conv", "id", "at", (F.col("waits") - F.coalesce("n", F.lit(0))).alias("waits"), F.greatest("depth", "depth2").alias("depth")
        ))
        ready, state = state.filter("waits = 0").drop("waits"), state.filter("waits > 0")
        done = done.union(ready)
    stuck = edge = state.select("conv", "id")
    while not edge.isEmpty():  # what needs a call of a cycle can't run either
        behind = inner.join(edge.select("conv", F.col("id").alias("need")), ["conv", "need"]).select("conv", "id").distinct()
        edge = cut_lineage(behind.join(stuck, ["conv", "id"], "left_anti"))
        stuck = stuck.union(edge)
    return done.join(stuck, ["conv", "id"], "left_anti")


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """All events of all conversations in order, one row each, as canonical JSON (keys sorted, no white space).

    ``messages``: conv_id, turn, role, text.  ``calls``: conv_id, call_id, turn,
    tool, arguments (JSON text), needs (ids of calls).  ``results``: conv_id,
    call_id, turn, content.  ``schemas``: tool, name, type (of JSON), required.

    Rows: conv_id, position (from 0), kind (message, call, result), id, turn,
    status, errors, json.  A call is ``linked``, ``pending`` (no result) or
    ``cyclic`` (on or behind a cycle; such calls and their results come last,
    by turn); a result is ``linked`` or ``orphan``.  Of calls or results with one
    id in a conversation the earliest counts (by turn, then content), the
    others are counted in ``repeats``; needed ids that no call has are ignored and
    counted in ``unknown_needs``.  Null ids are orphans and pending calls of
    their own id, null.  Repeated rows of a schema count once.  Numbers are
    written as Spark writes VARIANT values (``1e2`` is ``100.0``); arguments that
    do not parse, an object that repeats a name among them, are quoted as text
    with the error ``json``.  Null conversations are one conversation.  Empty tables
    give an empty result; other columns are not carried.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0"))
    ident = F.coalesce("call_id", F.lit("\0"))
    back = lambda c: F.when(F.col(c) == "\0", F.lit(None)).otherwise(F.col(c))
    turn = F.coalesce("turn", F.lit(LAST)).cast("bigint").alias("turn")
    call = first_of(calls.select(conv.alias("conv"), ident.alias("id"), turn, "tool", "arguments", "needs"), ["turn", "tool", "arguments"], ["needs"])
    result = first_of(results.select(conv.alias("conv"), ident.alias("id"), turn, "content"), ["turn", "content"], [])
    answered = result.filter("id <> '\\u0000'").select("conv", "id", F.col("turn").alias("result_turn"))
    call = cut_lineage(call.join(answered, ["conv", "id"], "left"))
    needs = call.select("conv", "id", F.explode("needs").alias("need"))
    unknown = needs.join(call.select("conv", F.col("id").alias("need")), ["conv", "need"], "left_anti").groupBy("conv", "id").agg(F.count("*").alias("unknown_needs"))
    placed = ordered_calls(call, needs)
    spec = schemas.groupBy("tool").agg(F.array_sort(F.collect_set(F.struct("name", "type", "required"))).alias("spec"))
    call = call.join(placed, ["conv", "id"], "left").join(unknown, ["conv", "id"], "left").join(spec, "tool", "left").withColumn("parsed", F.try_parse_json("arguments"))
    at, depth = F.coalesce("at", F.lit(LAST)), F.coalesce("depth", F.lit(LAST))
    status = F.when(F.col("at").isNull(), "cyclic").when(F.col("result_turn").isNull(), "pending").otherwise("linked")
    arguments = F.when(F.col("parsed").isNull(), json_text(F.col("arguments"))).otherwise(F.to_json("parsed"))
    none = F.lit(0).cast("bigint")
    as_call = call.select(
        "conv", at.alias("at"), depth.alias("depth"), F.lit(1).alias("phase"), "id", "turn", F.lit("call").alias("kind"), status.alias("status"),
        errors(F.col("parsed"), F.col("spec")).alias("errors"), "repeats", F.coalesce("unknown_needs", none).alias("unknown_needs"),
        F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_text(back("id")), F.lit(',"name":'), json_text(F.col("tool")), F.lit(',"type":"call"}')).alias("json"),
    )
    owner = as_call.filter("id <> '\\u0000'").select("conv", "id", F.col("at").alias("call_at"), F.col("depth").alias("call_depth"))
    joined = result.join(owner, ["conv", "id"], "left")
    cyclic = F.col("call_at") == LAST
    as_result = joined.select(
        "conv", F.when(cyclic, F.lit(LAST)).otherwise(F.greatest("turn", F.coalesce("call_at", "turn"))).alias("at"),
        F.when(cyclic, F.lit(LAST)).when(F.col("call_at") >= F.col("turn"), F.col("call_depth") + 1).otherwise(0).alias("depth"), F.lit(2).alias("phase"), "id", "turn", F.lit("result").alias("kind"),
        F.when(F.col("call_at").isNull(), "orphan").otherwise("linked").alias("status"), F.array().cast("array<string>").alias("errors"), "repeats", none.alias("unknown_needs"),
        F.concat(F.lit('{"content":'), json_text(F.col("content")), F.lit(',"id":'), json_text(back("id")), F.lit(',"type":"result"}')).alias("json"),
    )
    as_message = messages.select(
        conv.alias("conv"), F.coalesce("turn", F.lit(LAST)).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("depth"), F.lit(0).alias("phase"), F.lit("").alias("id"), turn,
        F.lit("message").alias("kind"), F.lit("linked").alias("status"), F.array().cast("array<string>").alias("errors"), none.alias("repeats"), none.alias("unknown_needs"),
        F.concat(F.lit('{"content":'), json_text(F.col("text")), F.lit(',"role":'), json_text(F.col("role")), F.lit(',"type":"message"}')).alias("json"),
    )
    events = cut_lineage(as_message.unionByName(as_call).unionByName(as_result))
    out = grouped_index(events, "conv", ["at", "depth", "turn", "phase", "id", "json"], "position")
    unset = lambda c: F.when(F.col(c) == LAST, F.lit(None)).otherwise(F.col(c))
    kind = messages.schema["conv_id"].dataType
    return out.select(
        back("conv").cast(kind).alias("conv_id"), "position", "kind", F.when(F.col("kind") != "message", back("id")).alias("call_id"), unset("turn").alias("turn"),
        F.when(F.col("kind") == "message", F.lit(None)).otherwise(unset("depth")).alias("depth"), "status", "errors", "repeats", "unknown_needs", "json",
    )
