"""Operator 7: chat formatting with tool-call linking, in DataFrame functions.

Messages are rows (conversation, turn, role, text).  A text that is a JSON
object may hold ``tool_calls`` (each with ``id``, ``name`` and ``arguments``)
or, in a result, ``tool_call_id``; both may hold ``content``.  All other texts
are plain content.

* Calls and results meet in a hash join on conversation and identifier.  Of
  calls that share an identifier the earliest is linked; of its results the
  earliest answers it.
* Order is topological: a call comes after the calls whose identifier its
  arguments name as ``{"$ref": id}``, and a result after its call.  Levels are
  found in rounds from the calls that wait for none: each round follows the
  edges out of its frontier, until a frontier is empty.  Calls without a level
  then stand on a cycle or wait for one, however long the chains are.
* Arguments are checked against each tool's schema.
* Each message becomes one line of canonical JSON: keys sorted, no spaces,
  empty fields left out, arguments likewise.

One row comes out for each message, so a conversation of any length stays
spread over tasks; sort by (conv_id, order_turn, level, turn) to read it.

Defined results: null texts have no content; null roles are left out of the
line; messages with a null conversation are never linked.  Repeated rows are
formatted each; of exactly repeated calls the identifier links all rows of
that call's turn.  ``issues`` names what is wrong, in alphabetical order and
joined by commas: ``bad_arguments``, ``cyclic_call``, ``repeated_call``,
``repeated_result``, ``unanswered_call``, ``unknown_call`` (a result without a
call), ``unknown_tool``.  Results of the turn that answers a call are all
linked, also where they differ.  White space around a JSON object does not
matter.  A text counts as structured only if the whole of it is one JSON object
with no other keys than these (once each), ``content``, ``tool_call_id``, ``id``
and ``name`` strings or null, and ``tool_calls`` a list of objects or null; any
other text is plain content, as is one longer than a variant can be.  Arguments
that are no JSON are kept as they are, with ``bad_arguments``.  Very long texts
stay whole in their line.  Equal turns order by position in the
message.  Extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import materialise, partitions

#: Tool name to parameters: name to (type, required).  Types: string, integer,
#: number, boolean, object, array.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

_MESSAGE = "content string, tool_call_id string, tool_calls array<struct<id string, name string, arguments string>>"

#: Variant types that a schema type admits.
_TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def _whole_json(text: Column) -> Column:
    """The variant of a text that is one JSON value from end to end, else null.
    The parser overlooks what stands behind a value; as the first of two
    elements, with the text's digest as the second, a value is whole only if
    the digest is found in its place."""
    digest = F.sha2(text, 256)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == digest, F.try_variant_get(both, "$[0]", "variant"))


def _is_message(value: Column) -> Column:
    """Whether a variant is an object of the form that messages have."""

    def known(keys: Column, *names: str) -> Column:
        return F.size(F.array_except(F.map_keys(keys), F.array(*map(F.lit, names)))) == 0

    def null_or(v: Column, kind: str) -> Column:
        found = F.schema_of_variant(v)
        return found.isNull() | found.isin("VOID", kind)

    fields = F.try_variant_get(value, "$", "map<string,variant>")
    calls = F.try_variant_get(value, "$.tool_calls", "array<map<string,variant>>")
    form = lambda c: F.coalesce(known(c, "id", "name", "arguments") & null_or(F.try_element_at(c, F.lit("id")), "STRING") & null_or(F.try_element_at(c, F.lit("name")), "STRING"), F.lit(False))
    listed = F.coalesce(F.forall(calls, form), null_or(F.try_element_at(fields, F.lit("tool_calls")), "VOID"))
    texts = null_or(F.try_element_at(fields, F.lit("content")), "STRING") & null_or(F.try_element_at(fields, F.lit("tool_call_id")), "STRING")
    return F.coalesce(known(fields, "content", "tool_call_id", "tool_calls") & texts & listed, F.lit(False))


def _canonical(text: Column) -> Column:
    """JSON with sorted keys and no spaces; a text that is no JSON as it is."""
    return F.coalesce(F.to_json(_whole_json(text)), text)


def _valid(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether arguments are an object that fits the tool's schema."""
    value = _whole_json(F.coalesce(arguments, F.lit("{}")))
    ok = F.lit(None).cast("boolean")
    for tool, parameters in schemas.items():
        fits = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        for key, (kind, required) in parameters.items():
            got = F.schema_of_variant(F.try_variant_get(value, f"$['{key}']", "variant"))
            missing = got.isNull() | (got == "VOID")
            fits &= F.coalesce(got.rlike(f"^({_TYPES[kind]})$"), F.lit(False)) | (missing & F.lit(not required))
        ok = F.when(name == tool, fits).otherwise(ok)
    return ok


def _levels(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id`` and ``level`` (null on cycles) of the calls that
    depend on others."""
    found = F.regexp_extract_all(F.col("arguments"), F.lit(r'\{\s*"\$ref"\s*:\s*"([^"\\]*)"\s*\}'), 1)
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct(found)).alias("on_id"))
    known = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    edges = materialise(edges.join(known, (F.col("conv_id") == F.col("c")) & (F.col("on_id") == F.col("i"))).select("conv_id", "call_id", "on_id"), "chat-edges")
    keys = ["conv_id", "call_id"]
    need = materialise(edges.groupBy(*keys).agg(F.count("*").alias("need")), "chat-need")
    frontier = edges.select("conv_id", F.col("on_id").alias("call_id")).distinct().join(need, keys, "left_anti")
    level, done, waiting = 0, [], None
    while True:
        # Calls that the frontier frees a dependency of, with those freed before.
        touched = edges.join(frontier.withColumnRenamed("call_id", "on_id"), ["conv_id", "on_id"]).groupBy(*keys).agg(F.count("*").alias("got"))
        if waiting is not None:
            touched = touched.unionByName(waiting).groupBy(*keys).agg(F.sum("got").alias("got"))
        level += 1
        touched = materialise(touched.join(need, keys), "chat-touched")
        frontier, waiting = touched.filter("got = need").select(*keys), touched.filter("got < need").select(*keys, "got")
        if frontier.isEmpty():
            break
        done.append(frontier.withColumn("level", F.lit(level)))
        if len(done) == 32:
            done = [materialise(reduce(DataFrame.unionByName, done), "chat-levels")]
    levels = need.select(*keys)
    if not done:
        return levels.withColumn("level", F.lit(None).cast("int"))
    return levels.join(reduce(DataFrame.unionByName, done), keys, "left")


#: Rows of a join's smaller side that each partition may hash.
HASHED_ROWS = 1_000_000


def _hashed(table: DataFrame) -> DataFrame:
    """A stored table as the hashed side of a join, if its parts fit."""
    fits = table.count() <= HASHED_ROWS * partitions(table.sparkSession)
    return table.hint("shuffle_hash") if fits else table


def format_chats(messages: DataFrame, schemas: Schemas | None = None) -> DataFrame:
    """One row for each message: ``conv_id``, ``turn``, ``role``, ``order_turn``,
    ``level``, ``n_calls``, ``n_linked``, ``issues`` and ``json``."""
    schemas = schemas or {}
    parsed = F.when(F.col("text").rlike(r"^[ \t\r\n]*\{") & _is_message(_whole_json(F.col("text"))), F.from_json("text", _MESSAGE))
    structured = F.col("m.content").isNotNull() | F.col("m.tool_call_id").isNotNull() | F.col("m.tool_calls").isNotNull()
    rows = messages.select(F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("m", parsed).withColumn("m", F.when(structured, F.col("m")))
    rows = materialise(rows, "chat-rows")

    calls = rows.filter("m.tool_calls is not null").select("row", "conv_id", "turn", F.posexplode("m.tool_calls").alias("n", "call"))
    calls = calls.select("row", "conv_id", "turn", "n", F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments"))
    if calls.isEmpty() and rows.filter("m.tool_call_id is not null").isEmpty():
        per_row = None
    else:
        calls = materialise(calls, "chat-calls")
        first = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min_by(F.struct("turn", "n", "arguments"), F.struct("turn", "n")).alias("f"))
        first = materialise(first.select("conv_id", "call_id", F.col("f.turn").alias("call_turn"), F.col("f.n").alias("call_n"), F.col("f.arguments").alias("arguments")), "chat-first")
        levels = materialise(_levels(first), "chat-order")
        results = rows.filter("m.tool_call_id is not null").select("row", "conv_id", "turn", F.col("m.tool_call_id").alias("call_id"))
        answer = materialise(results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn")), "chat-answers")
        linked = first.drop("arguments").join(_hashed(answer), ["conv_id", "call_id"], "left").join(levels.withColumn("ordered", F.lit(True)), ["conv_id", "call_id"], "left")
        linked = materialise(linked, "chat-linked")

        keys = ["conv_id", "call_id"]
        linked = _hashed(linked)
        asked = calls.join(linked, keys, "left")
        valid = _valid(F.col("name"), F.col("arguments"), schemas)
        original = F.coalesce((F.col("turn") == F.col("call_turn")) & (F.col("n") == F.col("call_n")), F.lit(False))
        cyclic = F.col("ordered").isNotNull() & F.col("level").isNull()
        asked = asked.select(
            "row",
            F.struct("n", "call_id", "name", _canonical(F.coalesce("arguments", F.lit("{}"))).alias("arguments")).alias("call"),
            F.coalesce("level", F.lit(0)).alias("level"),
            (original & F.col("result_turn").isNotNull()).alias("linked"),
            F.lit(None).cast("long").alias("after"),
            F.array_compact(F.array(
                F.when(valid.isNull(), F.lit("unknown_tool")), F.when(~valid, F.lit("bad_arguments")), F.when(cyclic, F.lit("cyclic_call")),
                F.when(~original, F.lit("repeated_call")), F.when(original & F.col("result_turn").isNull(), F.lit("unanswered_call")),
            )).alias("issues"),
        )
        answered = results.join(linked, keys, "left").select(
            "row",
            F.lit(None).cast("struct<n int, call_id string, name string, arguments string>").alias("call"),
            (F.coalesce("level", F.lit(0)) + 1).alias("level"),
            F.coalesce(F.col("turn") == F.col("result_turn"), F.lit(False)).alias("linked"),
            F.col("call_turn").cast("long").alias("after"),
            F.array_compact(F.array(F.when(F.col("call_turn").isNull(), F.lit("unknown_call")), F.when(F.col("call_turn").isNotNull() & (F.col("turn") != F.col("result_turn")), F.lit("repeated_result")))).alias("issues"),
        )
        # The calls of one message are few: they stood in one text.
        per_row = asked.unionByName(answered).groupBy("row").agg(
            F.array_sort(F.collect_list("call")).alias("calls"), F.max("level").alias("level"), F.count(F.when(F.col("linked"), 1)).alias("n_linked"),
            F.max("after").alias("after"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("issues")))).alias("issues"),
        )
        per_row = materialise(per_row.withColumnRenamed("row", "_row"), "chat-messages")
        rows = rows.join(per_row, F.col("row") == F.col("_row"), "left")
    if per_row is None:
        rows = rows.selectExpr("*", "cast(null as array<struct<n int, call_id string, name string, arguments string>>) calls", "0 level", "0L n_linked", "cast(null as long) after", "cast(null as array<string>) issues")

    content = F.when(F.col("m").isNull(), F.col("text")).otherwise(F.col("m.content"))
    tool_calls = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["call_id"].alias("id"), c["name"].alias("name")))
    line = F.to_json(F.struct(content.alias("content"), F.col("conv_id"), F.col("role"), F.col("m.tool_call_id").alias("tool_call_id"), F.when(F.size("calls") > 0, tool_calls).alias("tool_calls"), F.col("turn")))
    return rows.select(
        "conv_id", "turn", "role",
        F.greatest("turn", "after").alias("order_turn"),
        F.coalesce("level", F.lit(0)).cast("int").alias("level"),
        F.greatest(F.coalesce(F.size("calls"), F.lit(0)), F.lit(0)).cast("int").alias("n_calls"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_join("issues", ","), F.lit("")).alias("issues"),
        line.alias("json"),
    )
