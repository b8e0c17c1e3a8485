"""Tool calls and their results: linked, ordered, validated and written as canonical JSON.

Everything is a column expression, an aggregation or a hash join. A call may wait for one
other call of its conversation; the depth along these chains is a topological order, and
is found by doubling pointers: each round joins every call with what its pointer points
to, so a chain of n calls takes log2(n) rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import small
from ruleloom.session import cut_lineage

KEY = ("conv_id", "call_id")
# How a variant's type reads, and the JSON types it may count as.
JSON_TYPES = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": r"^BOOLEAN$", "array": r"^ARRAY.*", "object": r"^OBJECT.*"}


def _firsts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each call id: the first by position, then by the other columns; and how many there were."""
    row = F.struct(F.col("position").cast("bigint").alias("position"), *[F.col(c).cast("string").alias(c) for c in columns])
    rows = df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("call_id").cast("string").alias("call_id"), row.alias("row"))
    known = rows.where("conv_id is not null and call_id is not null")
    return known.groupBy(*KEY).agg(F.min("row").alias("row"), F.count("*").alias("times")).select(*KEY, "row.*", "times")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): how many calls each one waits for, one behind the other.

    `calls` has one row for each call and its `after`. A call that waits for itself, for
    a circle or behind one has no depth. An `after` that names no call does not count.
    """
    named = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    state = calls.select(*KEY, "after").join(named, ["conv_id", "after"], "left").select(*KEY, F.when(F.col("known"), F.col("after")).alias("jump"))
    state = cut_lineage(state.withColumn("depth", F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long")))
    rounds = math.ceil(math.log2(max(2, state.count()))) + 1
    for _ in range(rounds):
        open_ = state.where("jump is not null")
        if open_.isEmpty():
            break
        ahead = state.select("conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"), F.col("depth").alias("more"))
        moved = open_.join(ahead, ["conv_id", "jump"]).select(*KEY, F.col("next").alias("jump"), (F.col("depth") + F.col("more")).alias("depth"))
        state = cut_lineage(state.where("jump is null").unionByName(moved))
    return state.select(*KEY, F.when(F.col("jump").isNull(), F.col("depth")).alias("depth"))


def _errors(arguments: Column, parameters: Column) -> Column:
    """What is wrong with an object of arguments (map of variants), given a tool's parameters."""
    names = F.map_keys(arguments)
    known = F.transform(parameters, lambda p: p["parameter"])
    missing = F.transform(F.filter(parameters, lambda p: p["required"] & ~F.array_contains(names, p["parameter"])), lambda p: F.concat(F.lit("missing:"), p["parameter"]))
    extra = F.transform(F.array_except(names, known), lambda n: F.concat(F.lit("unknown:"), n))

    def mistyped(p: Column) -> Column:
        kind = F.schema_of_variant(F.element_at(arguments, p["parameter"]))
        fits = F.lit(False)
        for name, pattern in JSON_TYPES.items():
            fits = fits | ((p["type"] == name) & kind.rlike(pattern))
        return F.array_contains(names, p["parameter"]) & ~F.coalesce(fits, F.lit(False))

    wrong = F.transform(F.filter(parameters, mistyped), lambda p: F.concat(F.lit("type:"), p["parameter"]))
    return F.concat(missing, extra, wrong)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call id of a conversation, with its result and its canonical JSON.

    `calls`: conv_id, call_id, position, tool, arguments (JSON text), after (a call id, or
    null). `results`: conv_id, call_id, position, content. `schemas`: tool, parameter,
    type (string, integer, number, boolean, array, object), required. Other columns are
    not read, rows with a null conversation or call id neither.

    Returns conv_id, call_id, tool, position, depth (the topological order is by depth,
    then position, then id), result_position, content, n_calls, n_results, status, errors
    (sorted) and json. Of several calls or results of one id the first counts. Status is
    `linked`, `pending` (no result) or `orphan` (a result without a call; its other
    columns are null). Errors: `malformed` (no JSON object), `unknown_tool`, `missing:x`,
    `unknown:x`, `type:x`, `early_result` (it stands before its call), `circle`. The JSON
    has sorted keys, no blanks and no null fields. Empty tables give empty ones.

    A conversation is never gathered: every call is a row, so one of any length, and an
    id that very many rows repeat, is spread over tasks.
    """
    one = cut_lineage(_firsts(calls, ["tool", "arguments", "after"]).withColumnRenamed("times", "n_calls"))
    replies = _firsts(results, ["content"]).withColumnRenamed("position", "result_position").withColumnRenamed("times", "n_results")
    tools = cut_lineage(schemas.where("tool is not null and parameter is not null").groupBy("tool").agg(F.sort_array(F.collect_set(F.struct("parameter", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("parameters")))
    linked = one.join(depths(one), list(KEY)).join(replies, list(KEY), "full").join(small(tools), "tool", "left")
    parsed = linked.withColumn("object", F.try_parse_json("arguments"))
    fields = F.try_variant_get("object", "$", "map<string,variant>")
    called = F.col("position").isNotNull() | F.col("n_calls").isNotNull()
    mark = lambda when, name: F.when(when, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    checked = F.when(fields.isNotNull() & F.col("parameters").isNotNull(), _errors(fields, F.col("parameters"))).otherwise(F.array().cast("array<string>"))
    errors = F.array_sort(
        F.concat(
            mark(called & fields.isNull(), "malformed"),
            mark(called & F.col("parameters").isNull(), "unknown_tool"),
            mark(called & (F.col("result_position") < F.col("position")), "early_result"),
            mark(called & F.col("depth").isNull(), "circle"),
            checked,
        )
    )
    status = F.when(~called, "orphan").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    told = parsed.withColumn("errors", errors).withColumn("status", status)
    whole = F.struct(
        F.when(fields.isNotNull(), F.col("object")).alias("arguments"),
        F.col("call_id").alias("call"),
        F.col("conv_id").alias("conversation"),
        "depth",
        "errors",
        F.col("content").alias("result"),
        "status",
        "tool",
    )
    return told.withColumn("json", F.to_json(whole)).select(*KEY, "tool", "position", "depth", "result_position", "content", "n_calls", "n_results", "status", "errors", "json")


# How the conversations table is read as calls and results: a user's turn calls a tool
# chosen by its number of words, waits for the user's turn before, and the assistant's next
# turn is the result.
TOOLS = ("search", "lookup", "translate")
SCHEMAS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("search", "exact", "boolean", False),
    ("lookup", "query", "string", True),
    ("lookup", "limit", "integer", False),
    ("lookup", "key", "string", True),
    ("translate", "query", "string", True),
    ("translate", "limit", "string", False),
)


def of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as they are read from a table of turns."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.split(text, " "))
    tool = F.element_at(F.array(*map(F.lit, TOOLS)), words % 3 + 1)
    arguments = F.to_json(F.struct(text.alias("query"), words.alias("limit"), F.when(words % 2 == 0, F.lit(True)).alias("exact")))
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    turn = F.col("turn")
    calls = turns.where("role = 'user'").select("conv_id", name(turn).alias("call_id"), turn.alias("position"), tool.alias("tool"), arguments.alias("arguments"), name(turn - 2).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))
    return calls, results


SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, len(string_split(coalesce(text, ''), ' ')) AS words FROM conversations),
calls AS (
  SELECT conv_id, turn, words, ['search', 'lookup', 'translate'][words % 3 + 1] AS tool,
         '{' || CASE WHEN words % 2 = 0 THEN '"exact":true,' ELSE '' END || '"limit":' || words || ',"query":' || CAST(to_json(text) AS VARCHAR) || '}' AS arguments
  FROM turns WHERE role = 'user'),
results AS (SELECT conv_id, turn, text FROM turns WHERE role = 'assistant'),
chains AS (
  SELECT conv_id, turn, 0 AS depth FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, h.depth + 1 FROM chains h JOIN calls c ON c.conv_id = h.conv_id AND c.turn = h.turn + 2),
joined AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, 'call_' || coalesce(c.turn, r.turn - 1) AS call_id, c.tool, c.turn AS position, h.depth, r.turn AS result_position, r.text AS content, c.arguments, c.words,
         CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'pending' ELSE 'linked' END AS status,
         CASE WHEN c.turn IS NULL THEN []
              WHEN c.tool = 'search' THEN []
              WHEN c.tool = 'lookup' THEN CASE WHEN c.words % 2 = 0 THEN ['missing:key', 'unknown:exact'] ELSE ['missing:key'] END
              ELSE CASE WHEN c.words % 2 = 0 THEN ['type:limit', 'unknown:exact'] ELSE ['type:limit'] END END AS errors
  FROM calls c JOIN chains h ON h.conv_id = c.conv_id AND h.turn = c.turn
  FULL JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1)
SELECT conv_id, call_id, tool, position, CAST(depth AS BIGINT) AS depth, result_position, status, array_to_string(errors, ',') AS errors,
       '{' || CASE WHEN tool IS NULL THEN '' ELSE '"arguments":' || arguments || ',' END || '"call":"' || call_id || '","conversation":' || conv_id ||
       CASE WHEN depth IS NULL THEN '' ELSE ',"depth":' || depth END || ',"errors":' || CASE WHEN len(errors) = 0 THEN '[]' ELSE '["' || array_to_string(errors, '","') || '"]' END ||
       CASE WHEN content IS NULL THEN '' ELSE ',"result":' || CAST(to_json(content) AS VARCHAR) END || ',"status":"' || status || '"' ||
       CASE WHEN tool IS NULL THEN '' ELSE ',"tool":"' || tool || '"' END || '}' AS json
FROM joined
"""
