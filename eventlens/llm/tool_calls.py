"""Tool-call linking for chat transcripts, with DataFrame and SQL functions only (operator 8).

Calls meet their results by a hash join on (conversation, identifier). A call may name the call it follows; its level is
the number of calls before it on that path, found by pointer doubling, so that a path of n calls takes log2 n joins. (level,
turn, call_id) is a topological order of a conversation. Arguments are checked against the schemas of the tools. Each linked
call is serialised as canonical JSON: keys sorted at every depth, no white space.

Results of calls: 'ok', 'invalid' (arguments do not fit), 'unanswered', 'unknown tool', 'cycle' (no level), 'orphan' (a result without call).
Of calls or results that repeat an identifier in a conversation, the first by turn, then content counts, ``copies`` tells how
many there were. A predecessor that does not exist is an error of the call, which then stands at level 0. Rows with a NULL
conversation or identifier can't be linked and are left out; NULL arguments are no JSON object; empty tables give no rows.
Conversations are never gathered: one may hold any share of the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import query, table
from eventlens.session import materialize

#: For each tool its arguments: name, type ('string', 'integer', 'number', 'boolean'), required, least, most (of the value, or of a text's length).
Schemas = dict[str, list[tuple[str, str, bool, float | None, float | None]]]

_KINDS = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def argument_errors(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Array of what is wrong with ``arguments`` (a VARIANT, NULL if no JSON), in the order of the schema."""
    checks = [F.when(arguments.isNull() | ~F.startswith(F.schema_of_variant(arguments), F.lit("OBJECT")), F.lit("not an object"))]
    for name, fields in schemas.items():
        ours = tool == name
        for field, kind, required, least, most in fields:
            path = f"$.{field}"
            value = F.try_variant_get(arguments, path, "variant")
            seen = F.schema_of_variant(value)
            missing = value.isNull() | (seen == "VOID")
            typed = (seen.rlike("^(BIGINT|DECIMAL|DOUBLE)") if kind == "number" else seen == _KINDS[kind])
            size = F.length(F.try_variant_get(arguments, path, "string")) if kind == "string" else F.try_variant_get(arguments, path, "double")
            wrong = F.when(missing, F.lit(f"{field}: missing") if required else None).when(~typed, F.lit(f"{field}: not {kind}"))
            if kind != "boolean" and least is not None:
                wrong = wrong.when(size < least, F.lit(f"{field}: below {least:g}"))
            if kind != "boolean" and most is not None:
                wrong = wrong.when(size > most, F.lit(f"{field}: above {most:g}"))
            checks.append(F.when(ours & arguments.isNotNull(), wrong))
    return F.array_compact(F.array(*checks))


def levels(calls: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, level) of ``calls`` (conv_id, call_id, after); level is NULL on and behind a cycle."""
    step = materialize(calls.select("conv_id", "call_id", F.col("after").alias("to"), F.when(F.col("after").isNull(), 0).otherwise(1).alias("level")), "levels")
    rounds = max(1, math.ceil(math.log2(max(step.count(), 2)))) + 1
    for _ in range(rounds):
        if not step.where("to IS NOT NULL").take(1):
            break
        going = step.where("to IS NOT NULL")
        ahead = step.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("level").alias("more"))
        moved = going.join(ahead, ["conv_id", "to"]).select("conv_id", "call_id", F.col("next").alias("to"), (F.col("level") + F.col("more")).alias("level"))
        step = materialize(step.where("to IS NULL").unionByName(moved), "levels")
    return step.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """Linked calls and orphan results.

    ``calls``: conv_id, turn, call_id, tool, arguments (JSON text), after (call_id or NULL); ``results``: conv_id, turn, call_id, content.
    Gives conv_id, call_id, turn, level, status, errors, copies, record (canonical JSON).
    """
    one = (
        calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "tool", "arguments", "after")).alias("c"), F.count("*").alias("copies"))
        .select("conv_id", "call_id", "c.*", "copies")
    )
    names = one.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("found"))
    one = materialize(one.join(names, ["conv_id", "after"], "left").withColumn("lost", F.expr("after IS NOT NULL AND found IS NULL")), "calls")
    order = levels(one.select("conv_id", "call_id", F.when(~F.col("lost"), F.col("after")).alias("after")))
    answers = (
        results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("answers"))
    )
    linked = one.join(order, ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "left")
    parsed = F.expr("try_parse_json(arguments)")
    linked = linked.withColumn("parsed", parsed).withColumn("errors", F.concat(
        argument_errors(F.col("tool"), F.col("parsed"), schemas), F.when(F.col("lost"), F.array(F.lit("after: missing"))).otherwise(F.array().cast("array<string>"))))
    status = (
        F.when(F.col("level").isNull(), "cycle").when(F.coalesce(~F.col("tool").isin(list(schemas)), F.lit(True)), "unknown tool")
        .when(F.size("errors") > 0, "invalid").when(F.col("r").isNull(), "unanswered").otherwise("ok"))
    record = F.to_json(F.struct(
        F.col("after"), F.col("parsed").alias("arguments"), F.col("call_id").alias("id"), F.col("tool").alias("name"),
        F.col("r.content").alias("result")), {"ignoreNullFields": "false"})
    linked = linked.select("conv_id", "call_id", "turn", "level", status.alias("status"), "errors", "copies", record.alias("record"))
    orphan = answers.join(one.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    orphan = orphan.select(
        "conv_id", "call_id", F.col("r.turn").alias("turn"), F.lit(None).cast("int").alias("level"), F.lit("orphan").alias("status"),
        F.array().cast("array<string>").alias("errors"), F.col("answers").alias("copies"),
        F.to_json(F.struct(F.col("call_id").alias("id"), F.col("r.content").alias("result")), {"ignoreNullFields": "false"}).alias("record"))
    return linked.unionByName(orphan)


SCHEMAS: Schemas = {
    "reply": [("lines", "integer", True, 1, 1), ("text", "string", True, 1, 300)],
    "summarise": [("lines", "integer", True, 2, 8), ("text", "string", True, 1, 4000)],
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls and assistant turns as results of the turn before; a call follows that two turns earlier, if there is one."""
    name = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    users = turns.where("role = 'user' AND turn IS NOT NULL")
    calls = users.select(
        "conv_id", "turn", name.alias("call_id"), F.when(lines > 1, "summarise").otherwise("reply").alias("tool"),
        F.to_json(F.struct("text", lines.alias("lines")), {"ignoreNullFields": "false"}).alias("arguments"),
        F.when(F.col("turn") >= 2, F.concat(F.lit("call_"), (F.col("turn") - 2).cast("string"))).alias("after"))
    results = turns.where("role = 'assistant' AND turn IS NOT NULL").select(
        "conv_id", "turn", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SQL = r"""
WITH RECURSIVE u AS (SELECT conv_id, turn, min(text) AS text, min((len(string_split(text, chr(10))) > 1)::INT) AS multi, count(*) AS copies
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
a AS (SELECT conv_id, turn - 1 AS turn, min(turn) AS told, min(text) AS content, count(*) AS answers
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
o AS (SELECT conv_id, turn, 0 AS level FROM u WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.conv_id = u.conv_id AND b.turn = u.turn - 2)
  UNION ALL SELECT u.conv_id, u.turn, o.level + 1 FROM o JOIN u ON u.conv_id = o.conv_id AND u.turn = o.turn + 2),
c AS (SELECT u.conv_id, u.turn, u.text, u.copies, o.level, len(string_split(u.text, chr(10))) AS lines, length(u.text) AS n, a.content, a.told,
  u.turn >= 2 AND o.level = 0 AS lost FROM u JOIN o USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn)),
e AS (SELECT *, list_filter([CASE WHEN lines > 8 THEN 'lines: above 8' END,
  CASE WHEN n < 1 THEN 'text: below 1' WHEN n > CASE WHEN lines > 1 THEN 4000 ELSE 300 END
    THEN CASE WHEN lines > 1 THEN 'text: above 4000' ELSE 'text: above 300' END END,
  CASE WHEN lost THEN 'after: missing' END], lambda x: x IS NOT NULL) AS errors FROM c)
SELECT conv_id, 'call_' || turn AS call_id, turn, level::INT AS level,
  CASE WHEN len(errors) > 0 THEN 'invalid' WHEN told IS NULL THEN 'unanswered' ELSE 'ok' END AS status, array_to_string(errors, '; ') AS errors, copies,
  '{"after":' || CASE WHEN turn >= 2 THEN '"call_' || (turn - 2) || '"' ELSE 'null' END || ',"arguments":{"lines":' || lines || ',"text":'
  || to_json(text)::VARCHAR || '},"id":"call_' || turn || '","name":"' || CASE WHEN lines > 1 THEN 'summarise' ELSE 'reply' END || '","result":'
  || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS record FROM e
UNION ALL
SELECT a.conv_id, 'call_' || a.turn, a.told, NULL, 'orphan', '', a.answers,
  '{"id":"call_' || a.turn || '","result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}'
FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.conv_id = a.conv_id AND u.turn = a.turn)
"""


@query("op8_tool_call_linking", SQL)
def op8_tool_call_linking(spark, sf_dir):
    linked = link(*turns_as_calls(table(spark, sf_dir, "conversations")), SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", "; "))
