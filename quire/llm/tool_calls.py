"""Chat formatting: tool calls linked with their results.

Calls and results are joined on (conversation, call id), calls are put into topological
order by the calls whose results they use, arguments are validated against the schemas
of the tools, and every call becomes one line of canonical JSON: keys in order of code
points, no white space, the same text for the same content.

Everything is DataFrame work.  A conversation is never gathered into one row, so one
that holds a third of all calls is spread over the tasks by call.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.registry import query, table
from quire.llm.shared import cut


@dataclass(frozen=True)
class Parameter:
    """One argument of a tool; ``kind`` is string, integer, number, boolean, array or object."""

    name: str
    kind: str
    required: bool = True
    least: float | None = None
    most: float | None = None
    choices: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Tool:
    name: str
    parameters: tuple[Parameter, ...]
    others: bool = False  # whether further arguments are allowed


# Types of a variant's value that count as each kind.
KINDS = {
    "string": "STRING",
    "integer": "BIGINT|DECIMAL\\(\\d+,0\\)",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL\\(.*\\)",
    "boolean": "BOOLEAN",
    "array": "ARRAY<.*>",
    "object": "OBJECT<.*>",
}


def _path(name: str) -> str:
    """A JSON path to one key, whatever characters it holds."""
    return "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"


def _problems(value: Column, parameter: Parameter) -> list[Column]:
    """Texts of what is wrong with the argument, null where nothing is."""
    at = F.try_variant_get(value, _path(parameter.name), "variant")
    kind = F.schema_of_variant(at)
    missing = at.isNull()
    out = []
    if parameter.required:
        out.append(F.when(missing, f"missing:{parameter.name}"))
    fits = kind.rlike(f"^({KINDS[parameter.kind]})$")
    null = kind == "VOID"
    out.append(F.when(~missing & (null | ~fits), f"type:{parameter.name}"))
    number = F.try_variant_get(value, _path(parameter.name), "double")
    if parameter.least is not None or parameter.most is not None:
        low = F.lit(False) if parameter.least is None else number < parameter.least
        high = F.lit(False) if parameter.most is None else number > parameter.most
        out.append(F.when(~missing & fits & (low | high), f"range:{parameter.name}"))
    if parameter.choices is not None:
        chosen = F.try_variant_get(value, _path(parameter.name), "string")
        out.append(F.when(~missing & fits & ~chosen.isin(*parameter.choices), f"choice:{parameter.name}"))
    return out


def problems(name: Column, arguments: Column, tools: list[Tool]) -> Column:
    """Sorted texts of what is wrong with a call: ``tool``, ``json`` or per argument."""
    value = F.try_parse_json(arguments)
    whole = F.schema_of_variant(value)
    bad = F.coalesce(~whole.startswith("OBJECT"), F.lit(True))
    cases = F.when(~F.coalesce(name.isin(*(t.name for t in tools)), F.lit(False)), F.array(F.lit("tool")))
    cases = cases.when(bad, F.array(F.lit("json")))
    for tool in tools:
        found = [c for p in tool.parameters for c in _problems(value, p)]
        if not tool.others:
            known = F.array(*(F.lit(p.name) for p in tool.parameters)).cast("array<string>")
            keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
            extra = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))
            found_all = F.concat(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"), extra)
        else:
            found_all = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        cases = cases.when(name == tool.name, F.sort_array(found_all))
    return cases


def canonical(arguments: Column) -> Column:
    """The JSON text with keys in order and without white space; null if it is none."""
    return F.to_json(F.try_parse_json(arguments))


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 without dependencies, else one more than the highest of them.

    A dependency on a call that the conversation does not have counts as none.  Calls
    in a cycle, and those behind one, get no row.  One round per level; each round
    joins what is left and is cut.
    """
    nodes = calls.select("conv_id", "call_id").distinct()
    wanted = calls.select("conv_id", "call_id", F.explode("uses").alias("use")).filter("use IS NOT NULL").distinct()
    known = nodes.withColumnRenamed("call_id", "use")
    wanted = cut(wanted.join(known, ["conv_id", "use"]))
    done = cut(nodes.join(wanted, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    found, level = done, 0
    while not done.isEmpty() and not wanted.isEmpty():
        level += 1
        left = cut(wanted.join(done.select("conv_id", F.col("call_id").alias("use")), ["conv_id", "use"], "left_anti"))
        free = wanted.select("conv_id", "call_id").distinct().join(left.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
        done = cut(free.withColumn("level", F.lit(level)))
        found, wanted = found.unionByName(done), left
    return found


def link_calls(calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """One row per call: ``conv_id, turn, call_id, level, result_turn, problems, status, json``.

    ``calls(conv_id, turn, call_id, name, arguments, uses)`` and
    ``results(conv_id, turn, call_id, content)``.  Within a conversation, ``level``
    then ``turn`` then ``call_id`` is a topological order.  ``status`` is ``ok``,
    ``invalid`` (the arguments break the schema, ``problems`` says how), ``unanswered``
    (no result), ``early`` (the result stands before the call, or the call before a
    result that it uses), or ``cycle`` (``level`` is null); the first that holds, from
    the last to the first named.  Of repeated calls and results of one id the earliest
    turn counts, then the smallest text.  A null id links nothing: such a call is
    unanswered, such a result belongs to no call.  Empty tables give empty results;
    other columns are not read.
    """
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", "uses")
    named = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL")
    nameless = calls.filter("conv_id IS NULL OR call_id IS NULL")
    # Pre-aggregated: of a hot id only one row per task moves.
    first = F.min(F.struct("turn", "name", "arguments", "uses")).alias("c")
    named = named.groupBy("conv_id", "call_id").agg(first).select("conv_id", "call_id", "c.*")
    named = cut(named)
    answers = results.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id")
    answers = answers.agg(F.min(F.struct("turn", "content")).alias("r"))
    answers = cut(answers.select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), F.lit(True).alias("answered")))
    linked = named.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    linked = linked.join(levels(named), ["conv_id", "call_id"], "left")
    # Calls that stand before a result they use.
    uses = named.select("conv_id", "call_id", "turn", F.explode("uses").alias("use"))
    ready = answers.select("conv_id", F.col("call_id").alias("use"), "result_turn")
    hasty = uses.join(ready, ["conv_id", "use"]).filter("result_turn >= turn").select("conv_id", "call_id").distinct()
    linked = linked.join(hasty.withColumn("hasty", F.lit(True)), ["conv_id", "call_id"], "left")
    loose = nameless.select("conv_id", "call_id", "turn", "name", "arguments", "uses", F.lit(None).cast("bigint").alias("result_turn"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("boolean").alias("answered"), F.lit(0).alias("level"), F.lit(None).cast("boolean").alias("hasty"))
    linked = linked.unionByName(loose).withColumn("problems", problems(F.col("name"), F.col("arguments"), tools))
    early = F.coalesce(F.col("hasty") | (F.col("result_turn") <= F.col("turn")), F.col("hasty"), F.lit(False))
    status = F.when(F.col("level").isNull(), "cycle").when(early, "early").when(F.col("answered").isNull(), "unanswered")
    status = status.when(F.size("problems") > 0, "invalid").otherwise("ok")
    linked = linked.withColumn("status", status)
    quoted = lambda c: F.coalesce(F.to_json(F.col(c).cast("variant")), F.lit("null"))
    uses_json = F.to_json(F.sort_array(F.array_distinct(F.coalesce("uses", F.array().cast("array<string>")))))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), quoted("arguments")),
        F.lit(',"call_id":'), quoted("call_id"),
        F.lit(',"name":'), quoted("name"),
        F.lit(',"result":'), quoted("content"),
        F.lit(',"status":"'), F.col("status"),
        F.lit('","uses":'), uses_json, F.lit("}"),
    )
    return linked.select("conv_id", "turn", "call_id", "level", "result_turn", F.array_join("problems", ",").alias("problems"), "status", json.alias("json"))


# The tools that the turns of a conversation are read as calls of.
TOOLS = [
    Tool("answer", (Parameter("prompt", "string"), Parameter("words", "integer", least=5, most=250))),
    Tool("revise", (Parameter("prompt", "string"), Parameter("words", "integer", least=5), Parameter("mode", "string", choices=("full", "short")))),
]


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of ``conversations`` stand for.

    A user turn calls for an answer: with its text and number of words, ``answer`` in
    the first half of each four turns, ``revise``, which uses the call before, in the
    second.  An assistant turn is the result of the call of the turn before it.
    """
    call_id = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    second = F.pmod(F.col("turn"), F.lit(4)) >= 2
    asked = turns.filter("role = 'user'").select(
        "conv_id", "turn", call_id(0).alias("call_id"),
        F.when(second, "revise").otherwise("answer").alias("name"),
        F.when(
            second, F.to_json(F.struct(words.alias("words"), text.alias("prompt"), F.when(words > 40, "full").otherwise("brief").alias("mode")))
        ).otherwise(F.to_json(F.struct(words.alias("words"), text.alias("prompt")))).alias("arguments"),
        F.when(second, F.array(call_id(2))).otherwise(F.array().cast("array<string>")).alias("uses"),
    )
    given = turns.filter("role = 'assistant'").select("conv_id", "turn", call_id(1).alias("call_id"), F.col("text").alias("content"))
    return asked, given


SQL = r"""
WITH c AS (
    SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, turn % 4 >= 2 AS second, coalesce(text, '') AS prompt,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn AS result_turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text AS content
      FROM conversations WHERE role = 'assistant'),
j AS (
    SELECT c.*, r.result_turn, r.content, CASE WHEN second THEN ['call-' || c.conv_id || '-' || (turn - 2)] ELSE [] END AS uses,
           CASE WHEN second AND EXISTS (SELECT 1 FROM c p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2) THEN 1 ELSE 0 END AS level,
           concat_ws(',', CASE WHEN second AND words <= 40 THEN 'choice:mode' END,
                          CASE WHEN words < 5 OR (NOT second AND words > 250) THEN 'range:words' END) AS problems
    FROM c LEFT JOIN r USING (conv_id, call_id)),
s AS (SELECT *, CASE WHEN result_turn IS NULL THEN 'unanswered' WHEN problems <> '' THEN 'invalid' ELSE 'ok' END AS status FROM j)
SELECT conv_id, turn, call_id, level, result_turn, problems, status,
       '{"arguments":{' || CASE WHEN second THEN CASE WHEN words > 40 THEN '"mode":"full",' ELSE '"mode":"brief",' END ELSE '' END
       || '"prompt":' || CAST(to_json(prompt) AS VARCHAR) || ',"words":' || words || '},"call_id":' || CAST(to_json(call_id) AS VARCHAR)
       || ',"name":"' || CASE WHEN second THEN 'revise' ELSE 'answer' END || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
       || ',"status":"' || status || '","uses":' || CAST(to_json(uses) AS VARCHAR) || '}' AS json
FROM s"""


@query("op10_tool_calls", SQL)
def op10(spark, sf_dir):
    calls, results = calls_of_turns(table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, TOOLS)
