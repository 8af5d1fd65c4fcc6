import json
import random

from pyspark.sql import functions as F

from quire.llm.tool_calls import Parameter, Tool, levels, link_calls

TOOLS = [
    Tool("find", (Parameter("text", "string"), Parameter("n", "integer", required=False, least=1, most=9), Parameter("how", "string", required=False, choices=("a", "b")))),
    Tool("open", (Parameter("x", "number", required=False), Parameter("on", "boolean", required=False), Parameter("l", "array", required=False), Parameter("o", "object", required=False)), others=True),
]
CALLS = "conv_id long, turn long, call_id string, name string, arguments string, uses array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"


def linked(spark, calls, results):
    frames = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    # Columns with names that are used inside must not clash.
    clash = {"level": F.lit(9), "status": F.lit("x"), "answered": F.lit(False), "result_turn": F.lit(7), "json": F.lit("j"), "hasty": F.lit(True)}
    return link_calls(frames[0].withColumns(clash), frames[1].withColumns(clash), TOOLS).collect()


def one(spark, name, arguments):
    return linked(spark, [(1, 1, "c", name, arguments, [])], [(1, 2, "c", "r")])[0]


def test_arguments_against_schemas(spark):
    cases = {
        ("find", '{"text":"t","n":3,"how":"a"}'): "",
        ("find", '{"n":0,"text":5,"how":"c","z":1}'): "choice:how,range:n,type:text,unknown:z",
        ("find", "{}"): "missing:text",
        ("find", '{"text":null,"n":10}'): "range:n,type:text",
        ("find", '{"text":"t","n":1.5}'): "type:n",
        ("find", "[1]"): "json",
        ("find", "{broken"): "json",
        ("find", None): "json",
        ("gone", "{}"): "tool",
        (None, "{}"): "tool",
        ("open", '{"x":1.5,"on":true,"l":[1],"o":{"k":1},"more":0}'): "",
        ("open", '{"x":"1","on":0,"l":{},"o":[]}'): "type:l,type:o,type:on,type:x",
    }
    calls = [(k, 1, "c", *case, []) for k, case in enumerate(cases)]
    rows = {r["conv_id"]: r for r in linked(spark, calls, [(k, 2, "c", "r") for k in range(len(cases))])}
    for k, want in enumerate(cases.values()):
        assert rows[k]["problems"] == want and rows[k]["status"] == ("invalid" if want else "ok")


def test_canonical_json(spark):
    row = one(spark, "open", ' { "b" : [1, 2.50, {"z":null,"a":"é\\u00e9\\n\\""}] , "a" : true } ')
    assert row["json"].startswith('{"arguments":{"a":true,"b":[1,2.5,{"a":"éé\\n\\"","z":null}]},"call_id":"c","name":"open","result":"r","status":"ok","uses":[]}')
    assert one(spark, "open", '{"a":1,"b":2}')["json"] == one(spark, "open", '{ "b":2,\n"a":1 }')["json"]
    broken = json.loads(one(spark, "open", 'not "json"')["json"])
    assert broken["arguments"] == 'not "json"' and broken["status"] == "invalid"


def test_statuses(spark):
    calls = [
        (1, 1, "a", "open", "{}", None),
        (1, 3, "b", "open", "{}", ["a", "a", None, "elsewhere"]),
        (1, 4, "c", "open", "{}", ["d"]),  # before the result it uses
        (1, 5, "d", "open", "{}", []),
        (1, 9, "e", "open", "{}", []),  # its result is earlier
        (1, 10, "f", "find", "{}", []),  # neither answered nor valid
        (2, 1, "x", "open", "{}", ["y"]),
        (2, 2, "y", "open", "{}", ["x"]),
        (2, 3, "z", "open", "{}", ["y"]),  # behind a cycle
        (2, 4, "s", "open", "{}", ["s"]),
        (3, 1, "a", "open", "{}", []),  # another conversation
    ]
    results = [(1, 2, "a", "A"), (1, 4, "b", "B"), (1, 6, "c", None), (1, 7, "d", "D"), (1, 8, "e", "E"), (2, 9, "x", "X"), (1, 1, "nobody", "N")]
    rows = {(r["conv_id"], r["call_id"]): r for r in linked(spark, calls, results)}
    assert len(rows) == len(calls)
    status = {"".join(map(str, k)): r["status"] for k, r in rows.items()}
    assert status == {"1a": "ok", "1b": "ok", "1c": "early", "1d": "ok", "1e": "early", "1f": "unanswered", "2x": "cycle", "2y": "cycle", "2z": "cycle", "2s": "cycle", "3a": "unanswered"}
    assert rows[1, "f"]["problems"] == "missing:text" and rows[1, "b"]["level"] == 1 and rows[1, "a"]["result_turn"] == 2
    assert rows[2, "z"]["level"] is None and json.loads(rows[1, "b"]["json"])["uses"] == [None, "a", "elsewhere"]
    assert json.loads(rows[1, "c"]["json"])["result"] is None


def test_repeats_and_nulls(spark):
    calls = [(1, 2, "a", "open", '{"k":2}', []), (1, 1, "a", "open", '{"k":1}', []), (1, 1, "a", "open", '{"k":0}', [])] * 2
    calls += [(1, 5, None, "open", "{}", []), (None, 6, "n", None, None, None), (1, None, "t", "open", "{}", [])]
    results = [(1, 4, "a", "late"), (1, 3, "a", "z"), (1, 3, "a", "b")] * 2 + [(1, 7, None, "r"), (None, 8, "n", "r"), (1, 2, "t", "r")]
    rows = linked(spark, calls, results)
    assert len(rows) == 4
    first = next(r for r in rows if r["call_id"] == "a")
    told = json.loads(first["json"])
    assert (first["turn"], first["result_turn"], told["arguments"], told["result"]) == (1, 3, {"k": 0}, "b")
    assert {(r["conv_id"], r["call_id"]): r["status"] for r in rows if r["call_id"] != "a"} == {(1, None): "unanswered", (None, "n"): "unanswered", (1, "t"): "ok"}


def test_empty_tables(spark):
    assert linked(spark, [], []) == [] and linked(spark, [], [(1, 1, "a", "r")]) == []
    assert [r["status"] for r in linked(spark, [(1, 1, "a", "open", "{}", [])], [])] == ["unanswered"]


def test_levels_against_plain_order(spark):
    rng = random.Random(7)
    uses = {(c, k): sorted({rng.randrange(8) for _ in range(rng.randrange(3))}) for c in range(6) for k in range(8)}
    uses |= {(9, k): [k - 1] if k else [] for k in range(6)}  # a chain

    known = {node: 0 for node in uses if not uses[node]}
    while True:
        more = {n: 1 + max(known[n[0], u] for u in own) for n, own in uses.items() if n not in known and all((n[0], u) in known for u in own)}
        if not more:
            break
        known |= more
    calls = spark.createDataFrame([(c, str(k), [*map(str, own), "none"]) for (c, k), own in uses.items()], "conv_id long, call_id string, uses array<string>")
    assert {(r["conv_id"], int(r["call_id"])): r["level"] for r in levels(calls).collect()} == known
