import json
import random

from pyspark.sql import functions as F

from citysense.llm.tool_calls import argument_errors, call_levels, link_tool_calls

CALLS = "conv_id long, call_id string, turn int, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn int, content string"
SCHEMAS = "name string, properties map<string,string>, required array<string>"
TOOLS = [("find", {"q": "string", "n": "integer", "x": "number", "b": "boolean", "l": "array", "o": "object", "z": "null"}, ["q"]), ("none", {}, [])]


def link(spark, calls, results, tools=TOOLS, **kw):
    frames = [spark.createDataFrame(r, s) for r, s in ((calls, CALLS), (results, RESULTS), (tools, SCHEMAS))]
    frames = [f.withColumn("level", F.lit("extra")).withColumn("status", F.lit(1)) for f in frames]
    return link_tool_calls(*frames, **kw).collect()


def test_linking_and_order(spark):
    calls = [(1, "a", 1, "find", '{"q":"x"}', None), (1, "b", 1, "find", '{"q":"y"}', "c"), (1, "c", 3, "none", "{}", "a"),
             (2, "a", 1, "none", "{}", "gone"), (2, "p", 2, "none", "{}", "q"), (2, "q", 2, "none", "{}", "p"), (2, "r", 2, "none", "{}", "q"),
             (3, None, 1, "none", "{}", None), (1, "a", 1, "find", '{"q":"x"}', None)]
    results = [(1, "a", 2, "late"), (1, "a", 1, "early"), (1, "c", 4, "ok"), (9, "a", 2, "lost"), (None, "a", 2, "no conv")]
    rows = {(r.conv_id, r.call_id): r for r in link(spark, calls, results)}
    assert len(rows) == 10
    status = {k: (r.status, r.level, r.copies) for k, r in rows.items()}
    assert status == {
        (1, "a"): ("linked", 0, 2), (1, "c"): ("linked", 1, 1), (1, "b"): ("no result", 2, 1), (2, "a"): ("no result", 0, 1),
        (2, "p"): ("circular", None, 1), (2, "q"): ("circular", None, 1), (2, "r"): ("circular", None, 1),
        (3, None): ("no identifier", None, 1), (None, "a"): ("no identifier", None, 1), (9, "a"): ("no call", None, 1)}
    first = json.loads(rows[1, "a"].json)
    assert first == {"arguments": {"q": "x"}, "call_id": "a", "content": "early", "conv_id": 1, "name": "find", "result_turn": 1, "status": "linked", "turn": 1}
    assert rows[1, "a"].json == json.dumps(first, separators=(",", ":"), sort_keys=True)
    assert json.loads(rows[9, "a"].json) == {"call_id": "a", "content": "lost", "conv_id": 9, "result_turn": 2, "status": "no call"}


def test_levels_of_long_chains(spark):
    rows = [(1, str(i), str(i - 1) if i else None) for i in range(300)] + [(2, "x", "x"), (3, "y", None)]
    got = {(r.conv_id, r.call_id): r.level for r in call_levels(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()}
    assert got == {**{(1, str(i)): i for i in range(300)}, (2, "x"): None, (3, "y"): 0}


def test_levels_of_graphs(spark):
    """Longest chains over several predecessors, against a direct search; circles and what lies behind them are null."""
    rng = random.Random(2)
    after = {(c, str(i)): [str(j) for j in rng.sample(range(i), min(i, rng.choice([0, 1, 1, 2, 3])))] + ["gone"] * (i % 5 == 0) for c in range(4) for i in range(25)}
    after |= {(9, "p"): ["q", "free"], (9, "q"): ["p"], (9, "r"): ["q", "free"], (9, "s"): ["r"], (9, "t"): ["free", "free"], (9, "free"): [], (9, "u"): ["u", "free"]}

    def level(key, seen=()):
        if key in seen:
            raise RecursionError
        return max((level((key[0], b), (*seen, key)) + 1 for b in after[key] if (key[0], b) in after), default=0)

    want = {}
    for key in after:
        try:
            want[key] = level(key)
        except RecursionError:
            want[key] = None
    rows = [(c, i, a) for (c, i), a in after.items()]
    got = call_levels(spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == want and want[9, "s"] is None and want[9, "t"] == 1


CASES = [
    ('{"q":"s","n":1,"x":1.5,"b":true,"l":[1],"o":{"a":1},"z":null}', []),
    ('{"n":1}', ["missing q"]), ('{"q":1}', ["not string q"]), ('{"q":"a","n":1.5}', ["not integer n"]), ('{"q":"a","n":2.0}', []),
    ('{"q":"a","x":"1"}', ["not number x"]), ('{"q":"a","x":1e300}', []), ('{"q":"a","b":0,"l":{},"o":[]}', ["not array l", "not boolean b", "not object o"]),
    ('{"q":null}', ["not string q"]), ('{"q":"a","new key":1,"A":2}', ["unknown A", "unknown new key"]),
    ("[1]", ["not an object"]), ('{"q":', ["not an object"]), (None, ["not an object"]), ('{"q":"a","q":"b"}', ["not an object"]), ("", ["not an object"]),
]


def test_arguments(spark):
    calls = [(i, "c", 0, "find", a, None) for i, (a, _) in enumerate(CASES)] + [(99, "c", 0, "what", "{}", None), (98, "c", 0, None, "{}", None)]
    for limit in (10, 0):  # broadcast, and salted
        rows = {r.conv_id: r for r in link(spark, calls, [], max_broadcast=limit)}
        for i, (_, errors) in enumerate(CASES):
            assert rows[i].errors == errors and rows[i].valid == (not errors), CASES[i]
        assert rows[99].errors == ["unknown tool"] and rows[98].errors == ["unknown tool"]


def test_canonical_json(spark):
    text = '{ "n" : 2.50, "q":"\\u00e9 \\"x\\" \\n", "o":{"b":[1, 2 , {"z":1,"y":2}],"a":-0.0} , "z":null}'
    line = link(spark, [(1, "c", 0, "find", text, None)], [])[0].json
    assert '"arguments":{"n":2.5,"o":{"a":0,"b":[1,2,{"y":2,"z":1}]},"q":"é \\"x\\" \\n","z":null}' in line
    other = link(spark, [(1, "c", 0, "find", line[line.index("{", 1):line.index(',"call_id"')], None)], [])[0].json
    assert other == line


def test_empty_tables(spark):
    assert link(spark, [], []) == [] and link(spark, [], [], tools=[]) == []
    rows = link(spark, [(1, "c", 0, "find", "{}", None)], [], tools=[])
    assert [r.errors for r in rows] == [["unknown tool"]]


def test_no_python_in_the_plan(spark):
    empty = [spark.createDataFrame([], s) for s in (CALLS, RESULTS, SCHEMAS)]
    plan = link_tool_calls(*empty)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert argument_errors is not None
