import json
import random

import duckdb
import pytest

from ruleloom.llm import chat
from ruleloom.llm.registry import RUN, SQL
import ruleloom.llm.queries  # noqa: F401

CALLS = "conv_id long, call_id string, position long, tool string, arguments string, after string, depth int, json string"
RESULTS = "conv_id long, call_id string, position long, content string, tool string"
SCHEMAS = "tool string, parameter string, type string, required boolean, position int"


def run(spark, calls, results, schemas=()):
    rows = chat.link_calls(
        spark.createDataFrame([(*c, 1, "j") for c in calls], CALLS), spark.createDataFrame([(*r, "t") for r in results], RESULTS), spark.createDataFrame([(*s, 1) for s in schemas], SCHEMAS)
    ).collect()
    return {(r.conv_id, r.call_id): r for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql_agrees(spark, sf):
    sf = f"/root/testdata/{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = RUN["op2_tool_calls"](spark, sf)
    want = con.execute(SQL["op2_tool_calls"])
    assert got.columns == [d[0] for d in want.description]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_validation(spark):
    schemas = [("t", "s", "string", True), ("t", "i", "integer", False), ("t", "n", "number", False), ("t", "b", "boolean", False), ("t", "a", "array", False), ("t", "o", "object", None), (None, "x", "string", True), ("t", None, "string", True)]
    cases = {
        '{"s": "x", "i": 1, "n": 1.5, "b": true, "a": [1], "o": {"z": 1, "a": null}}': [],
        '{"s": "x", "n": 2}': [],
        '{"i": 1.5, "s": 3}': ["type:i", "type:s"],
        '{"s": null, "zz": 1}': ["type:s", "unknown:zz"],
        "{}": ["missing:s"],
        "[1]": ["malformed"],
        "{broken": ["malformed"],
        None: ["malformed"],
        "": ["malformed"],
    }
    calls = [(1, f"c{k}", k, "t", text, None) for k, text in enumerate(cases)] + [(1, "other", 50, "nobody", "{}", None), (1, "none", 51, None, "{}", None)]
    got = run(spark, calls, [], schemas)
    for k, errors in enumerate(cases.values()):
        assert got[1, f"c{k}"].errors == errors and got[1, f"c{k}"].status == "pending"
    assert got[1, "other"].errors == got[1, "none"].errors == ["unknown_tool"]
    first = json.loads(got[1, "c0"].json)
    assert json.dumps(first, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == got[1, "c0"].json


def test_linking_and_order(spark):
    rng = random.Random(1)
    chain = [(7, f"k{i}", 1000 - i, "t", "{}", f"k{i - 1}" if i else None) for i in range(70)]
    tree = [(8, f"n{i}", i, "t", "{}", f"n{rng.randrange(i)}" if i else None) for i in range(60)]
    circle = [(9, "a", 1, "t", "{}", "c"), (9, "b", 2, "t", "{}", "a"), (9, "c", 3, "t", "{}", "b"), (9, "d", 4, "t", "{}", "a"), (9, "self", 5, "t", "{}", "self"), (9, "lost", 6, "t", "{}", "nowhere")]
    odd = [(5, "x", 4, "t", "{}", None), (5, "x", 3, "u", "{}", None), (5, "x", 3, "u", "{}", None), (None, "x", 1, "t", "{}", None), (5, None, 1, "t", "{}", None), (6, "early", 9, "t", "{}", None), (6, "nowhere", None, "t", "{}", None)]
    results = [(5, "x", 9, "second"), (5, "x", 8, "first"), (5, "ghost", 1, None), (6, "early", 2, ""), (None, "x", 1, "r"), (7, "k3", 2000, 'quote " and\nline')]
    got = run(spark, chain + tree + circle + odd, results, [("t", "s", "string", False), ("u", "s", "string", False)])
    assert [got[7, f"k{i}"].depth for i in range(70)] == list(range(70))
    parent = {c[1]: c[5] for c in tree}
    for name in parent:
        depth, at = 0, name
        while parent[at]:
            depth, at = depth + 1, parent[at]
        assert got[8, name].depth == depth
    for name in "abcd":
        assert got[9, name].depth is None and got[9, name].errors == ["circle"]
    assert got[9, "self"].depth is None and got[9, "lost"].depth == 0
    x = got[5, "x"]
    assert (x.tool, x.position, x.n_calls, x.content, x.result_position, x.n_results, x.status) == ("u", 3, 3, "first", 8, 2, "linked")
    assert (got[5, "ghost"].status, got[5, "ghost"].tool, got[5, "ghost"].errors) == ("orphan", None, [])
    assert got[6, "early"].errors == ["early_result"] and got[6, "early"].content == ""
    assert got[6, "nowhere"].status == "pending" and got[6, "nowhere"].errors == []
    assert json.loads(got[7, "k3"].json)["result"] == 'quote " and\nline'
    assert len(got) == 70 + 60 + 6 + 4


def test_empty_and_awkward_turns(spark, folder):
    schema = "conv_id long, turn long, role string, text string, call_id string, tool string"
    turns = spark.createDataFrame([(1, 0, "user", None, "q", "w"), (1, 1, "assistant", None, "q", "w"), (1, 2, "user", "", "q", "w"), (1, 2, "user", "", "q", "w"), (2, None, "user", "x", "q", "w"), (None, 1, "user", "x", "q", "w"), (3, 1, None, "x", "q", "w"), (3, 5, "assistant", "y " * 5000, "q", "w")], schema)
    got = {(r.conv_id, r.call_id): r for r in RUN["op2_tool_calls"](spark, folder(conversations=turns)).collect()}
    assert {k: v.status for k, v in got.items()} == {(1, "call_0"): "linked", (1, "call_2"): "pending", (3, "call_4"): "orphan"}
    assert got[1, "call_2"].depth == 1
    assert RUN["op2_tool_calls"](spark, folder(conversations=turns.limit(0))).count() == 0
