import json

from codeassay.llm.toolcalls import link_tool_calls

CALLS = "conv_id bigint, call_id string, turn bigint, tool string, arguments string, needs array<string>"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"
SPEC = [("find", "q", "string", True), ("find", "n", "integer", False), ("find", "x", "number", False), ("find", "deep", "object", False), ("find", "list", "array", False), ("find", "flag", "boolean", False), ("find", "none", "null", False)]


def link(spark, calls=(), results=(), messages=()):
    extra = "id", "at", "json"
    said = spark.createDataFrame(list(messages), "conv_id bigint, turn bigint, role string, text string")
    for name in extra:
        said = said.selectExpr("*", f"1 AS {name}")
    out = link_tool_calls(
        said, spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), spark.createDataFrame(SPEC, "tool string, name string, type string, required boolean")
    )
    return sorted(out.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["position"]))


def test_order_follows_needs(spark):
    calls = [(1, "c", 1, "find", '{"q":"3"}', ["b"]), (1, "b", 1, "find", '{"q":"2"}', ["a", "gone"]), (1, "a", 1, "find", '{"q":"1"}', []), (1, "d", 0, "find", "{}", ["a"])]
    out = link(spark, calls, [(1, "a", 2, "A"), (1, "zz", 5, "?")], [(1, 0, "user", "hi"), (1, 1, "assistant", None)])
    assert [(r["kind"], r["call_id"]) for r in out if r["kind"] != "message"] == [("call", "a"), ("result", "a"), ("call", "d"), ("call", "b"), ("call", "c"), ("result", "zz")]
    assert [r["position"] for r in out] == list(range(8))
    by = {(r["kind"], r["call_id"]): r for r in out}
    assert by["call", "a"]["status"] == "linked" and by["call", "b"]["status"] == "pending" and by["result", "zz"]["status"] == "orphan"
    assert by["call", "b"]["unknown_needs"] == 1 and by["call", "d"]["errors"] == ["missing:q"]


def test_cycles_come_last(spark):
    calls = [(1, "a", 1, "find", None, ["b"]), (1, "b", 2, "find", None, ["a"]), (1, "c", 3, "find", None, ["b"]), (1, "d", 9, "find", '{"q":""}', ["d2"]), (1, "d2", 4, "find", '{"q":""}', None), (2, "s", 1, "find", None, ["s"])]
    out = [(r["conv_id"], r["call_id"], r["status"]) for r in link(spark, calls, [(1, "a", 2, "x")]) if r["kind"] == "call"]
    assert out == [(1, "d2", "pending"), (1, "d", "pending"), (1, "a", "cyclic"), (1, "b", "cyclic"), (1, "c", "cyclic"), (2, "s", "cyclic")]


def test_validation_and_canonical_json(spark):
    given = [
        '{ "x":1.5, "q":"a\\"b\\u00e9", "n" : 3,"deep":{"z":1,"a":[1, 2]},"list":[],"flag":false,"none":null}', '{"q":1,"n":"3","x":"1","deep":[],"list":{},"flag":0,"none":0}',
        '{"q":"x","y":1}', "[1]", "{broken", None, "{}", '{"q":null}', '{"q":"x","n":1.5,"x":2}',
    ]
    out = {r["call_id"]: r for r in link(spark, [(1, f"c{i}", i, "find", x, []) for i, x in enumerate(given)] + [(1, "t", 99, "other", "{}", [])])}
    assert [out[f"c{i}"]["errors"] for i in range(9)] == [
        [], ["type:deep", "type:flag", "type:list", "type:n", "type:none", "type:q", "type:x"], ["unknown:y"], ["json"], ["json"], ["json"], ["missing:q"], ["type:q"], ["type:n"],
    ]
    assert out["t"]["errors"] == ["tool"]
    assert out["c0"]["json"] == '{"arguments":{"deep":{"a":[1,2],"z":1},"flag":false,"list":[],"n":3,"none":null,"q":"a\\"bé","x":1.5},"id":"c0","name":"find","type":"call"}'
    for r in out.values():
        whole = json.loads(r["json"])
        assert list(whole) == sorted(whole)
    assert json.loads(out["c4"]["json"])["arguments"] == "{broken" and json.loads(out["c5"]["json"])["arguments"] is None


def test_nulls_repeats_and_nothing(spark):
    calls = [(1, "a", 1, "find", '{"q":"1"}', None), (1, "a", 0, "find", '{"q":"0"}', None), (1, "a", 0, "find", '{"q":"0"}', None), (None, None, None, None, None, None), (2, "a", 5, "find", "{}", ["a"])]
    results = [(1, "a", 3, "late"), (1, "a", 2, "early"), (1, None, 2, None), (None, "q", None, None)]
    out = link(spark, calls, results, [(None, None, None, None), (1, 0, "user", "x\n\"\u0001")])
    assert len(out) == 8
    call = next(r for r in out if r["conv_id"] == 1 and r["kind"] == "call")
    assert call["repeats"] == 2 and json.loads(call["json"])["arguments"] == {"q": "0"} and call["status"] == "linked"
    result = next(r for r in out if r["kind"] == "result" and r["call_id"] == "a")
    assert json.loads(result["json"])["content"] == "early" and result["repeats"] == 1
    assert sorted(r["status"] for r in out if r["call_id"] is None and r["kind"] != "message") == ["orphan", "pending"]
    assert link(spark) == []


def test_no_python_in_the_plan(spark):
    from codeassay.llm.queries import QUERIES

    plan = QUERIES["op7_tool_calls"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_schema_rows_and_numbers(spark, monkeypatch):
    monkeypatch.setitem(link.__globals__, "SPEC", SPEC * 3)
    given = ['{"q":1,"x":"1"}', '{"q":"a","x":1e2}', '{"q":"a","x":1.50,"x":2}']
    out = {r["call_id"]: r for r in link(spark, [(1, f"c{i}", i, "find", x, []) for i, x in enumerate(given)])}
    assert out["c0"]["errors"] == ["type:q", "type:x"] and out["c2"]["errors"] == ["json"]
    assert json.loads(out["c1"]["json"])["arguments"] == {"q": "a", "x": 100.0} and json.loads(out["c2"]["json"])["arguments"] == given[2]
