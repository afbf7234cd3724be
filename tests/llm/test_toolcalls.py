import json

import pytest

from barloom.llm.toolcalls import TOOL, conversation_calls, link_calls, message_traffic

ADD = [("add", "x", "number", True), ("add", "y", "integer", True), ("add", "note", "string", False)]


def _linked(spark, messages):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    calls, results = message_traffic(df)
    return {(r.conv_id, r.call_id, r.turn): r for r in link_calls(calls, results, spark.createDataFrame(ADD, TOOL)).collect()}


def call(*items):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in items]})


def test_links_levels_and_errors(spark):
    got = _linked(
        spark,
        [
            (1, 0, "user", "hi"), (1, 1, "assistant", call(("a", "add", {"y": 2, "x": 1.5}), ("b", "add", {"x": "$a", "y": "no"}), ("c", "zzz", {}))),
            (1, 2, "tool", '{"tool_call_id":"a","content":"3"}'), (1, 3, "tool", '{"tool_call_id":"q","content":"?"}'), (1, 9, "tool", '{"tool_call_id":"a","content":"again"}'),
            (1, 4, "assistant", call(("d", "add", {"x": "$e", "y": 1}), ("e", "add", {"x": "$d", "y": 1}), ("a", "add", [1]), ("f", "add", {"x": "$b", "y": "$a"}), ("g", "add", {"x": "$nope", "y": 1, "z": 0}))),
            (2, 1, "assistant", call(("b", "add", {"x": "$a", "y": 1}))),
        ],
    )
    a = got[1, "a", 1]
    assert (a.level, a.n_results, a.result_turn, a.valid) == (0, 2, 2, True)
    assert a.json == '{"arguments":{"x":1.5,"y":2},"errors":[],"id":"a","level":0,"name":"add","result":"3","turn":1}'
    assert (got[1, "b", 1].level, got[1, "b", 1].errors) == (1, "type of y") and got[1, "c", 1].errors == "unknown tool"
    assert got[1, "d", 4].level is None and got[1, "d", 4].errors == "cycle" == got[1, "e", 4].errors
    assert got[1, "a", 4].errors == "not an object; repeated identifier" and got[1, "a", 4].n_results == 0
    assert (got[1, "f", 4].level, got[1, "f", 4].errors) == (2, "")
    assert got[1, "g", 4].errors == "unexpected z; unknown reference" and got[2, "b", 1].errors == "unknown reference"
    assert got[1, "q", None].errors == "no call"


@pytest.mark.parametrize("value", [{"b": [1, {"z": None, "a": True}], "a": "é\n\"/"}, {}, {"n": 12345678901234567890}])
def test_canonical_json(spark, value):
    one, two = json.dumps(value), json.dumps(dict(reversed(value.items())), indent=2)
    rows = [(k, 0, "assistant", '{"tool_calls":[{"id":"a","name":"add","arguments":%s}]}' % t) for k, t in enumerate((one, two))]
    texts = {r.json for r in link_calls(*message_traffic(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), spark.createDataFrame(ADD, TOOL)).collect()}
    assert len(texts) == 1 and json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) in texts.pop()


def test_plain_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "$5"), (1, 2, "assistant", "a"), (1, 3, "user", None), (1, 5, "assistant", "late"), (None, 0, "user", "x"), (2, None, "user", "y"), (3, 0, "user", ""), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = conversation_calls(df).collect()
    got = {(r.conv_id, r.call_id): r for r in out}
    assert len(out) == 7 and got[1, "turn-1"].valid and got[1, "turn-1"].result_turn == 2 and json.loads(got[1, "turn-1"].json)["arguments"] == {"prompt": "$5"}
    assert got[1, "turn-3"].errors == "type of prompt" and got[1, "turn-4"].errors == "no call" and got[None, "turn-0"].errors == "no identifier"
    assert conversation_calls(df.limit(0)).collect() == []


def test_of_equal_calls_one_takes_the_result(spark, monkeypatch):
    from barloom.llm import toolcalls

    monkeypatch.setattr(toolcalls, "COPIES", 2)
    calls = [("c", "x", 0, 0, "reply", '{"prompt":"a"}')] * 5 + [("c", "x", 0, 0, "reply", '{"prompt":"b"}'), ("c", "y", 1, 0, "reply", '{"prompt":"b"}'), (None, "x", 0, 0, "reply", '{"prompt":"b"}')]
    calls = spark.createDataFrame(calls, "conv_id string, call_id string, turn long, place int, name string, arguments string")
    results = spark.createDataFrame([("c", "x", 1, "done"), ("c", "y", 2, "too")], "conv_id string, call_id string, turn long, content string")
    rows = toolcalls.link_calls(calls, results, spark.createDataFrame(toolcalls.REPLY, toolcalls.TOOL)).collect()
    assert sorted((r.call_id, r.n_results, r.errors) for r in rows if r.conv_id) == [("x", 0, "repeated identifier")] * 5 + [("x", 1, ""), ("y", 1, "")]
    assert [(r.n_results, r.errors) for r in rows if r.conv_id is None] == [(0, "no identifier")]
