"""op1: dependencies of any depth, and identifiers that recur in other conversations."""

import json

from tessera.llm import chat_format


def calls(conv, turn, *each):
    listed = [{"id": i, "name": "reply", "arguments": json.dumps({"text": "t", "n_chars": 1}), "depends_on": list(needs)} for i, needs in each]
    return (conv, turn, "assistant", json.dumps({"tool_calls": listed}))


def test_dependencies(spark):
    chain = [calls(1, 500 - k, (f"c{k}", [f"c{k - 1}"] if k else [])) for k in range(200)]  # called in the reverse of their order
    ladder = [calls(2, k, (f"c{k}", [f"c{j}" for j in (k - 1, k - 2) if j >= 0])) for k in range(6)]
    twice = [calls(3, 0, ("a", []), ("b", ["a"]), ("x", ["a"])), calls(3, 1, ("x", ["b", "zz"]))]
    cycle = [calls(4, 0, ("a", ["b"]), ("b", ["a"]), ("c", ["b"]), ("d", []), ("e", ["d", "c"]), ("f", ["f"]), ("g", ["d"]))]
    answers = [(1, 900, "tool", '{"tool_call_id": "c199", "content": "r"}'), (5, 0, "tool", '{"tool_call_id": "c0", "content": "r"}')]
    df = spark.createDataFrame(chain + ladder + twice + cycle + answers, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.call_id, r.kind, r.turn): r for r in chat_format.formatted(df).collect()}
    level = {k[:2]: (r.place, r.level) for k, r in out.items() if k[2] == "call"}
    assert all(level[1, f"c{k}"] == (500, k) for k in range(200))
    assert all(level[2, f"c{k}"] == (k, k) for k in range(6))
    assert {(r.turn, r.place, r.level, r.errors) for (c, i, _, _), r in out.items() if (c, i) == (3, "x")} == {(0, 0, 2, "unlinked,ambiguous"), (1, 1, 2, "unlinked,ambiguous")}
    assert {k[1] for k, r in out.items() if "cycle" in r.errors} == {"a", "b", "c", "e", "f"} and level[4, "a"] == (0, None) and level[4, "g"] == (0, 1)
    assert out[1, "c199", "result", 900].linked and out[1, "c199", "result", 900].level == 200 and out[1, "c199", "call", 301].valid
    assert not out[5, "c0", "result", 0].linked and out[1, "c0", "call", 500].errors == "unlinked"


def test_words_beside_calls_blanks_and_repeated_keys(spark):
    call = {"id": "a", "name": "reply", "arguments": '{"n_chars": 1, "text": "t"}'}
    two = json.dumps({"content": "Let me look.", "tool_calls": [call, {**call, "id": "b", "arguments": '{"text": "t", "text": "u", "n_chars": 1}'}]})
    rows = [(1, 0, "assistant", "\n\t " + two), (1, 1, "tool", ' \r\n{"tool_call_id": "a", "content": "r"}'), (1, 2, "tool", '{"tool_call_id": "b", "content": null}'),
            (2, 0, "assistant", json.dumps({"tool_calls": [{**call, "arguments": '{"n_chars": 1, "text": {"x": 1, "x": 2}}'}]})), (2, 1, "assistant", '{"content": "c", "tool_calls": []}')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r.conv_id, r.turn, r.call_id, r.kind): r for r in chat_format.formatted(df).collect()}
    a, b = json.loads(out[1, 0, "a", "call"].json), json.loads(out[1, 0, "b", "call"].json)
    assert (a["content"], b["content"]) == ("Let me look.", None) and a["valid"] and a["linked"] and out[1, 1, "a", "result"].linked
    assert b["errors"] == "repeated key" and b["arguments"] == '{"text": "t", "text": "u", "n_chars": 1}' and out[1, 2, "b", "result"].linked
    assert out[2, 0, "a", "call"].errors == "malformed,unlinked"
    assert json.loads(out[2, 1, "2:0", "result"].json)["content"] == '{"content": "c", "tool_calls": []}'
