import json
import random

from quarryline.llm.chat_format import format_chats
from quarryline.llm.queries import TOOL_SCHEMAS


def call(i, name, arguments):
    return {"id": i, "name": name, "arguments": arguments}


def message(**fields):
    return json.dumps(fields)


ROWS = [
    (1, 0, "user", "find it"),
    (1, 1, "assistant", message(content="ok", tool_calls=[call("a", "search", {"query": "x", "limit": 3}), call("b", "fetch", {"url": {"$ref": "a"}})])),
    (1, 2, "tool", message(tool_call_id="b", content="page")),
    (1, 3, "tool", message(tool_call_id="a", content="hits")),
    (1, 4, "tool", message(tool_call_id="a", content="hits again")),
    (1, 5, "tool", message(tool_call_id="zz", content="?")),
    (2, 0, "assistant", message(tool_calls=[call("a", "search", {"limit": "many"}), call("u", "launch", {})])),
    (2, 1, "assistant", message(tool_calls=[call("a", "search", {"query": "again"})])),
    (3, 0, "assistant", message(tool_calls=[call("p", "calculate", {"expression": {"$ref": "q"}}), call("q", "calculate", {"expression": {"$ref": "p"}})])),
    (4, 0, "tool", message(tool_call_id="late", content="before its call")),
    (4, 1, "assistant", message(tool_calls=[call("late", "calculate", {"expression": "1+1"})])),
    (5, 0, None, None),
    (5, 1, "user", "{not json"),
    (5, 2, "user", '{"other": 1}'),
    (None, 0, "user", 'quotes " and é\n'),
    (6, 0, "user", ""),
    (6, 0, "user", ""),
]


def test_linking_order_validation_and_lines(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, json string").repartition(3)
    out = format_chats(df, TOOL_SCHEMAS).collect()
    assert len(out) == len(ROWS)
    got = {(r.conv_id, r.turn): r for r in out}
    first = got[1, 1]
    assert (first.n_calls, first.n_linked, first.level, first.issues) == (2, 2, 1, "bad_arguments")  # url is a reference, not a string
    assert first.json == '{"content":"ok","conv_id":1,"role":"assistant","tool_calls":[{"arguments":"{\\"limit\\":3,\\"query\\":\\"x\\"}","id":"a","name":"search"},{"arguments":"{\\"url\\":{\\"$ref\\":\\"a\\"}}","id":"b","name":"fetch"}],"turn":1}'
    assert (got[1, 2].n_linked, got[1, 2].level, got[1, 3].level) == (1, 2, 1)
    assert got[1, 4].issues == "repeated_result"
    assert got[1, 5].issues == "unknown_call"
    assert got[2, 0].issues == "bad_arguments,unanswered_call,unknown_tool"
    assert got[2, 1].issues == "repeated_call"
    assert "cyclic_call" in got[3, 0].issues
    assert (got[4, 0].order_turn, got[4, 0].n_linked) == (1, 1)
    assert got[5, 0].json == '{"conv_id":5,"turn":0}'
    assert json.loads(got[5, 1].json)["content"] == "{not json"
    assert json.loads(got[5, 2].json)["content"] == '{"other": 1}'
    assert json.loads(got[None, 0].json)["content"] == 'quotes " and é\n'
    for r in out:
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def chained(n, after):
    return [call(f"c{i}", "calculate", {"expression": [{"$ref": f"c{k}"} for k in after(i)]} if after(i) else {"expression": "1"}) for i in range(n)]


def levels(spark, calls):
    df = spark.createDataFrame([(1, i, "assistant", message(tool_calls=[c])) for i, c in enumerate(calls)], "conv_id long, turn long, role string, text string")
    return {r.turn: (r.level, "cyclic_call" in r.issues) for r in format_chats(df, TOOL_SCHEMAS).collect()}


def test_levels_are_longest_paths(spark):
    draw = random.Random(0)
    edges = {i: sorted(draw.sample(range(i), min(i, draw.randint(0, 3)))) for i in range(30)}
    want = {}
    for i in range(30):
        want[i] = (max((want[k][0] + 1 for k in edges[i]), default=0), False)
    assert levels(spark, chained(30, edges.get)) == want


def test_chains_have_no_bound_and_cycles_hold_what_waits_for_them(spark):
    n = 40  # more rounds than are kept apart
    got = levels(spark, chained(n, lambda i: [i - 1] if 0 < i < n - 3 else [n - 2] if i == n - 3 else [n - 3] if i == n - 2 else [n - 2] if i == n - 1 else []))
    assert got == {**{i: (i, False) for i in range(n - 3)}, n - 3: (0, True), n - 2: (0, True), n - 1: (0, True)}


def test_only_whole_objects_of_the_form_are_structured(spark):
    """Nothing of any other text is lost: it is content, letter for letter."""
    plain = [
        '{"content":"a"} trailing', '{"content":"a"}{"content":"b"}', '{"content":"a","title":"kept?"}', '{"content":1}', '{"content":["a"]}', '{"content":"a","content":"b"}',
        '{"tool_call_id":5}', '{"tool_calls":{"id":"a"}}', '{"tool_calls":[{"id":"a","name":"search","arguments":{},"extra":1}]}', '{"tool_calls":[{"id":1}]}', '{"tool_calls":["a"]}', '{"tool_calls":[null]}',
        '{"content":"a"}] x', '{"content":"a"},1]', '{"content":"a"},', "{}", '{"content":null}', '{"content":"a"',
    ]
    structured = {'{"content":"a"}': "a", ' {"content" : "\\u00e9\\n" }\n': "é\n", '{"content":"b","tool_calls":null}': "b", '{"content":"c","tool_calls":[]}': "c", '{"content":""}': ""}
    texts = [*plain, *structured]
    df = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: json.loads(r.json) for r in format_chats(df, TOOL_SCHEMAS).collect()}
    for i, t in enumerate(texts):
        assert got[i] == {"content": structured.get(t, t), "conv_id": i, "role": "user", "turn": 0}, t


def test_arguments_that_are_no_json_stay(spark):
    calls = [call("a", "search", "not json"), call("b", "search", '{"query":"x"} tail'), call("c", "search", '{ "query" : "x"}'), call("d", "search", None), call("e", "search", [1])]
    df = spark.createDataFrame([(1, 0, "assistant", message(tool_calls=calls))], "conv_id long, turn long, role string, text string")
    row = format_chats(df, TOOL_SCHEMAS).first()
    assert [c["arguments"] for c in json.loads(row.json)["tool_calls"]] == ["not json", '{"query":"x"} tail', '{"query":"x"}', "{}", "[1]"]
    assert row.issues == "bad_arguments,unanswered_call"


def test_results_of_one_turn(spark):
    """Two different results in the turn that answers are both linked."""
    rows = [(1, 0, "assistant", message(tool_calls=[call("a", "calculate", {"expression": "1"})])), *((1, t, "tool", message(tool_call_id="a", content=c)) for t, c in [(1, "x"), (1, "y"), (2, "z")])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.turn, json.loads(r.json).get("content")): (r.n_linked, r.issues) for r in format_chats(df, TOOL_SCHEMAS).collect()}
    assert got == {(0, None): (1, ""), (1, "x"): (1, ""), (1, "y"): (1, ""), (2, "z"): (0, "repeated_result")}


def test_white_space_and_very_long_texts(spark):
    long = "x" * 2_000_000
    rows = [(1, 0, "assistant", " \n\t" + message(content=long, tool_calls=[call("a", "calculate", {"expression": "y" * 1_000_000})]) + "\n"), (1, 1, "tool", " " + message(tool_call_id="a")), (1, 2, "user", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in format_chats(df, TOOL_SCHEMAS).collect()}
    assert (got[0].n_calls, got[0].n_linked, got[0].issues, got[1].n_linked) == (1, 1, "", 1)
    assert json.loads(got[0].json)["content"] == long == json.loads(got[2].json)["content"]
    assert len(json.loads(json.loads(got[0].json)["tool_calls"][0]["arguments"])["expression"]) == 1_000_000


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(df).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    plan = format_chats(df, TOOL_SCHEMAS)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
