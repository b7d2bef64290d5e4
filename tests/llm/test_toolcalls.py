import json

import duckdb

from seqloom.llm.toolcalls import ORACLE, conversation_calls, levels, link_tool_calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, status string"
RESULTS = "conv_id long, turn long, call_id string, content string, n long"


def test_against_sql(spark):
    db = duckdb.connect()
    db.execute("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    want = sorted(db.execute(f"select conv_id, turn, call_id, name, level, status, errors, n_results, message from ({ORACLE})").fetchall(), key=str)
    got = conversation_calls(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_levels_and_cycles(spark):
    rows = [(1, i, n, "t", "{}", d, "") for i, (n, d) in enumerate({"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "zz", None], "x": ["y"], "y": ["x"], "w": ["x", "a"], "s": ["s"]}.items())]
    rows += [(2, 0, "c", "t", "{}", [], ""), (2, 0, "c", "t", "{}", [], "")]
    got = {(r.conv_id, r.call_id): r.level for r in levels(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (1, "x"): None, (1, "y"): None, (1, "w"): None, (1, "s"): None, (2, "c"): 0}


def test_long_chain(spark):
    rows = [(1, i, f"n{i}", "t", "{}", [f"n{i - 1}"], "") for i in range(300)] + [(2, i, f"m{i}", "t", "{}", [f"m{(i + 1) % 5}"], "") for i in range(5)]
    want = {f"n{i}": i for i in range(300)} | {f"m{i}": None for i in range(5)}
    assert {r.call_id: r.level for r in levels(spark.createDataFrame(rows, CALLS)).collect()} == want


def test_levels_of_random_graphs(spark):
    import random

    rng = random.Random(6)
    rows, want = [], {}
    for conv in range(60):
        n = rng.randrange(1, 12)
        deps = {i: [rng.randrange(n) if rng.random() < 0.1 else rng.randrange(i) for _ in range(rng.choice([0, 1, 1, 2]))] if i else [] for i in range(n)}

        def level(i, seen=(), deps=deps):
            if i in seen:
                raise RecursionError
            return max((level(d, (*seen, i)) + 1 for d in deps[i]), default=0)

        for i in range(n):
            try:
                want[conv, f"k{i}"] = level(i)
            except RecursionError:
                want[conv, f"k{i}"] = None
            rows.append((conv, i, f"k{i}", "t", "{}", [f"k{d}" for d in deps[i]], ""))
    assert {(r.conv_id, r.call_id): r.level for r in levels(spark.createDataFrame(rows, CALLS)).collect()} == want


def test_schemas_and_canonical_json(spark):
    schemas = {"add": {"x": {"type": "number", "required": True, "minimum": 1}, "mode": {"type": "string", "enum": ["up", "down"]}, "on": {"type": "boolean"}, "l": {"type": "array"}, "o": {"type": "object"}}}
    cases = {
        '{"x": 1.5, "mode": "up"}': "", '{ "mode":"up", "x":2, "on":true, "l":[1,{"b":1,"a":2}], "o":{"z":1,"é":2} }': "", '{"x":0}': "x: under 1", "{}": "x: missing", '{"x":"1"}': "x: not number",
        '{"x":1,"mode":"no"}': "mode: not in enum", '{"x":1,"zz":1,"a":2}': "a: unknown; zz: unknown", "[1]": "arguments: not an object", "nope": "arguments: not an object", '{"x":1,"on":1}': "on: not boolean",
    }
    rows = [(1, i, f"k{i}", "add", a, [], "q") for i, a in enumerate(cases)] + [(1, 50, "n", "add", None, None, "q"), (1, 51, "u", "what", "{}", [], "q"), (1, 52, None, "add", '{"x":1}', [], "q")]
    rows += [rows[0]]
    results = [(1, 5, "k0", "late", 1), (1, 4, "k0", 'é "q"\n', 1), (1, 9, "gone", None, 1), (1, 9, None, "x", 1), (2, 9, "k1", "other", 1)]
    got = link_tool_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame(results, RESULTS), schemas).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        m = json.loads(r.message)
        assert json.dumps(m, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.message
    for i, want in enumerate(cases.values()):
        assert {r.errors for r in got if r.call_id == f"k{i}" and r.conv_id == 1} == {want}
    assert [(r.status, r.n_results, json.loads(r.message)["result"]) for r in got if r.call_id == "k0"] == [("ok", 2, 'é "q"\n')] * 2
    assert {r.status for r in got if r.name is None} == {"orphan"}
    assert [r.status for r in got if r.name == "add" and r.call_id is None] == ["unanswered"]


def test_embedded_and_empty(spark):
    chats = [
        (1, 0, "user", "hi", 1),
        (1, 1, "assistant", '{"tool_calls":[{"id":"q","name":"answer","arguments":"{\\"prompt\\":\\"p\\",\\"turn\\":0}"},{"id":"r","name":"answer","arguments":"{}","depends_on":["q"]}]}', 1),
        (1, 2, "tool", '{"tool_call_id":"q","content":"42"}', 1),
        (None, 3, "user", "x", 1),
        (1, 7, "user", None, 1),
        (1, 9, "user", "", 1),
        (1, 10, "assistant", None, 1),
    ]
    df = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string, level int")
    got = {r.call_id: (r.level, r.status, r.errors) for r in conversation_calls(df).collect()}
    assert got == {"c1-0": (0, "unanswered", ""), "q": (0, "ok", ""), "r": (1, "invalid", "prompt: missing; turn: missing"), "c1-7": (0, "invalid", "prompt: missing"), "c1-9": (1, "invalid", "prompt: too short")}
    assert conversation_calls(df.limit(0)).count() == 0
