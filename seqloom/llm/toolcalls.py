"""Tool-call linking with DataFrame functions only.

Calls and results are read from chat messages, joined by call identifier, ordered by their dependencies (a call's level is the length of the
longest chain of calls that it waits for), checked against the tools' argument schemas and written as canonical JSON (sorted keys, no
spaces).  No key is collected anywhere: a conversation of any length is rows in equi-joins and partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._store import clean_name, discard, materialise

#: What chat turns are as calls: a user's turn asks, the assistant's next turn answers.
ANSWER = "answer"
#: Rounds after which what is known so far is written as one table.
PLAN_ROUNDS = 8
#: Tool -> argument -> {"type", "required", "minimum", "enum", "min_length"}; arguments that are not listed are errors.
SCHEMAS = {ANSWER: {"prompt": {"type": "string", "required": True, "min_length": 1}, "turn": {"type": "integer", "required": True, "minimum": 0}}}
_TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def _turn_id(turn: Column) -> Column:
    return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))


def messages_to_calls(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls ``(conv_id, turn, call_id, name, arguments, depends_on)`` and results ``(conv_id, turn, call_id, content)`` of ``(conv_id, turn, role, text)``.

    A user's turn is a call of the tool ``answer`` that waits for the user's turn two before; an assistant's turn is the result of the
    turn before it.  An assistant's turn that is an object with ``tool_calls`` (``id``, ``name``, ``arguments``, ``depends_on``) makes those calls
    instead, and a ``tool`` turn with ``tool_call_id`` and ``content`` is the result of that call.  Rows without conversation or turn are left out.
    """
    rows = clean_name(chats, "conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    asked = rows.where("role = 'user'").select(
        "conv_id",
        "turn",
        _turn_id(F.col("turn")).alias("call_id"),
        F.lit(ANSWER).alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"),
        F.array(_turn_id(F.col("turn") - 2)).alias("depends_on"),
    )
    shape = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
    made = (
        rows.where("role = 'assistant' and text like '{%tool_calls%'")
        .select("conv_id", "turn", F.explode(F.from_json("text", shape)["tool_calls"]).alias("c"))
        .select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"))
    )
    answered = rows.where("role = 'assistant' and not coalesce(text like '{%tool_calls%', false)").select("conv_id", "turn", _turn_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    returned = (
        rows.where("role = 'tool'")
        .select("conv_id", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("r"))
        .select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), "r.content")
    )
    return asked.unionByName(made), answered.unionByName(returned)


def _anchors(single: DataFrame) -> DataFrame:
    """``(conv_id, call_id, anchor, dist)`` for calls with one dependency: the first call up the chain that has none or several, and how far it is; null anchors on and behind a cycle.

    Pointer doubling: each round joins every open pointer with its target's, so a chain of any length takes a logarithmic number of rounds.
    """
    known = single.select("conv_id", F.col("call_id").alias("anchor"), F.lit(True).alias("goes_on"))
    state = materialise(
        single.select("conv_id", "call_id", F.col("dep").alias("anchor"), F.lit(1).cast("long").alias("dist"))
        .join(known, ["conv_id", "anchor"], "left")
        .select("conv_id", "call_id", "anchor", "dist", F.coalesce("goes_on", F.lit(False)).alias("open"))
    )
    reach = 1
    while True:
        counts = state.agg(F.count("*").alias("n"), F.count_if("open").alias("open")).first()
        if not counts["open"] or reach > counts["n"]:
            break
        target = state.select("conv_id", F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("dist").alias("more"), F.col("open").alias("next_open"))
        moved = state.where("open").join(target, ["conv_id", "anchor"]).select("conv_id", "call_id", F.col("next").alias("anchor"), (F.col("dist") + F.col("more")).alias("dist"), F.col("next_open").alias("open"))
        following = materialise(state.where("not open").unionByName(moved))
        discard(state)
        state, reach = following, reach * 2
    return state.select("conv_id", "call_id", F.when(~F.col("open"), F.col("anchor")).alias("anchor"), "dist")


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)`` for each distinct call: 0 without known dependencies, else one more than the highest of them; null on or behind a cycle.

    Chains of calls with one dependency each are followed by pointer doubling.  What is left are calls with several dependencies, each some steps behind
    a call without any or another of their kind; those get their levels in Kahn's rounds, as many as such calls lie behind one another.
    """
    nodes = materialise(calls.where("call_id is not null").select("conv_id", "call_id").distinct())
    edges = materialise(
        calls.where("call_id is not null")
        .select("conv_id", "call_id", F.explode("depends_on").alias("dep"))
        .where("dep is not null")
        .distinct()
        .join(nodes.withColumnRenamed("call_id", "dep"), ["conv_id", "dep"], "left_semi")
        .select("conv_id", "call_id", "dep")
    )
    degree = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"))
    several = materialise(degree.where("n > 1").drop("n"))
    single = edges.join(several, ["conv_id", "call_id"], "left_anti")
    chains = materialise(_anchors(single))
    roots = nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("long"))
    done, used = roots, []
    if not several.isEmpty():
        via = chains.select("conv_id", F.col("call_id").alias("dep"), "anchor", "dist", F.lit(True).alias("chained"))
        waiting = materialise(
            edges.join(several, ["conv_id", "call_id"], "left_semi")
            .join(via, ["conv_id", "dep"], "left")
            .select("conv_id", "call_id", F.when(F.col("chained"), F.col("anchor")).otherwise(F.col("dep")).alias("dep"), (F.coalesce("dist", F.lit(0)) + 1).alias("step"), F.lit(None).cast("long").alias("top"))
        )
        ready = materialise(roots)
        done, rounds, parts = ready, 0, [ready]
        while True:
            known = ready.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("base"))
            told = materialise(
                waiting.join(known, ["conv_id", "dep"], "left").select("conv_id", "call_id", "dep", "step", F.coalesce("top", F.col("base") + F.col("step")).alias("top"))
            )
            state = told.groupBy("conv_id", "call_id").agg(F.max("top").alias("level"), F.count_if(F.col("top").isNull()).alias("open"))
            ready = materialise(state.where("open = 0").select("conv_id", "call_id", "level"))
            if ready.isEmpty():
                used = [waiting, told, ready, *parts]
                break
            following = materialise(told.join(ready, ["conv_id", "call_id"], "left_anti"))
            discard(waiting, told)
            waiting, rounds = following, rounds + 1
            done = done.unionByName(ready)
            parts.append(ready)
            if rounds % PLAN_ROUNDS == 0:
                # written as one table, so that the plan doesn't grow with the rounds
                done = materialise(done)
                discard(*(p for p in parts if p is not ready))
                parts = [done, ready]
    anchored = chains.join(done.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("base")), ["conv_id", "anchor"], "left")
    levelled = done.unionByName(anchored.select("conv_id", "call_id", (F.col("base") + F.col("dist")).alias("level")))
    out = materialise(nodes.join(levelled, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("level").cast("int").alias("level")))
    discard(nodes, edges, several, chains, *used)
    return out


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Array of what is wrong with a call's arguments, in the order of the schema; empty if nothing is."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = []
        for field, rule in fields.items():
            path = f"$['{field}']"
            own = F.try_variant_get(value, path, "variant")
            own_kind = F.schema_of_variant(own)
            if rule.get("required"):
                found.append(F.when(own.isNull(), F.lit(f"{field}: missing")))
            want = rule["type"]
            fits = own_kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") if want == "number" else own_kind.startswith(_TYPES[want])
            found.append(F.when(own.isNotNull() & ~fits, F.lit(f"{field}: not {want}")))
            if "minimum" in rule:
                found.append(F.when(F.try_variant_get(value, path, "double") < rule["minimum"], F.lit(f"{field}: under {rule['minimum']}")))
            if "min_length" in rule:
                found.append(F.when(fits & (F.length(F.try_variant_get(value, path, "string")) < rule["min_length"]), F.lit(f"{field}: too short")))
            if "enum" in rule:
                found.append(F.when(own.isNotNull() & ~F.try_variant_get(value, path, "string").isin(rule["enum"]), F.lit(f"{field}: not in enum")))
        extra = F.transform(
            F.array_sort(F.array_except(F.coalesce(F.json_object_keys(arguments), none), F.array(*[F.lit(f) for f in fields]) if fields else none)),
            lambda k: F.concat(k, F.lit(": unknown")),
        )
        errors = F.concat(F.array_compact(F.array(*found)) if found else none, extra)
        out = F.when(name == tool, errors).otherwise(out)
    return F.when(kind.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("arguments: not an object"))).otherwise(out)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and without spaces; null if the text is no JSON."""
    return F.to_json(F.try_parse_json(text))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]] | None = None) -> DataFrame:
    """``(conv_id, turn, call_id, name, level, status, errors, n_results, message)``: one row per row of ``calls``, and one for each answered identifier that no call has.

    ``status`` is the first that holds: ``orphan`` (a result without call), ``cycle``, ``invalid`` (see ``errors``), ``unanswered``, ``ok``.  Of several results for one
    call the first by turn, then text, counts, and ``n_results`` tells how many there were.  ``message`` is canonical JSON of id, name, arguments
    and result.  Ordering by ``level``, then ``turn`` and ``call_id``, puts each call after all that it waits for.  Null identifiers match nothing: such calls
    are ``unanswered`` or ``invalid`` at level 0, such results orphans.  Very long texts, arguments and results are kept whole.  Repeated rows stay; empty tables give empty results; other columns are ignored.
    """
    schemas = SCHEMAS if schemas is None else schemas
    calls = clean_name(calls, "conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    first = (
        clean_name(results, "conv_id", "turn", "call_id", "content")
        .groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n"))
        .select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n")
    )
    order = levels(calls)
    known = order.select("conv_id", "call_id", "level", F.lit(True).alias("ordered"))
    linked = calls.join(known, ["conv_id", "call_id"], "left").join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    errors = argument_errors(F.col("name"), F.col("arguments"), schemas)

    def message(ident: Column, name: Column, arguments: Column, result: Column) -> Column:
        # keys are listed in sorted order; parsed again so that one writer does all the escaping
        return F.to_json(F.parse_json(F.concat(
            F.lit('{"arguments":'), F.coalesce(canonical_json(arguments), F.lit("null")),
            F.lit(',"id":'), F.coalesce(_quoted(ident), F.lit("null")),
            F.lit(',"name":'), F.coalesce(_quoted(name), F.lit("null")),
            F.lit(',"result":'), F.coalesce(_quoted(result), F.lit("null")), F.lit("}"),
        )))

    rows = linked.withColumn("errors", errors).select(
        "conv_id",
        "turn",
        "call_id",
        "name",
        F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"),
        F.when(F.col("call_id").isNotNull() & F.col("level").isNull(), "cycle")
        .when(F.size("errors") > 0, "invalid")
        .when(F.col("n").isNull(), "unanswered")
        .otherwise("ok")
        .alias("status"),
        F.array_join("errors", "; ").alias("errors"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_results"),
        message(F.col("call_id"), F.col("name"), F.col("arguments"), F.col("content")).alias("message"),
    )
    orphans = first.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").select(
        "conv_id",
        F.col("result_turn").alias("turn"),
        "call_id",
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("int").alias("level"),
        F.lit("orphan").alias("status"),
        F.lit("").alias("errors"),
        F.col("n").alias("n_results"),
        message(F.col("call_id"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("content")).alias("message"),
    )
    return rows.unionByName(orphans)


def _quoted(text: Column) -> Column:
    """A JSON string; null stays null."""
    whole = F.to_json(F.struct(text.alias("s")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def conversation_calls(chats: DataFrame) -> DataFrame:
    """The linked calls of a table of chat messages, see ``messages_to_calls`` and ``link_tool_calls``, which say what nulls, ties, repeated rows, very long texts, empty tables and other columns give."""
    return link_tool_calls(*messages_to_calls(chats))


#: DuckDB SQL for ``conversation_calls`` over chats without embedded tool calls.
ORACLE = """
WITH RECURSIVE r AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
k AS (SELECT DISTINCT conv_id, turn FROM r WHERE role = 'user'),
lv AS (
  SELECT conv_id, turn, 0 AS level FROM k WHERE NOT EXISTS (SELECT 1 FROM k p WHERE p.conv_id = k.conv_id AND p.turn = k.turn - 2)
  UNION ALL
  SELECT k.conv_id, k.turn, lv.level + 1 FROM lv JOIN k ON k.conv_id = lv.conv_id AND k.turn = lv.turn + 2
),
a AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n FROM r WHERE role = 'assistant' GROUP BY ALL
),
c AS (
  SELECT u.conv_id, u.turn, 'c' || u.conv_id || '-' || u.turn AS call_id, lv.level, a.n, a.content, u.text,
         concat_ws('; ', CASE WHEN u.text IS NULL THEN 'prompt: missing' END, CASE WHEN u.text = '' THEN 'prompt: too short' END, CASE WHEN u.turn < 0 THEN 'turn: under 0' END) AS errors
  FROM r u JOIN lv USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn) WHERE u.role = 'user'
)
SELECT conv_id, turn, call_id, 'answer' AS name, level::INT AS level,
       CASE WHEN errors <> '' THEN 'invalid' WHEN n IS NULL THEN 'unanswered' ELSE 'ok' END AS status, errors, coalesce(n, 0)::BIGINT AS n_results,
       '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || to_json(text)::VARCHAR || ',' END || '"turn":' || turn || '},"id":"' || call_id ||
       '","name":"answer","result":' || CASE WHEN content IS NULL THEN 'null' ELSE to_json(content)::VARCHAR END || '}' AS message
FROM c
UNION ALL
SELECT a.conv_id, a.turn + 1, 'c' || a.conv_id || '-' || a.turn, NULL, NULL, 'orphan', '', n,
       '{"arguments":null,"id":"c' || a.conv_id || '-' || a.turn || '","name":null,"result":' || CASE WHEN content IS NULL THEN 'null' ELSE to_json(content)::VARCHAR END || '}'
FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv_id = a.conv_id AND k.turn = a.turn)
"""
