"""The library's own results keep their schemas; each kind of rule is found where it is broken."""

import json


from logloom.operators import normalize, pricing, schemas, search, stats
from logloom.plans import bindings as b
from logloom.plans import log_lines as g
from logloom.sources import logs, sinks

SF = "/root/testdata/sf0.001"


def test_results_keep_their_schemas(spark):
    n = normalize.normalise(g.tool_a_lines(spark, SF), "claude-code")
    nested, ev = normalize.nested(n), b.sessions_from_events(spark, SF)
    texts = search.turn_texts(n.blocks.join(n.turns.select("session_key", "turn_index", "role"), ["session_key", "turn_index"]))
    results = {
        "session": nested, "public_session": sinks.sanitised(nested), "list": stats.summaries(ev), "search": search.search(n.sessions, texts, "the"), "stats": stats.full_report(pricing.with_estimate(ev, pricing.prices(spark)), True),
        "inventory": logs.inventory(n.sessions.select("tool", "source_path")),
    }
    assert sorted(results) == schemas.names()
    for name, table in results.items():
        assert table.count() and schemas.broken_rules(table, name).count() == 0, name
    assert {r.rule for r in schemas.broken_rules(sinks.sanitised(nested, reasoning=True, raw_paths=True), "public_session").collect()} == {"source_path_present", "session_key_present", "turns[].content[].kind_unknown"}


def test_every_kind_of_rule(spark):
    schema = {
        "type": "object", "required": ["a", "gone"], "absent": ["x"], "properties": {
            "a": {"type": "string", "minLength": 2}, "n": {"type": "integer", "minimum": 0, "maximum": 9}, "m": {"type": "object", "values": {"type": "object", "required": ["v"], "properties": {"v": {"type": "number", "minimum": 1}}}},
            "t": {"type": "string"}, "l": {"type": "array", "items": {"type": "string", "enum": ["p", "q"]}},
        }, "cases": [{"if": {"a": ["with"]}, "then": {"required": ["t2"], "properties": {"n": {"minimum": 5}}}}],
    }
    rows = [
        (1, "ok", 3, {"k": (2.0,)}, 5, ["p", None], None, None), (2, None, 10, {"k": (0.5,), "j": (None,)}, None, ["r"], "here", None), (3, "with", 4, None, None, None, None, None), (4, "a", -1, {}, None, [], None, "y"),
    ]
    table = spark.createDataFrame(rows, "k int, a string, n int, m map<string,struct<v:double>>, t int, l array<string>, x string, t2 string")
    got = {}
    for r in schemas.broken_rules(table, schema, "k").collect():
        got.setdefault(r.k, []).append(r.rule)
    assert {k: sorted(v) for k, v in got.items()} == {
        1: ["gone_missing", "t_type"], 2: ["a_missing", "gone_missing", "l[]_unknown", "m[].v_missing", "m[].v_too_small", "n_too_large", "x_present"], 3: ["gone_missing", "n_too_small", "t2_missing"], 4: ["a_empty", "gone_missing", "n_too_small"],
    }
    plan = schemas.broken_rules(table, schema, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert schemas.broken_rules(table.where("false"), schema).count() == 0


def test_files_are_plain_schemas():
    for name in schemas.names():
        s = schemas.schema_of(name)
        assert s["title"] == name and s["type"] == "object" and json.dumps(s)
