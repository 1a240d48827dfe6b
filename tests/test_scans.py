"""Prefix sums over segments: line numbers of files in many splits, step names, and sessions cut into ranges of lines."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from logloom.operators import normalize
from logloom.operators.scans import running
from logloom.sources import logs


def item(**p):
    return {"type": "response_item", "timestamp": "2024-01-01T00:00:00Z", "payload": p}


def test_running_equals_windows(spark):
    r = random.Random(3)
    rows = [(r.choice("aab"), r.randrange(500), k, r.randrange(9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k string, line int, seq int, v int")
    before = lambda *o: Window.partitionBy("k").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("k", "line", "seq", "v", F.coalesce(F.sum("v").over(before("line", "seq")), F.lit(0)).alias("s"), F.count("*").over(before("line", "v", "seq")).alias("n"))
    for span in (1, 7, 10_000):
        got = running(df, ["k"], {"s": (["line", "seq"], F.col("v")), "n": (["line", "v", "seq"], F.lit(1))}, span)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_numbers_over_twenty_splits(spark, tmp_path):
    """Blank lines at the edges of splits, several files, one without a last newline; nothing is shuffled by file."""
    (tmp_path / "p").mkdir()
    for name, n, end in (("a", 5000, "\n"), ("b", 300, ""), ("c", 1, "\n")):
        body = ["" if k % 4 == 0 or 900 < k < 1100 else json.dumps({"k": k, "f": name, "pad": "x" * (k % 37)}) for k in range(1, n + 1)]
        (tmp_path / "p" / f"{name}.jsonl").write_text("\n".join(body) + end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = logs.log_files(spark, "claude-code", str(tmp_path))
        assert raw.select("source_path", "block_start").distinct().count() >= 20
        out = logs.numbered(raw).withColumn("k", F.get_json_object("value", "$.k").cast("int"))
        assert out.where("k <> line").count() == 0
        assert out.count() == sum(1 for n in (5000, 300, 1) for k in range(1, n + 1) if not (k % 4 == 0 or 900 < k < 1100))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_step_names_are_the_running_count(spark, tmp_path):
    text = lambda s: [{"type": "output_text", "text": s}]
    lines = [
        item(type="message", role="user", content=text("q")), item(type="message", role="assistant", content=text("")), item(type="message", role="assistant", content=text("a")), item(type="reasoning", summary="hm"),
        item(type="reasoning", encrypted_content="zz", content=text("open")), item(type="function_call", call_id="c1", name="sh", arguments="{}"), item(type="function_call", call_id="c1", name=7, arguments="{}"),
        item(type="function_call_output", call_id="c1", output="ok"), item(type="message", role="user", content=text("again")), item(type="web_search_call", query="x"), item(type="message", role="assistant", content=text("b")),
    ]
    path = tmp_path / "sessions/2024/01/05/rollout-1.jsonl"
    path.parent.mkdir(parents=True)
    path.write_text("\n".join(map(json.dumps, lines)))
    for span in (3, 1 << 16):
        n = normalize.normalise(logs.numbered(logs.log_files(spark, "codex", str(tmp_path))), "codex", span=span)
        assert [r.turn_id for r in n.turns.orderBy("turn_index").collect()] == [
            "user-1-0", "assistant-assistant-step-2", "assistant-reasoning-3", "assistant-reasoning-4", "assistant-call-c1", "tool-result-c1-8", "user-9-6", "assistant-call-web-10", "assistant-assistant-step-9",
        ]
        calls = {c.id: c for c in n.tool_calls.collect()}
        assert len(calls) == 2 and calls["c1"].output == "ok" and calls["c1"].name == "sh" and json.loads(calls["web-10"].input) == {"type": "web_search_call", "query": "x"}


def test_call_parts_without_ids(spark, tmp_path):
    path = tmp_path / "p/chats/session-1.jsonl"
    path.parent.mkdir(parents=True)
    lines = [
        {"role": "model", "parts": [{"functionCall": {"args": {"d": 1}}}, {"text": ""}, {"text": "x", "functionCall": {"id": "k", "name": "ls"}}]}, {"role": "user", "parts": [{"functionResponse": {"name": "ls", "response": 1}}, {"functionResponse": {"id": "k"}}]},
        {"role": "model", "parts": [{"text": "end"}]},
    ]
    path.write_text("\n".join(map(json.dumps, lines)))
    n = normalize.normalise(logs.numbered(logs.log_files(spark, "gemini", str(tmp_path))), "gemini")
    assert [(b.kind, b.tool_use_id, b.name, b.text) for b in n.blocks.where("turn_index = 0").orderBy("block_pos").collect()] == [("tool_use", "call-1", "unknown", None), ("text", None, None, "x"), ("tool_use", "k", "ls", None)]
    assert [r.turn_id for r in n.turns.orderBy("turn_index").collect()] == ["assistant-model-3", "tool-result-call-2-2", "tool-result-k-2", "assistant-model-4"]
    assert [(w.code, w.line) for w in n.warnings.collect()] == [("unmatched_tool_result", 2)]


@pytest.mark.parametrize("span", [64, 1000])
def test_a_huge_session_in_ranges(spark, span):
    """Groups, calls and answers that lie many ranges apart: the same tables as in one range."""
    r = random.Random(span)
    said = []
    for k in range(4000):
        kind = r.randrange(5)
        if kind == 0:
            said.append({"type": "user", "timestamp": f"t{k:05}", "message": {"role": "user", "content": f"u{k % 7}"}})
        elif kind == 1:
            said.append({"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": f"c{r.randrange(600)}", "content": f"o{k}"}, {"type": "text", "text": "and"}]}})
        else:
            said.append({"type": "assistant", "timestamp": f"t{k:05}", "message": {"role": "assistant", "id": f"m{r.randrange(900)}", "model": "claude-sonnet-4-5", "content": [{"type": "text", "text": f"x{k % 3}"}, {"type": "tool_use", "id": f"c{r.randrange(600)}", "name": "n", "input": {}}], "usage": {"input_tokens": k}}})
    lines = spark.createDataFrame([("/logs/-a-b/s.jsonl", k + 1, json.dumps(x)) for k, x in enumerate(said)], "source_path string, line int, value string")
    one, cut = (normalize.normalise(lines, "claude-code", span=s) for s in (1 << 16, span))
    for name in ("sessions", "turns", "blocks", "tool_calls", "warnings"):
        a, b = (sorted(map(str, getattr(n, name).collect())) for n in (one, cut))
        assert a == b and a, name
    assert sorted(x.turn_index for x in one.turns.collect()) == list(range(one.sessions.first().turn_count))
    assert cut.turns._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(session_key") > 0
