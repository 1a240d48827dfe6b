"""Exports of sessions that share an id, hold secrets everywhere, or have no turns; order of every format; the document in parts."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from logloom.functions import privacy
from logloom.operators import normalize
from logloom.sources import logs, sinks

KEY = "sk-" + "a" * 40
WHEN = "2024-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def nested(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")

    def write(path, *lines):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("".join(json.dumps(x) + "\n" for x in lines))

    said = lambda text: {"type": "user", "message": {"role": "user", "content": text}}
    call = {"type": "tool_use", "id": KEY, "name": KEY, "input": {"cmd": f"x {KEY}", "n": 1.50}}
    write("p1/s.jsonl", said("first of p1"), {"type": "assistant", "message": {"role": "assistant", "id": "m", "model": "claude-x", "content": [{"type": "text", "text": "answer p1"}, call]}}, {"type": "assistant", "message": {"role": "assistant", "id": "empty", "content": []}})
    write("p2/s.jsonl", said("first of p2"), {"type": "user", "cwd": f"/w/{KEY}", "message": {"role": "user", "content": "second <b> of p2"}})
    write("p3/none.jsonl", {"type": "summary"})
    n = normalize.normalise(logs.numbered(logs.log_files(spark, "claude-code", str(root))), "claude-code")
    other = n.sessions.where("id = 'none'").withColumns({"tool": F.lit("codex"), "source_path": F.lit("/a"), "session_key": F.lit("/a"), "id": F.lit("other")})
    out = normalize.nested(normalize.Normalised(n.sessions.unionByName(other), n.turns, n.blocks, n.tool_calls, n.warnings))
    return out.repartition(3, "id")


def lines(path):
    return [x for part in sorted(glob.glob(f"{path}/part-*")) for x in open(part, encoding="utf-8").read().splitlines()]


def test_markdown_keeps_sessions_apart_and_in_order(nested, tmp_path):
    sinks.export(nested, str(tmp_path / "md"), WHEN, format_="markdown")
    body = "\n".join(lines(tmp_path / "md"))
    heads = [x for x in body.splitlines() if x.startswith("# Session")]
    assert heads == ["# Session s", "# Session s", "# Session none", "# Session other"]
    one, two = body.split("# Session s\n")[1:]
    assert "first of p1" in one and "answer p1" in one and "p2" not in one and "### ASSISTANT" in one
    assert two.index("first of p2") < two.index("second &lt;b&gt; of p2") and "p1" not in two and KEY not in body
    sinks.export(nested, str(tmp_path / "turns"), WHEN, format_="markdown", granularity="turn", raw_markdown=True)
    said = lines(tmp_path / "turns")
    assert [x for x in said if x.startswith("# ")] == ["# s / turn 0", "# s / turn 1", "# s / turn 2", "# s / turn 0", "# s / turn 1"] and "second <b> of p2" in said


def test_no_secret_is_left_in_any_leaf(nested, tmp_path):
    for f in ("jsonl", "document", "markdown", "json"):
        sinks.export(nested, str(tmp_path / f), WHEN, format_=f, raw_paths=True)
        text = "".join(open(p, encoding="utf-8").read() for p in glob.glob(f"{tmp_path}/{f}/**/part-*", recursive=True))
        assert KEY not in text and "[REDACTED]" in text
    record = next(r for r in (json.loads(x)["record"] for x in lines(tmp_path / "jsonl")) if r["id"] == "s" and "p1" in r["source_path"])
    call = next(b for t in record["turns"] for b in t["content"] if b["kind"] == "tool_use")
    assert (call["name"], call["tool_use_id"], json.loads(call["input"])) == ("[REDACTED]", "[REDACTED]", {"cmd": "x [REDACTED]", "n": 1.5})
    sinks.export(nested, str(tmp_path / "plain"), WHEN, redact_secrets=False)
    assert any(KEY in x for x in lines(tmp_path / "plain"))


@pytest.mark.parametrize("granularity", ["session", "turn"])
def test_the_parts_are_one_document(spark, nested, tmp_path, granularity):
    warnings = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), ("c", None)], "code string, line int")
    for name, records, warned in (("all", nested, warnings), ("none", nested.where("false"), warnings.where("false")), ("quiet", nested, None), ("only", nested.where("false"), warnings)):
        sinks.export(records, str(tmp_path / name), WHEN, format_="document", granularity=granularity, warnings=warned)
        d = json.loads("".join(lines(tmp_path / name)))
        assert list(d) == ["format", "generated_at", "granularity", "records", "warnings"] and d["granularity"] == granularity
        ids = [r["id"] if granularity == "session" else (r["session"]["id"], r["turn"]["turn_index"]) for r in d["records"]]
        whole = ["s", "s", "none", "other"] if granularity == "session" else [("s", 0), ("s", 1), ("s", 2), ("s", 0), ("s", 1)]
        assert ids == ([] if name in ("none", "only") else whole)
        assert sorted(w["code"] for w in d["warnings"]) == (["a", "a", "b", "b", "c"] if name in ("all", "only") else [])


def test_lines_follow_discovery_order(nested, tmp_path):
    for f in ("jsonl", "csv"):
        sinks.export(nested, str(tmp_path / f), WHEN, format_=f)
    assert [json.loads(x)["record"]["id"] for x in lines(tmp_path / "jsonl")] == ["s", "s", "none", "other"]
    assert [x.split(",")[0] for x in lines(tmp_path / "csv") if not x.startswith("session_id")] == ["s", "s", "none", "other"]


def test_islands_that_hold_nothing_stay_as_they_are(spark):
    texts = ['{"n":1.0,"a" : [ "x"]}', '{"k":"TOKEN\\u003dabc"}', '{"k":"Bearer\\nabc"}', "plain", None, '"/home/me/x"', "{broken sk-" + "b" * 30]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for paths in (False, True):
        got = [r[0] for r in frame.select(privacy.redact_json(F.col("t"), paths=paths)).collect()]
        assert got == [texts[0], '{"k":"[REDACTED]"}', '{"k":"[REDACTED]"}', "plain", None, '"~/x"' if paths else texts[5], "{broken [REDACTED]"]
    lists = spark.createDataFrame([(texts,), ([],), (None,)], "t array<string>")
    assert [r[0] for r in lists.select(privacy.redact_json(F.col("t"), lists=True)).collect()][1:] == [[], None]
