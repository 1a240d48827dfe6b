"""Logs that grow, break or are pruned: the data source, keyed session state, and statistics that take corrections."""

import gzip
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from logloom.operators import normalize, stats
from logloom.sources import agent_logs, logs
from logloom.streaming import ingest, sessions


def said(kind, t, content, **more):
    return {"type": kind, "timestamp": t, "cwd": more.pop("cwd", ""), "message": {"role": kind, "content": content, **more}}


def tool_a(r, k):
    day = f"2024-01-{r.randrange(1, 9):02}T00:00:00Z"
    if r.random() < 0.4:
        return said("user", day, [{"type": "tool_result", "tool_use_id": "x", "content": "y"}] if r.random() < 0.3 else f"u{k}", cwd=r.choice(["", "/w/a", "/w/b"]))
    use = {"usage": {"input_tokens": k, **({"output_tokens": 3} if r.random() < 0.5 else {})}} if r.random() < 0.8 else {}
    return said("assistant", day, [{"type": "text", "text": "t"}], id=f"m{r.randrange(6)}", model=r.choice(["claude-sonnet-4-5", "claude-opus-4-1", "<synthetic>"]), **use)


def tool_b(r, k):
    item = lambda **p: {"type": "response_item", "timestamp": f"2024-01-{r.randrange(1, 9):02}T00:00:00Z", "payload": p}
    return r.choice([
        lambda: {"type": "session_meta", "payload": {"id": f"s{k}", "cwd": "/w", "model": "gpt-5.4"}}, lambda: item(type="message", role="assistant", content=[{"text": "a"}]), lambda: item(type="function_call", call_id=f"c{r.randrange(3)}", name="n"),
        lambda: item(type="function_call_output", call_id="c1", output="o"), lambda: {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": k, "total_tokens": 2 * k}}}}, lambda: item(type="message", role="user", content=[{"text": "q"}]),
    ])()


def tool_c(r, k):
    return {"role": r.choice(["user", "model"]), "timestamp": f"2024-01-{r.randrange(1, 9):02}T00:00:00Z", "model": f"gemini-{k % 3}", "parts": [{"text": "x"}, {"functionCall": {"name": "f"}}][: r.randrange(1, 3)], "usageMetadata": {"promptTokenCount": k}}


PATHS = {"claude-code": "-p-{}/s{}.jsonl", "codex": "sessions/2024/01/0{}/rollout-{}.jsonl", "gemini": "p{}/chats/session-{}.jsonl"}


@pytest.mark.parametrize("tool,line", [("claude-code", tool_a), ("codex", tool_b), ("gemini", tool_c)])
def test_appends_in_three_batches_equal_one(spark, tmp_path, tool, line):
    root, changes, r = tmp_path / "in", str(tmp_path / "changes"), random.Random(7)
    runs = []
    for batch in range(3):
        for k in range(4):
            if batch or k < 3:  # the last file arrives later
                path = root / PATHS[tool].format(k + 1, k)
                path.parent.mkdir(parents=True, exist_ok=True)
                with path.open("a") as f:
                    # a line may be cut where a batch ends
                    f.write("".join(json.dumps(line(r, batch * 100 + i)) + "\n" for i in range(r.randrange(1, 9))) + ("{broken\n" if k == 1 else "\n"))
                    if batch == 1:
                        tail = json.dumps(line(r, 150)) + "\n"
                        f.write(tail[:20])
        q = ingest.follow(spark, str(root), tool, str(tmp_path / "state"), changes, settleSeconds=3600)
        q.awaitTermination()
        assert q.exception() is None
        runs.append(sum(p["numInputRows"] for p in q.recentProgress))
        if batch == 1:
            for k in range(4):
                with (root / PATHS[tool].format(k + 1, k)).open("a") as f:
                    f.write("\n")
    made = spark.read.parquet(changes)
    want = normalize.normalise(logs.numbered(logs.log_files(spark, tool, str(root))), tool).sessions
    rows = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert rows(sessions.current_sessions(made)) == rows(want)
    assert sum(runs) == sum(1 for p in root.rglob("*.jsonl") for _ in p.open())  # every line was read once
    key = lambda df: sorted(map(tuple, df.where("sessions <> 0").select("day", "tool", "sessions", "turns", "tokens").collect()), key=str)
    expected = key(ingest.running_stats(stats.facts(want)))
    assert key(ingest.running_stats(ingest.signed_facts(made))) == expected
    stream = ingest.running_stats(ingest.signed_facts(spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(changes)))
    query = stream.writeStream.outputMode("complete").format("memory").queryName(f"stats_{tool[:3]}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert key(spark.table(f"stats_{tool[:3]}")) == expected


def test_a_broken_file_does_not_stop_the_others(spark, tmp_path):
    good = json.dumps(said("user", "2024-01-01T00:00:00Z", "hi")) + "\n"
    (tmp_path / "p").mkdir()
    for k in range(5):
        (tmp_path / "p" / f"g{k}.jsonl").write_text(good * (k + 1))
    packed = gzip.compress(b"".join((good.replace("hi", f"hi {random.Random(i).random()}")).encode() for i in range(3000)))
    (tmp_path / "p" / "whole.jsonl.gz").write_bytes(gzip.compress(good.encode() * 7))
    (tmp_path / "p" / "cut.jsonl.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "p" / "junk.jsonl.gz").write_bytes(b"not gzip at all")
    (tmp_path / "p" / "bytes.jsonl").write_bytes(b"\xff\xfe\n" + good.encode())
    lines, bad = agent_logs.readable(agent_logs.load(spark, "claude-code", str(tmp_path)))
    n = normalize.normalise(logs.numbered(lines), "claude-code", too_large=bad)
    counts = {r.id: r.turn_count for r in n.sessions.collect()}
    assert {k: counts[k] for k in counts if k.startswith("g")} == {f"g{k}": k + 1 for k in range(5)} and counts["whole.jsonl.gz"] == 7 and counts["bytes"] == 1 and counts["junk.jsonl.gz"] == 0
    warned = sorted((w.session_key.split("/")[-1], w.code) for w in n.warnings.collect())
    assert warned == [("bytes.jsonl", "malformed_line"), ("cut.jsonl.gz", "file_unreadable"), ("junk.jsonl.gz", "file_unreadable")]
    assert 0 < counts["cut.jsonl.gz"] < 3000


def test_lines_over_pieces(spark, tmp_path):
    (tmp_path / "p").mkdir()
    body = ["" if k % 7 == 0 else json.dumps({"k": k, "pad": "é" * (k % 41)}) for k in range(1, 3001)]
    (tmp_path / "p" / "a.jsonl").write_text("\r\n".join(body))
    (tmp_path / "p" / "empty.jsonl").write_text("")
    raw = agent_logs.load(spark, "claude-code", str(tmp_path), pieceBytes=1000)
    assert raw.rdd.getNumPartitions() > 20
    got = logs.numbered(agent_logs.readable(raw)[0]).select(F.get_json_object("value", "$.k").cast("int").alias("k"), "line").collect()
    assert sorted(r.line for r in got) == [k for k in range(1, 3001) if k % 7] and all(r.k == r.line for r in got)


def test_predicates_prune_files(spark, tmp_path):
    for day in range(1, 7):
        for k in range(3):
            path = tmp_path / f"sessions/2024/01/0{day}/rollout-{k}.jsonl"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text('{"type":"x"}\n' * (1 + 100 * k))
    (tmp_path / "rollout-loose.jsonl").write_text('{"type":"x"}\n')

    def files(where=None, **options):
        df = agent_logs.load(spark, "codex", str(tmp_path), **options)
        df = df.where(where) if where else df
        found = df.select("source_path").distinct().count()
        return found, df.where("start = 0").count()

    assert files()[0] == 19 and files("day = '2024-01-03'") == (3, 3) and files("day >= '2024-01-05'") == (6, 6) and files("file_size < 100") == (7, 7) and files("day IN ('2024-01-01', '2024-01-02') AND file_size > 100") == (4, 4)
    assert files("day IS NULL") == (1, 1) and files("tool = 'gemini'") == (0, 0) and files(since="2024-01-06") == (4, 4)
    # what is not a file's column stays with Spark, and pruned files are never opened
    reader = agent_logs.Reader({"tool": "codex", "root": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    kept = list(reader.pushFilters([EqualTo(("day",), "2024-01-03"), GreaterThan(("start",), 5), StringContains(("value",), "x")]))
    assert [type(f).__name__ for f in kept] == ["GreaterThan", "StringContains"] and len(reader.files()) == 3
    os.chmod(tmp_path / "sessions/2024/01/01/rollout-0.jsonl", 0)
    assert agent_logs.load(spark, "codex", str(tmp_path)).where("day = '2024-01-02' AND error IS NOT NULL").count() == 0


def test_an_unfinished_line_waits_until_it_settles(tmp_path):
    (tmp_path / "p").mkdir()
    path = tmp_path / "p" / "a.jsonl"
    path.write_bytes(b'{"a":1}\n{"b"')
    tail = agent_logs.TailReader({"tool": "claude-code", "root": str(tmp_path), "settleSeconds": "3600"})
    assert list(tail.latestOffset().values()) == [8]
    os.utime(path, (time.time() - 7200,) * 2)
    settled = agent_logs.TailReader({"tool": "claude-code", "root": str(tmp_path), "settleSeconds": "3600"})
    end = settled.latestOffset()
    assert list(end.values()) == [12]
    got = [b for p in settled.partitions({k: 8 for k in end}, end) for b in settled.read(p)]
    assert [v for b in got for v in b.column(7).to_pylist()] == ['{"b"']
    assert settled.partitions(end, end) == []
