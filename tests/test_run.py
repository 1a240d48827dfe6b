"""A whole run over three roots: missing roots, dated folders, size bound, broken files, filters; price files."""

import gzip
import json
from datetime import datetime, timezone

import pytest

from logloom.operators import pricing, run
from logloom.sources import logs


def put(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(x) + "\n" for x in lines))


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    root = tmp_path_factory.mktemp("home")
    said = lambda kind, t, text, **m: {"type": kind, "timestamp": t, "cwd": m.pop("cwd", "/w/app"), "message": {"role": kind, "content": text, **m}}
    put(root / "a" / "-w-app" / "one.jsonl", said("user", "2024-01-03T00:00:00Z", "find the bug"), said("assistant", "2024-01-03T01:00:00Z", [{"type": "text", "text": "fixed it"}], id="m"))
    put(root / "a" / "-w-other" / "two.jsonl", said("user", "2024-02-03T00:00:00Z", "the bug again", cwd="/w/other"))
    put(root / "a" / "-w-app" / "large.jsonl", said("user", "2024-01-03T00:00:00Z", "x" * 5000))
    put(root / "a" / "too" / "deep" / "x.jsonl", said("user", "2024-01-03T00:00:00Z", "lost"))
    packed = gzip.compress(json.dumps(said("user", "2024-01-03T00:00:00Z", "x")).encode() * 50)
    (root / "a" / "-w-app" / "cut.jsonl.gz").write_bytes(packed[: len(packed) // 2])
    for day in ("02", "05"):
        put(root / "b" / f"sessions/2024/01/{day}/rollout-{day}.jsonl", {"type": "session_meta", "payload": {"cwd": "/w/app"}}, {"type": "response_item", "timestamp": f"2024-01-{day}T09:00:00Z", "payload": {"type": "message", "role": "user", "content": [{"text": f"bug {day}"}]}})
    return {"claude-code": str(root / "a"), "codex": str(root / "b"), "gemini": str(root / "missing")}


def ids(n):
    return sorted(r.id for r in n.sessions.collect())


def test_all_sources(spark, roots):
    n = run.run(spark, roots, max_file_bytes=4000)
    assert ids(n) == ["cut.jsonl.gz", "large", "one", "rollout-02", "rollout-05", "two"]
    assert sorted(((w.session_key and w.session_key.split("/")[-1], w.code) for w in n.warnings.collect() if w.code != "malformed_line"), key=str) == sorted([("cut.jsonl.gz", "file_unreadable"), ("large.jsonl", "file_too_large"), (None, "source_unavailable")], key=str)
    with pytest.raises(FileNotFoundError):
        run.run(spark, roots, tools=["gemini"])


def test_filters(spark, roots):
    day = lambda d, h=0: datetime(2024, 1, d, h, tzinfo=timezone.utc)
    assert ids(run.run(spark, roots, tools=["codex"], since=day(2, 9))) == ["rollout-05"]  # the folder of the second is older than nine o'clock
    assert ids(run.run(spark, roots, tools=["codex"], since=day(2), until=day(3))) == ["rollout-02"]
    n = run.run(spark, roots, tools=["claude-code"], text="bug AND fixed")
    assert ids(n) == ["one"] and n.turns.count() == 2 and {r.session_key for r in n.blocks.collect()} == {r.session_key for r in n.sessions.collect()}
    assert ids(run.run(spark, roots, text="bug project:other")) == ["two"] and ids(run.run(spark, roots, tools=["codex"], projects=["/w/app"])) == ["rollout-02", "rollout-05"]


def test_status_of_sources(spark, roots, tmp_path):
    (tmp_path / "empty").mkdir()
    open_ = logs.reachable(spark, {"claude-code": roots["claude-code"], "codex": str(tmp_path / "empty"), "gemini": roots["gemini"]})
    files = logs.file_table(spark, "claude-code", roots["claude-code"])
    assert {r.tool: (r.status, r.detected) for r in logs.inventory(files, open_).collect()} == {"claude-code": ("ok", True), "codex": ("no files", False), "gemini": ("not detected", False)}


def document(**more):
    row = {"provider": "p", "model": "m-1", "aliases": ["m-1", "m"], "input": 1, "output": 2.5, "status": "current", "availability": "available", "sourceUrl": "https://x.org/p", "verifiedAt": "2024-01-01", "effectiveFrom": "2024-01-01"}
    return {"version": "v", "asOf": "2024-01-01", "sourceUrl": "https://x.org", "sources": [], "default": {"input": 1, "output": 1}, "models": [{**row, **more}, {**row, "model": "m-2", "aliases": ["m-2"]}]}


def test_price_files(spark, tmp_path):
    path = tmp_path / "prices.json"
    path.write_text(json.dumps(document(cacheRead=0.5, note="n"), indent=1))
    table = pricing.load_prices(spark, str(path))
    assert [(r.row_ord, r.model, r.aliases, r.input, r.cache_read, r.cache_write, r.note) for r in table.orderBy("row_ord").collect()] == [(0, "m-1", ["m-1", "m"], 1.0, 0.5, None, "n"), (1, "m-2", ["m-2"], 1.0, None, None, None)]
    assert table.schema.simpleString() == pricing.prices(spark).schema.simpleString()
    for bad, rule in (({"input": -1}, "0: negative_rate"), ({"aliases": []}, "0: no_alias"), ({"aliases": [""]}, "0: empty_alias"), ({"status": "new"}, "0: status"), ({"sourceUrl": "x"}, "0: source_url"), ({"note": ""}, "0: note"), ({"verifiedAt": ""}, "0: verified_at"), ({"output": None}, "0: missing_rate")):
        path.write_text(json.dumps(document(**bad)))
        with pytest.raises(ValueError, match=rule):
            pricing.load_prices(spark, str(path))
    for text, rule in (("{broken", "unreadable"), (json.dumps({**document(), "models": []}), "models"), (json.dumps({**document(), "version": ""}), "version")):
        path.write_text(text)
        with pytest.raises(ValueError, match=rule):
            pricing.load_prices(spark, str(path))
    with pytest.raises(ValueError):
        pricing.load_prices(spark, str(tmp_path / "none.json"))
