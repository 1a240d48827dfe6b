"""The trigram index gives what a scan gives, and reads fewer files."""

import pytest
from pyspark.sql import functions as F

from logloom.functions.predicates import parse_query, sessions_with_text
from logloom.operators import search
from logloom.sources import trigrams

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "ÀÉ", "日本語", "x", "İstanbul"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = [(f"s{k}", t, 0, ("user", "assistant", "tool")[t % 3], "text", None if k % 17 == 0 and t == 1 else f"{WORDS[k % 9]} {WORDS[(k + t) % 7]}{k if t == 2 else ''}") for k in range(120) for t in range(4)] + [("rare", 0, 0, "user", "text", "a Needle in it"), (None, 0, 0, "user", "text", "lost alpha")]
    turns = spark.createDataFrame(rows, "session_key string, turn_index int, block_pos int, role string, kind string, text string")
    path = str(tmp_path_factory.mktemp("index") / "i")
    trigrams.build(turns, path, 32)
    return turns, path


@pytest.mark.parametrize("query", ["alpha", "ALPHA AND beta", "alpha OR needle", '"a needle"', "x", "x AND gamma", "x OR gamma", "日本語", "àé", "nothing-like-it", "gamma57", "project:p", "ha b", "i̇stan"])
def test_hits_equal_a_scan(spark, stored, query):
    turns, path = stored
    rows = lambda df: sorted(map(tuple, df.select("session_key", "turn_index", "text").collect()), key=str)
    assert rows(trigrams.indexed_hits(spark, path, query)) == rows(search.hits(turns, query))
    sessions = turns.select("session_key").distinct()
    q = parse_query(query)
    want = sorted((r[0] for r in (sessions_with_text(sessions, turns, q) if q.has_text else sessions).collect()), key=str)
    assert sorted((r[0] for r in trigrams.indexed_sessions(spark, path, sessions, query).collect()), key=str) == want


def test_files_are_skipped(spark, stored):
    _, path = stored
    every = len(spark.read.parquet(f"{path}/turns").inputFiles())
    assert len(trigrams.candidates(spark, path, parse_query("needle"))) == 1
    assert trigrams.candidates(spark, path, parse_query("zzzz")) == set() and trigrams.candidates(spark, path, parse_query("x")) is None
    plan = trigrams.pruned(spark, path, parse_query("needle"))
    read = plan.select(F.input_file_name().alias("f")).distinct().count()
    assert read == 1 < every
    assert "PartitionFilters: [isnotnull(part" in plan._jdf.queryExecution().executedPlan().toString()


def test_index_of_long_texts_costs_their_length(spark, tmp_path):
    """A text of 200,000 characters: cutting each trigram out of the whole text again would look at some 10^10 of them."""
    import random
    import time

    r = random.Random(3)
    long = "".join(r.choice("abcdeÀ日 ") for _ in range(200_000)) + "NEEDLE"
    turns = spark.createDataFrame([("a", 0, 0, "user", "text", long), ("b", 0, 0, "user", "text", "ab")], "session_key string, turn_index int, block_pos int, role string, kind string, text string")
    start = time.monotonic()
    trigrams.build(turns, str(tmp_path / "i"), 4)
    assert time.monotonic() - start < 60
    got = spark.read.parquet(str(tmp_path / "i" / "index")).collect()
    assert {g.gram for g in got} == trigrams.grams_of(long) and all(len(g.parts) == 1 for g in got)
    assert [h.session_key for h in trigrams.indexed_hits(spark, str(tmp_path / "i"), "needle").collect()] == ["a"]


def test_a_crowded_part_is_written_by_several_tasks(spark, tmp_path):
    rows = [("one" if k % 4 else f"s{k}", k, 0, "user", "text", f"{WORDS[k % 9]} {WORDS[k % 7]} {k * 7919 % 104729}" * 40) for k in range(4000)]
    turns = spark.createDataFrame(rows, "session_key string, turn_index int, block_pos int, role string, kind string, text string")
    held = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        trigrams.build(turns, str(tmp_path / "i"), 2)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", held)
    files = spark.read.parquet(str(tmp_path / "i" / "turns")).where("session_key = 'one'").select(F.input_file_name()).distinct().count()
    assert files > 1
    sessions = turns.select("session_key").distinct()
    got = {r[0] for r in trigrams.indexed_sessions(spark, str(tmp_path / "i"), sessions, "gamma AND omega").collect()}
    assert got == {r[0] for r in sessions_with_text(sessions, turns, parse_query("gamma AND omega")).collect()}
