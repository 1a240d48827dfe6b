"""Op 11 against a plain trie of dictionaries, with shards of a few turns, and its SQL; the double array against sets of prefixes."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from logloom.llm import trie
from tests.conftest import SF, oracle, rows as table_rows

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in conv.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    nodes = {}
    for c, s in made.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = leaves.get(s, 0) + (s not in kids)
        saved[s] = saved.get(s, 0) + (len(nodes[s]) - 1) * words
        if s:
            for total, v in ((kids, 1), (leaves, leaves[s]), (saved, saved[s])):
                total[s[:-1]] = total.get(s[:-1], 0) + v
    ends = lambda s: ",".join(map(str, sorted(c for c in nodes[s] if len(made[c]) == len(s))))
    return sorted(
        (min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), kids.get(s, 0), leaves[s], saved[s], hashlib.sha256(ends(s).encode()).hexdigest()) for s, m in nodes.items()
    )


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def small(seed, n):
    r = random.Random(seed)
    return [(c, k, r.choice(["user", "assistant", None]), r.choice(["a b", "a", None, " x  y z ", "w"])) for c in range(n) for k in range(r.choice([1, 1, 2, 3, 6]))]


SCHEMA = "conv_id long, turn long, role string, text string, keys string"


@pytest.mark.parametrize("turns", [1, 7, 100_000])
def test_shards_equal_one_trie(spark, turns):
    rows = small(5, 150) + [(1000 + c, k, "user", f"hot {k}") for c in range(90) for k in range(4)] + [(2000, k, "user", f"deep {k}") for k in range(300)] + [(2001, k, "user", f"deep {k}") for k in range(290)]
    rows += [(3000, None, "user", "tie"), (3000, None, "user", "tie"), (3000, 1, "b", "x"), (3000, 1, "a", "x"), (None, 0, "user", "lost"), (3001, 0, "user", "z " * 100_000), (-7, 0, "user", "neg")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert got(trie.prefix_trie(frame, turns)) == brute([(c, t, r, x) for c, t, r, x in rows])


def test_query_equals_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    made = trie.op11_trie(spark, SF)
    assert got(made) == brute(rows)
    assert table_rows(made.toPandas()) == table_rows(oracle(trie.ORACLE, SF))


def test_empty_table(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_double_array(seed):
    r = random.Random(seed)
    sequences = sorted({tuple(r.randrange(r.choice([2, 5, 400])) for _ in range(r.randrange(7))) for _ in range(r.choice([1, 20, 400]))})
    length = np.array([len(s) for s in sequences])
    start = np.cumsum(length) - length
    codes = np.array([c for s in sequences for c in s], np.int64)
    t = trie.DoubleArray(codes, start, length)
    node = {}
    for s in sequences:
        at = np.zeros(1, np.int64)
        for d, c in enumerate(s):
            at = t.step(at, np.array([c]))
            assert node.setdefault(s[: d + 1], int(at[0])) == int(at[0])
    assert len(set(node.values())) == len(node) == int((t.check >= 0).sum())
