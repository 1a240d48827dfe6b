"""Op 12 against a brute force: every audit by a plain search over states, whole and cut into segments."""

import hashlib
import random
import zlib

import pytest

from logloom.llm import repair
from tests.conftest import SF, rows as table_rows

SPACE = "\t\n\v\f\r "


def brute(role_text, turns):
    """Plain shortest path over (row, state), carrying whole audits; no alignment, no bands."""
    seen, fault = set(), []
    for r, t in role_text:
        shown = t.strip(SPACE)
        fault.append("b" if not shown else "d" if (r, t) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((r, t))
    n = len(role_text)
    best = [{} for _ in range(n + 1)]
    best[0][""] = (0, "", ())

    def push(i, state, way):
        if i <= n and (state not in best[i] or way[:2] < best[i][state][:2]):
            best[i][state] = way
            return True
        return False

    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    for i in range(n + 1):
        for _ in range(4):  # insertions move between states of one row
            for state, (c, audit, lines) in list(best[i].items()):
                for letter, to in follow[state].items():
                    if letter != "s":
                        role = "user" if letter == "u" else "assistant"
                        push(i, to, (c + 2, audit + "I", (*lines, role + ":")))
        if i == n:
            break
        for state, (c, audit, lines) in list(best[i].items()):
            r, t = role_text[i]
            push(i + 1, state, (c + 3, audit + "D", lines))
            if fault[i] not in ("b", "d"):
                extra = fault[i] == "t"
                for letter, to in follow[state].items():
                    if r[:1] == letter:
                        push(i + 1, to, (c + extra, audit + "K", (*lines, f"{r}:{t}")))
                    elif letter != "s":
                        role = "user" if letter == "u" else "assistant"
                        push(i + 1, to, (c + 2 + extra, audit + "R", (*lines, f"{role}:{t}")))
    cost, audit, lines = min((best[n][s] for s in ("", "a") if s in best[n]), key=lambda w: w[:2])
    known = {x for x in turns if x is not None}
    initials = [r[:1] for r, _ in role_text]
    return (
        max(known) - min(known) + 1 - len(known) if known else 0, fault.count("b"), fault.count("d"), fault.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def brute_damage(rows):
    """(conv_id, turn, role, text) rows -> conversation: its rows after damage, in order."""
    out = {}
    say = lambda v: " " if v is None else v
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        k = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = "user" if k == 4 else say(role), "" if k == 1 else say(text)
        if k == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        kept += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, v in out.items()}


def expected(rows):
    return {c: brute([(r, t) for _, r, t in v], [x for x, _, _ in v]) for c, v in brute_damage(rows).items()}


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = [(r.conv_id, tuple(r[n] for n in names)) for r in df.collect()]
    assert len(dict(found)) == len(found)
    return dict(found)


SCHEMA = "conv_id long, turn long, role string, text string, gaps string"


def noisy(seed, n):
    r = random.Random(seed)
    pool = ["Fine.", "Yes!", "cut", "", "  ", "Why?", "a.b", "Fine. "]
    return [r.choice(["user", "assistant", "system", "tool", "", "agent", "user", "assistant"]) for _ in range(n)], [r.choice(pool) + str(r.randrange(9)) * (r.random() < 0.4) + "." * (r.random() < 0.5) for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_alignment_equals_search(seed):
    roles, texts = noisy(seed, seed % 23)
    rows = repair.Rows(list(range(len(roles))), roles, texts)
    assert repair.repaired(rows)[:8] == brute(list(zip(roles, texts)), rows.turns)


def test_band_is_narrow():
    roles = ["user", "assistant"] * 200
    rows = repair.Rows(list(range(400)), roles[:399], [f"text {k}." for k in range(399)])
    fault = repair.faults(rows)
    t = repair.Table(rows, fault, repair.END_COST, repair.incumbent(rows, fault))
    assert max(t.width.values()) <= 1 and t.best(repair.START)[:2] == (2, "K" * 399)


def test_query_equals_brute_force(spark):
    conversations = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(repair.op12_repair(spark, SF)) == expected(conversations)


@pytest.mark.parametrize("size", [1, 3, 512])
def test_odd_rows_and_segments(spark, size):
    """Segments of one row and of three give what whole conversations give; ties, repeats, nulls, long conversations."""
    rows = [(None, 1, "user", "Hi."), (None, None, None, None), (7, None, "user", "x"), (7, None, "user", "x"), (7, 3, "assistant", None), (8, 1, "user", ""), (9, 5, "system", "S.")]
    for c in range(20, 30):
        roles, texts = noisy(c, 25)
        rows += [(c, k // 2 if c % 2 else k, r, t, ) for k, (r, t) in enumerate(zip(roles, texts))]
    rows += [(40, k, ("user", "assistant")[k % 2], "w" * 1000 + ("." if k % 5 else "")) for k in range(60)] + [(41, 0, "user", "long " * 50_000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    assert got(repair.repair(repair.damaged(frame), size)) == expected(rows)


def test_empty_table(spark):
    assert repair.repair(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_columns(spark):
    assert table_rows(repair.op12_repair(spark, SF).limit(1).toPandas())[0] == sorted(["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])
