"""Session state without a stream: calls on it, and rows that come in any number of batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import Row

from logloom.operators.normalize import FIELDS
from logloom.streaming import sessions


class Held:
    """A state handle that counts the calls made on it."""

    def __init__(self):
        self.calls = Counter()

    def getValueState(self, name, schema, *_):
        return One(self.calls, name)

    def getMapState(self, name, *_):
        return Many(self.calls, name)


class One:
    def __init__(self, calls, name):
        self.calls, self.name, self.value = calls, name, None

    def exists(self):
        self.calls[self.name] += 1
        return self.value is not None

    def get(self):
        self.calls[self.name] += 1
        return self.value

    def update(self, value):
        self.calls[self.name] += 1
        self.value = value


class Many:
    def __init__(self, calls, name):
        self.calls, self.name, self.value = calls, name, {}

    def containsKey(self, key):
        self.calls[self.name] += 1
        return key in self.value

    def getValue(self, key):
        self.calls[self.name] += 1
        return self.value.get(key)

    def updateValue(self, key, value):
        self.calls[self.name] += 1
        self.value[key] = value

    def iterator(self):
        self.calls[self.name] += 1
        return iter(self.value.items())


def row(line, grp, used=1, model="m1", weight=3, n=1):
    return Row(session_key="s", line=line, ts=f"2024-01-01T00:00:{line % 60:02}Z", grp=grp, own_turns=0 if grp else 1, cwd=None, meta_id=None, model=model if grp else None, weight=weight, **{f: n if grp and used else None for f in FIELDS}, used=used if grp else 0)


def run(batches, tool="claude-code"):
    handle, state = Held(), sessions.SessionState(tool)
    state.init(handle)
    out = [list(state.handleInputRows(("s",), iter(b), None)) for b in batches]
    return out, handle.calls


def test_a_short_session_is_read_and_written_once_a_batch():
    batches = [[row(10 * b + k, f"g{b}", n=k) for k in range(3)] + [row(10 * b + 5, None)] for b in range(3)]
    out, calls = run(batches)
    assert calls["groups"] == 0 and calls["models"] == 0 and calls["head"] == 2 * len(batches)
    last = out[-1][-1]
    assert last.turn_count == 6 and last.model == "m1" and last.usage.input_tokens == 3 * 2


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("tool", ["claude-code", "codex", "gemini"])
def test_batches_and_bounds_do_not_change_the_last_row(monkeypatch, tool, seed):
    r = random.Random(seed)
    lines = [row(k, r.choice([None, *(f"g{j}" for j in range(9))]), r.choice([0, 1]), r.choice(["m1", "m2", "m3"]), r.randrange(1, 9), r.randrange(50)) for k in range(60)]
    want = run([lines], tool)[0][-1][-1]
    r.shuffle(lines)
    cuts = sorted(r.sample(range(1, 60), 5))
    batches = [lines[a:b] for a, b in zip([0, *cuts], [*cuts, 60])]
    for recent, groups in ((4, 10_000), (1, 2), (100, 3)):
        monkeypatch.setattr(sessions, "RECENT", recent)
        monkeypatch.setattr(sessions, "GROUPS", groups)
        made = [x for b in run(batches, tool)[0] for x in b if x.sign == 1][-1]
        assert made.asDict() | {"version": 0} == want.asDict() | {"version": 0}
