"""Op 12. Conversation structure repair by Wagner-Fischer target alignment.

A repaired conversation reads `(s?(ua)+)?` by role initials. Its turns are aligned to the alternating grammar string of each feasible length: one table per last
letter holds the cost of aligning the rows from i on to the last m letters, so all lengths share it. Ukkonen's band keeps only the cells that a repair no dearer
than the incumbent, a greedy one, can pass: every blank or repeated row costs a deletion, and each letter more or less than the rows that may stay costs 2 or more.
Cheapest lengths that tie are traced from the table, and the least audit by ASCII is taken.

Conversations are cut into segments of at most SEGMENT rows by a range partitioning over (conversation, turn, role, text), so one with a third of all rows spreads over
many tasks. A segment's cheapest way from each state of the grammar to each other is a small matrix; the matrices of a conversation are composed from its end to its start, each segment is
traced from every state it may be entered in, and the entered states follow from the start. No audit ends a segment with an insertion (the next segment makes it), so
audits of one segment are never prefixes of each other and the least one is decided there. The digest is streamed over the segments in order.

Defined results: turns are ordered by (turn, role, text) after damage, null turns first; ties and repeated rows stay, a repeat counts as duplicate; null ids are one
conversation; an empty or unknown role never fits the grammar as it is; conversations without rows after damage give zeros; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, durable, partitions, table, tune

SEGMENT, SEGMENT_BYTES = 512, 1 << 20
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
SPACE, ENDS = "\t\n\v\f\r ", ".!?"
#: States of the grammar: nothing yet, after `s`, user next, assistant next; and what is expected in each.
START, LED, USER, MODEL = range(4)
ROLES = {START: "user", LED: "user", USER: "user", MODEL: "assistant"}
#: What the end of a conversation costs in each state, and the insertions that it takes.
END_COST, END_AUDIT = (0, 2 * INSERT, 0, INSERT), ("", "II", "", "I")
FAR = 1 << 40
FINE, BLANK, REPEATED, CUT = range(4)


def damaged(turns: DataFrame) -> DataFrame:
    """conversations -> conv_id, turn, role, text after damage; `lost` rows were dropped and only tell that the conversation exists."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", "")).when(fate != 0, space("text")).otherwise("")
    role = F.when(fate == 4, "user").when(fate != 0, space("role")).otherwise("")
    out = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), (fate == 0).alias("lost"), F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1)).alias("copies"))
    return out.select("conv_id", "turn", "role", "text", "lost", F.explode("copies").alias("copy")).drop("copy")


class Rows(NamedTuple):
    turns: list[int | None]
    roles: list[str]
    texts: list[str]


def segments(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """damaged rows -> conv_id, part, seg, whole (the conversation is this one segment), turns, roles, texts; ordered by (part, seg)."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ready: list[tuple] = []
        held, size, now, seg, first, any_run = Rows([], [], []), 0, None, 0, True, False

        def packed(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            c = list(zip(*out))
            types = [id_type, pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(c, types)], ["conv_id", "part", "seg", "whole", "turns", "roles", "texts"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for conv, turn, role, text, lost in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not any_run or conv != now:
                    if any_run:
                        ready.append((now, part, seg, not first and not open_run, *held))
                        seg, first = seg + 1, False
                    held, size, now, any_run, open_run = Rows([], [], []), 0, conv, True, False
                elif len(held.roles) >= most or size >= SEGMENT_BYTES:
                    ready.append((now, part, seg, False, *held))
                    seg, held, size, open_run = seg + 1, Rows([], [], []), 0, True
                if not lost:
                    held.turns.append(turn)
                    held.roles.append(role)
                    held.texts.append(text)
                    size += len(text) + len(role)
                if len(ready) >= 64:
                    yield packed(ready, id_type)
                    ready = []
        if any_run:
            ready.append((now, part, seg, False, *held))
            yield packed(ready, id_type)

    order = ["conv_id", "turn", "role", "text", "place"]
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("place")
    return ranged.mapInArrow(cut, f"conv_id {kind}, part int, seg bigint, whole boolean, turns array<bigint>, roles array<string>, texts array<string>")


def row_key(role: str, text: str) -> str:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def faults(rows: Rows, earlier: set[str] | None = None) -> list[int]:
    """Each row's first fault; earlier holds row keys of the conversation's segments before this one."""
    seen, out = set(), []
    for role, text in zip(rows.roles, rows.texts):
        shown = text.rstrip(SPACE)
        known = (role, text) in seen or (earlier and row_key(role, text) in earlier)
        out.append(BLANK if not shown else REPEATED if known else CUT if shown[-1] not in ENDS else FINE)
        seen.add((role, text))
    return out


class Table:
    """Alignments of a segment's rows, for given costs after it.

    cost[e][i] holds, for m within the band around the rows that may stay from i on, the cost of rows i.. against the last m letters of the alternating
    string that ends in state e (USER or MODEL).
    """

    def __init__(self, rows: Rows, fault: list[int], after: tuple[int, ...], incumbent: int | None = None):
        self.n, self.after = len(fault), after
        self.initial = [r[:1] for r in rows.roles]
        self.gone = [f in (BLANK, REPEATED) for f in fault]
        self.short = [CUT_SHORT if f == CUT else 0 for f in fault]
        self.stay = np.concatenate([np.cumsum([not g for g in self.gone][::-1])[::-1], [0]]).astype(int).tolist() if self.n else [0]
        forced = sum(DELETE if g else s for g, s in zip(self.gone, self.short))
        # any state can be left in any other by new roles for all that stays and one insertion
        most = forced + REROLE * self.stay[0] + INSERT + max(a for a in after if a < FAR) if incumbent is None else incumbent
        self.cost, self.width = {}, {}
        for e in (USER, MODEL):
            if after[e] < FAR and most - forced - after[e] >= 0:
                self.width[e] = (most - forced - after[e]) // 2
                self.cost[e] = self._fill(e)

    def _fill(self, e: int) -> list[np.ndarray]:
        w = self.width[e]
        size = 2 * w + 1
        step = 2 * np.arange(size)
        row = np.full(size, FAR, np.int64)
        row[w] = self.after[e]
        out = [row]
        for i in range(self.n - 1, -1, -1):
            low = w - self.stay[i]  # the place of m = 0
            if self.gone[i]:
                new = row + DELETE
            else:
                wants_user = (self.initial[i] != "u") * REROLE + self.short[i]
                wants_model = (self.initial[i] != "a") * REROLE + self.short[i]
                odd, even = (wants_model, wants_user) if e == USER else (wants_user, wants_model)
                add = np.full(size, odd)
                add[low % 2 :: 2] = even
                new = row + add
                if low >= 0:
                    new[: low + 1] = FAR
                new[:-1] = np.minimum(new[:-1], row[1:] + DELETE)
            if low > 0:
                new[:low] = FAR
            row = np.minimum(np.minimum.accumulate(new - step) + step, FAR)
            out.append(row)
        return out[::-1]

    def at(self, e: int, i: int, m: int) -> int:
        b = m - self.stay[i] + self.width[e]
        return int(self.cost[e][i][b]) if m >= 0 and 0 <= b <= 2 * self.width[e] else FAR

    def lengths(self, i: int, state: int) -> list[tuple[int, int, int]]:
        """(cost, e, m) of the cheapest lengths from row i on, when the next letter is state's; LED and START need one letter at least."""
        found, best = [], FAR
        for e, rows in self.cost.items():
            w, begin = self.width[e], self.width[e] - self.stay[i]
            m = np.arange(2 * w + 1) - begin
            expects = np.where(m % 2 == 0, e, USER + MODEL - e)
            fits = (m >= (1 if state in (START, LED) else 0)) & (expects == (MODEL if state == MODEL else USER))
            c = np.where(fits, rows[i], FAR)
            least = int(c.min())
            if least < best:
                found, best = [], least
            if least == best < FAR:
                found += [(best, e, int(x)) for x in m[c == best]]
        return found

    def trace(self, e: int, i: int, m: int) -> str:
        """The least audit of rows i.. against the last m letters that end in state e."""
        out = []
        while i < self.n or m:
            here = self.at(e, i, m)
            letter = MODEL if (m % 2 == 1) == (e == USER) else USER  # what is m letters from the end
            fits = m > 0 and i < self.n and self.initial[i] == ("a" if letter == MODEL else "u")
            if i < self.n and self.at(e, i + 1, m) + DELETE == here:
                out.append("D")
                i += 1
            elif m and i < self.n and self.at(e, i, m - 1) + INSERT == here:
                out.append("I")
                m -= 1
            elif fits:
                out.append("K")
                i, m = i + 1, m - 1
            else:
                out.append("R")
                i, m = i + 1, m - 1
        return "".join(out)

    def ways(self, state: int, i: int = 0) -> list[tuple[int, str, int]]:
        """(cost, audit, state after the rows) of the cheapest ways of each kind from row i on."""
        out = [(c, self.trace(e, i, m), e) for c, e, m in self.lengths(i, state)]
        if state in (START, LED) and self.after[state] < FAR:
            out.append((DELETE * (self.n - i) + self.after[state], "D" * (self.n - i), state))
        return out

    def led(self) -> list[tuple[int, str, int]]:
        """Ways that keep a first `s`: all rows before it go."""
        out = []
        best = min((w[0] for w in self.ways(START)), default=FAR)
        for k in range(self.n):
            if DELETE * k > best:
                break
            if self.initial[k] == "s" and not self.gone[k]:
                for c, audit, e in self.ways(LED, k + 1):
                    out.append((c + DELETE * k + self.short[k], "D" * k + "K" + audit, e))
                    best = min(best, out[-1][0])
        return out

    def best(self, state: int) -> tuple[int, str, int] | None:
        """The cheapest way from the state, the least audit among equals."""
        ways = self.ways(state) + (self.led() if state == START else [])
        return min(ways, key=lambda w: (w[0], w[1])) if ways else None


def incumbent(rows: Rows, fault: list[int], after: tuple[int, ...] = END_COST) -> int:
    """Cost of a greedy repair from the start: insert before a turn of the wrong role, unless the next one is of the same role, then rerole."""
    staying = [(r[:1], CUT_SHORT if f == CUT else 0) for r, f in zip(rows.roles, fault) if f in (FINE, CUT)]
    cost, state = DELETE * (len(fault) - len(staying)), START
    for k, (initial, short) in enumerate(staying):
        cost += short
        if k == 0 and initial == "s":
            state = LED
            continue
        want = "a" if state == MODEL else "u"
        if initial != want:
            turned = initial not in ("u", "a") or (k + 1 < len(staying) and staying[k + 1][0] == initial)
            cost += REROLE if turned else INSERT
            if not turned:
                continue  # the insertion and this turn leave the state as it was
        state = USER if state == MODEL else MODEL
    return cost + after[state]


def matrix(rows: Rows, fault: list[int]) -> list[int]:
    """Cheapest cost from each state (rows of the matrix) to each other over the segment; FAR if there is no way."""
    out = []
    tables = {e: Table(rows, fault, tuple(0 if e == x else FAR for x in range(4))) for e in range(4)}
    for state in range(4):
        for e in range(4):
            way = tables[e].best(state)
            out.append(way[0] if way and way[2] == e else FAR)
    return out


def rendered(rows: Rows, audit: str, state: int) -> list[str]:
    """The repaired rows as `role:text`."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            i += 1
            continue
        role = rows.roles[i] if letter == "K" else ROLES[state]
        out.append(f"{role}:{rows.texts[i] if letter != 'I' else ''}")
        i += letter != "I"
        state = LED if state == START and letter == "K" and role[:1] == "s" else USER if state == MODEL else MODEL
    return out


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_LONG = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(rows: Rows) -> tuple:
    """A conversation that is one segment -> the columns of RESULT and the repaired lines."""
    fault = faults(rows)
    t = Table(rows, fault, END_COST, incumbent(rows, fault))
    cost, audit, state = t.best(START)
    lines = rendered(rows, audit + END_AUDIT[state], START)
    known = {x for x in rows.turns if x is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    return gaps, fault.count(BLANK), fault.count(REPEATED), fault.count(CUT), illegal([r[:1] for r in rows.roles]), cost, audit + END_AUDIT[state], sha(lines), lines


def solved(whole: DataFrame) -> DataFrame:
    """Segments that are whole conversations -> conv_id, RESULT."""
    kind = whole.schema["conv_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [repaired(Rows(*r))[:8] for r in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))]
            columns = list(zip(*got)) if got else [()] * 8
            arrays = [pa.array(list(c), pa.int64() if n in _LONG else pa.string()) for c, n in zip(columns, (*_LONG, "audit", "repaired_sha256"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["conv_id", *_LONG, "audit", "repaired_sha256"])

    return whole.select("conv_id", "turns", "roles", "texts").mapInArrow(each, f"conv_id {kind}, {RESULT}")


def _told(rows: dict, types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in types.items()], list(types))


def with_earlier(open_: DataFrame) -> DataFrame:
    """Open segments with `earlier`: the row keys of theirs that an earlier segment of the conversation holds too. At most SEGMENT each."""
    text = lambda x: F.concat(F.length(x["roles"]).cast("string"), F.lit(":"), x["roles"], x["texts"])
    keys = open_.select("cid", "part", "seg", F.explode(F.array_distinct(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.md5(text(x))))).alias("h"))
    first = keys.groupBy("cid", "h").agg(F.min(F.struct("part", "seg")).alias("first"))
    again = keys.join(first, ["cid", "h"]).where(F.struct("part", "seg") > F.col("first"))
    return open_.join(again.groupBy("cid", "part", "seg").agg(F.collect_list("h").alias("earlier")), ["cid", "part", "seg"], "left")


def _segment_rows(batch: pa.RecordBatch) -> Iterator[tuple[Rows, list[int]]]:
    for turns, roles, texts, earlier in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("turns", "roles", "texts", "earlier"))):
        rows = Rows(turns, roles, texts)
        yield rows, faults(rows, set(earlier or ()))


def summed(judged: DataFrame) -> DataFrame:
    """One small row a segment: its matrix and what the counts of the conversation need."""
    types = {
        "cid": pa.string(), "part": pa.int32(), "seg": pa.int64(), "matrix": pa.list_(pa.int64()), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(),
        "first": pa.string(), "last": pa.string(), "low": pa.int64(), "high": pa.int64(), "turns": pa.int64(),
    }

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in types} | {n: batch.column(n).to_pylist() for n in ("cid", "part", "seg")}
            for rows, fault in _segment_rows(batch):
                known, initials = {x for x in rows.turns if x is not None}, [r[:1] for r in rows.roles]
                made = (matrix(rows, fault), fault.count(BLANK), fault.count(REPEATED), fault.count(CUT), illegal(initials), *((initials[0], initials[-1]) if initials else (None, None)), *((min(known), max(known)) if known else (None, None)), len(known))
                for n, v in zip(list(types)[3:], made):
                    out[n].append(v)
            yield _told(out, types)

    return judged.mapInArrow(each, "cid string, part int, seg bigint, matrix array<bigint>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, low bigint, high bigint, turns bigint")


def traced(judged: DataFrame) -> DataFrame:
    """Segments with the cost `after` them -> the state that each entered state ends in, and its audit."""
    types = {"cid": pa.string(), "part": pa.int32(), "seg": pa.int64(), "ends": pa.list_(pa.int32()), "audits": pa.list_(pa.string())}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: batch.column(n).to_pylist() for n in ("cid", "part", "seg")} | {"ends": [], "audits": []}
            for (rows, fault), after in zip(_segment_rows(batch), batch.column("after").to_pylist()):
                t = Table(rows, fault, tuple(after))
                ways = [t.best(state) for state in range(4)]
                out["ends"].append([w[2] if w else -1 for w in ways])
                out["audits"].append([w[1] if w else "" for w in ways])
            yield _told(out, types)

    return judged.mapInArrow(each, "cid string, part int, seg bigint, ends array<int>, audits array<string>")


def composed(sums: DataFrame) -> DataFrame:
    """Rows of `summed` -> cid, part, seg, after (costs of what follows), and in the conversation's first segment its counts and its cost. A group is a 512th of its conversation."""

    def each(g):
        g = g.sort_values(["part", "seg"], ignore_index=True)
        costs, after = [], np.array(END_COST, np.int64)
        for m in g["matrix"][::-1]:
            costs.append(after.tolist())
            after = np.minimum((np.array(m, np.int64).reshape(4, 4) + after).min(axis=1), FAR)
        some = g[g["first"].notna()]
        lasts, firsts = some["last"].tolist(), some["first"].tolist()
        border = sum(a + b not in ("su", "ua", "au") for a, b in zip(lasts, firsts[1:]))
        numbered = g[g["turns"] > 0]
        shared = sum(a == b for a, b in zip(numbered["high"].tolist(), numbered["low"].tolist()[1:]))
        gaps = int(numbered["high"].iloc[-1] - numbered["low"].iloc[0] + 1 - numbered["turns"].sum() + shared) if len(numbered) else 0
        out = g[["cid", "part", "seg"]].copy()
        out["after"] = costs[::-1]
        for n, v in (("gaps", gaps), ("blank", g["blank"].sum()), ("duplicate", g["duplicate"].sum()), ("truncated", g["truncated"].sum()), ("illegal", g["illegal"].sum() + border), ("cost", int(after[START]))):
            out[n] = int(v)
        return out

    return sums.groupBy("cid").applyInPandas(each, "cid string, part int, seg bigint, after array<bigint>, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint")


def entered(traces: DataFrame) -> DataFrame:
    """Rows of `traced` -> the state that each segment is entered in, its audit, and what ends the conversation."""

    def each(g):
        g = g.sort_values(["part", "seg"], ignore_index=True)
        state, states, audits = START, [], []
        for ends, found in zip(g["ends"], g["audits"]):
            states.append(state)
            audits.append(found[state])
            state = int(ends[state])
        audits[-1] += END_AUDIT[state]
        out = g[["cid", "part", "seg"]].copy()
        out["state"], out["audit"] = states, audits
        return out

    return traces.groupBy("cid").applyInPandas(each, "cid string, part int, seg bigint, state int, audit string")


def digested(judged: DataFrame, ways: DataFrame) -> DataFrame:
    """cid, audit, repaired_sha256: a conversation's segments stream through its digest in order."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, audit, some = None, hashlib.sha256(), [], False
        types = {"cid": pa.string(), "audit": pa.string(), "repaired_sha256": pa.string()}
        for batch in batches:
            for cid, turns, roles, texts, state, letters in zip(*(batch.column(n).to_pylist() for n in ("cid", "turns", "roles", "texts", "state", "audit"))):
                if cid != now:
                    if now is not None:
                        yield _told({"cid": [now], "audit": ["".join(audit)], "repaired_sha256": [h.hexdigest()]}, types)
                    now, h, audit, some = cid, hashlib.sha256(), [], False
                audit.append(letters)
                lines = rendered(Rows(turns, roles, texts), letters, state)
                if lines:
                    h.update(("\n" * some + "\n".join(lines)).encode())
                    some = True
        if now is not None:
            yield _told({"cid": [now], "audit": ["".join(audit)], "repaired_sha256": [h.hexdigest()]}, types)

    rows = judged.select("cid", "part", "seg", "turns", "roles", "texts").join(ways, ["cid", "part", "seg"])
    return rows.repartition(partitions(judged.sparkSession), "cid").sortWithinPartitions("cid", "part", "seg").mapInArrow(each, "cid string, audit string, repaired_sha256 string")


def repair(rows: DataFrame, most: int = SEGMENT) -> DataFrame:
    """Damaged rows (conv_id, turn, role, text, lost) -> conv_id and the columns of RESULT, one row a conversation."""
    cut = durable(segments(rows.select("conv_id", "turn", "role", "text", "lost"), most))
    open_ = cut.where("NOT whole").drop("whole").withColumn("cid", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    judged = durable(with_earlier(open_))
    sums = durable(summed(judged))
    costs = durable(composed(sums))
    ways = durable(entered(traced(judged.join(costs.select("cid", "part", "seg", "after"), ["cid", "part", "seg"]))))
    counts = costs.groupBy("cid").agg(*(F.first(c).alias(c) for c in _LONG))
    ids = judged.groupBy("cid").agg(F.first("conv_id").alias("conv_id"))
    long = durable(ids.join(counts, "cid").join(digested(judged, ways), "cid").select("conv_id", *_LONG, "audit", "repaired_sha256"))
    discard(judged, sums, costs, ways)
    return solved(cut.where("whole")).unionByName(long)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return repair(damaged(table(spark, sf_dir, "conversations")))
