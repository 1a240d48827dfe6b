"""Sessions and their statistics over logs that grow (ST1, ST2).

Lines are mapped to events without state. The keyed state of a session holds what its row is made of: counts, bounds, the last usage of each message group and the
weight of each model, so that appended lines change the row without reading the old ones. Each call on a state is a round trip to the store, so the last groups and the
heaviest model lie in the row of the counts: a short session is read and written once a batch, however many lines came. Each change leaves as two rows, the old row with sign -1 and the new one
with sign +1; sums over sign * value are therefore right after any number of corrections.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.predicates import placeholder_model
from ..operators.adapters import USAGE
from ..operators.normalize import FIELDS, events_of, session_rows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GROUPS = 10_000  # groups of a session's new lines that a task holds before it writes them to the state
RECENT = 4  # groups that lie beside a session's counts; older ones have rows of their own
_USAGE = [f"{f} bigint" for f in FIELDS]
HEAD = ["turns bigint", "started string", "ended string", "cwd string", "cwd_line bigint", "meta string", "meta_line bigint", "model string", "model_line bigint", "groups bigint", "total_line bigint", "version bigint", *_USAGE, "model_weight bigint", "spilled boolean", f"recent array<struct<grp:string,line:bigint,used:int,{','.join(f'{f}:bigint' for f in FIELDS)}>>"]
CHANGE = f"session_key string, sign int, version bigint, cwd string, meta_id string, model string, started_at string, ended_at string, turn_count bigint, groups bigint, usage {USAGE}"


def narrow(lines: DataFrame, tool: str) -> DataFrame:
    """Lines (source_path, line, value) -> the columns of events that a session row needs; no text is shuffled."""
    r, t = F.col("record"), F.col("total")
    named = F.col("model") if tool == "gemini" else F.when(~placeholder_model(F.col("model")), F.col("model"))
    grouped = (r["role"] == "assistant") & r["grp"].isNotNull()
    return events_of(lines, tool).select(
        "session_key", F.col("line").cast("bigint").alias("line"), F.when(r.isNotNull(), r["ts"]).alias("ts"), F.when(grouped & r["step"].isNull(), r["grp"]).when(grouped, F.concat_ws(":", F.lit("step"), F.col("line").cast("string"))).alias("grp"),
        (F.when(r.isNotNull() & ~F.coalesce(grouped, F.lit(False)), 1).otherwise(0) + F.size("results")).alias("own_turns"), "cwd", "meta_id", named.alias("model"), "weight",
        *(F.coalesce(F.when(grouped, r["usage"][f]), t[f]).alias(f) for f in FIELDS), F.when(t.isNotNull(), 2).when(grouped & r["usage"].isNotNull(), 1).otherwise(0).alias("used"),
    )


class SessionState(StatefulProcessor):
    """tool: a cumulative usage replaces the last one (B), a group's usage replaces the group's (A, C); the model is the last one (C) or the heaviest."""

    def __init__(self, tool: str):
        self.tool = tool

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", ", ".join(HEAD))
        self.groups = handle.getMapState("groups", "grp string", ", ".join(["line bigint", "used int", *_USAGE]))
        self.models = handle.getMapState("models", "model string", "weight bigint, line bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [h.split()[0] for h in HEAD]
        held = self.head.get()  # each call on a state is a round trip to the store
        known = held is not None
        h = dict(zip(names, held)) if known else {n: None for n in names} | {"turns": 0, "groups": 0, "version": 0, "spilled": False}
        h["recent"] = {g[0]: tuple(g[1:]) for g in h["recent"] or ()}
        before = self._row(key, h, -1) if known else None
        weights: dict[str, list[int]] = {}
        groups: dict[str, Row] = {}
        for r in rows:
            h["turns"] += r.own_turns
            if r.ts:
                h["started"], h["ended"] = min(h["started"] or r.ts, r.ts), max(h["ended"] or r.ts, r.ts)
            for name, value in (("cwd", r.cwd), ("meta", r.meta_id), *((("model", r.model),) if self.tool == "gemini" else ())):
                if value is not None and (h[f"{name}_line"] is None or r.line >= h[f"{name}_line"]):
                    h[name], h[f"{name}_line"] = value, r.line
            if r.model is not None and self.tool != "gemini":
                w = weights.setdefault(r.model, [0, r.line])
                weights[r.model] = [w[0] + r.weight, min(w[1], r.line)]
            if r.grp is not None:
                last = groups.get(r.grp)
                if last is None or (r.used == 1 and (last.used != 1 or r.line >= last.line)):
                    groups[r.grp] = r
                if len(groups) >= GROUPS:
                    self._grouped(h, groups)
            if r.used == 2 and (h["total_line"] is None or r.line >= h["total_line"]):
                h["total_line"], h["groups"] = r.line, 1
                h.update({f: r[f] for f in FIELDS})
        self._grouped(h, groups)
        if weights:
            self._weigh(h, weights)
        h["version"] += 1
        after = self._row(key, h, 1)
        if before is None or before[3:] != after[3:]:
            self.head.update(self._kept(h, names))
            if before is not None:
                yield before
            yield after
        else:
            h["version"] -= 1
            self.head.update(self._kept(h, names))

    def _kept(self, h: dict, names: list[str]) -> tuple:
        return tuple([(g, *v) for g, v in h["recent"].items()] if n == "recent" else h[n] for n in names)

    def _grouped(self, h: dict, groups: dict[str, Row]) -> None:
        """Of each group the row that holds its last usage among those that came."""
        for r in groups.values():
            self._group(h, r)
        groups.clear()

    def _group(self, h: dict, r: Row) -> None:
        """The group's own turn, once, and its last usage in place of the one before. Of a single group nulls are kept, of several they count as 0."""
        old = h["recent"].get(r.grp)
        if old is None and h["spilled"]:
            old = self.groups.getValue((r.grp,))
        if old is None:
            h["turns"] += 1
        old_line, old_used, *old_use = old if old is not None else (-1, 0, *(None,) * len(FIELDS))
        newer = r.used == 1 and self.tool != "codex" and (not old_used or r.line >= old_line)
        if newer:
            if not old_used:
                h["groups"] += 1
            for f, was in zip(FIELDS, old_use):
                single = h["groups"] == 1
                h[f] = r[f] if single else (h[f] or 0) + (r[f] or 0) - (was or 0)
            self._put(h, r.grp, (r.line, 1, *(r[f] for f in FIELDS)))
        elif old is None:
            self._put(h, r.grp, (r.line, 0, *(None,) * len(FIELDS)))

    def _put(self, h: dict, grp: str, value: tuple) -> None:
        """The group among the recent ones; the one that was put there first leaves for a row of its own."""
        recent = h["recent"]
        recent.pop(grp, None)
        recent[grp] = value
        if len(recent) > RECENT:
            oldest = next(iter(recent))
            self.groups.updateValue((oldest,), recent.pop(oldest))
            h["spilled"] = True

    def _weigh(self, h: dict, weights: dict[str, list[int]]) -> None:
        """Weights are positive, so a model only gains by lines that come: the heaviest is the one before or one that they name. It lies beside the counts, the others have rows."""
        if h["model"] in weights:
            w, line = weights.pop(h["model"])
            h["model_weight"], h["model_line"] = h["model_weight"] + w, min(h["model_line"], line)
        for model, (w, line) in weights.items():
            old = self.models.getValue((model,)) if h["model"] is not None else None
            now = (old[0] + w, min(old[1], line)) if old is not None else (w, line)
            best = (h["model_weight"], h["model_line"])
            if h["model"] is None or (now[0], -now[1]) > (best[0], -best[1]):
                if h["model"] is not None:
                    self.models.updateValue((h["model"],), best)
                h["model"], h["model_weight"], h["model_line"] = model, *now
            else:
                self.models.updateValue((model,), now)

    def _row(self, key, h: dict, sign: int) -> Row:
        use = {f: h[f] if h["groups"] == 1 else (h[f] or 0) for f in FIELDS} if h["groups"] else None
        return Row(session_key=key[0], sign=sign, version=h["version"], cwd=h["cwd"], meta_id=h["meta"], model=h["model"], started_at=h["started"], ended_at=h["ended"], turn_count=h["turns"], groups=h["groups"], usage=use and Row(**use))

    def close(self) -> None:
        pass


def session_changes(lines: DataFrame, tool: str) -> DataFrame:
    """Lines (source_path, line: any number that rises along the file, value), streaming or not -> session rows with sign and version. Needs the RocksDB state store."""
    made = narrow(lines, tool).groupBy("session_key").transformWithState(SessionState(tool), CHANGE, "append", "none")
    return session_rows(made, tool, "sign", "version")


def current_sessions(changes: DataFrame) -> DataFrame:
    """The changes seen so far -> each session's last row."""
    own = [c for c in changes.columns if c not in ("sign", "version")]
    last = changes.where("sign = 1").groupBy("session_key").agg(F.max_by(F.struct(*own), "version").alias("s"))
    return last.select("s.*")


def with_state_store(spark: SparkSession) -> None:
    """Keyed state with maps needs this store; it is a setting of the session that starts the query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
