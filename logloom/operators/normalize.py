"""Records and results -> sessions, turns, blocks, tool calls and warnings.

Lines become events by one projection, written once; what needs the order of a whole session is a prefix sum over ranges of its lines (see scans).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_TOOL_OUTPUT_CHARS, MAX_TURN_CHARS
from ..functions.predicates import placeholder_model
from ..sources.logs import ADAPTER_VERSIONS, checked, project_from_slug, session_id_from_path
from ..sources.scratch import written
from .adapters import ADAPTERS, STEPPED, USAGE, block
from .scans import SEGMENT, running

FIELDS = [x.split(":")[0] for x in USAGE[len("struct<") : -1].split(",")]


@dataclass
class Normalised:
    sessions: DataFrame
    turns: DataFrame
    blocks: DataFrame
    tool_calls: DataFrame
    warnings: DataFrame


def block_key(b: Column) -> Column:
    """Identity of a block inside a merged group."""
    own = F.when(b["kind"] == "tool_use", b["tool_use_id"]).when(b["kind"] == "image", F.concat_ws("|", b["media_type"], b["bytes"].cast("string"), b["note"])).otherwise(b["text"])
    return F.concat(b["kind"], F.lit(":"), F.coalesce(own, F.lit("")))


def first_blocks(blocks: DataFrame, keys: list[str], key: str = "bkey", order: tuple[str, ...] = ("line", "pos")) -> DataFrame:
    """A2: the first of equal blocks of a group."""
    w = Window.partitionBy(*keys, key).orderBy(*order)
    return blocks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def group_usage(records: DataFrame) -> DataFrame:
    """A4, first half: the last usage of each group (grouped records with usage only)."""
    return records.where("grp IS NOT NULL AND usage IS NOT NULL").groupBy("session_key", "grp").agg(F.max_by("usage", F.struct("line", "seq")).alias("usage"))


def session_usage(by_group: DataFrame) -> DataFrame:
    """A4, second half: one group keeps its nulls, several are summed with nulls as 0."""
    one = F.count("*") == 1
    parts = [F.when(one, F.max(F.col("usage")[f])).otherwise(F.sum(F.coalesce(F.col("usage")[f], F.lit(0)))).cast("bigint").alias(f) for f in FIELDS]
    return by_group.groupBy("session_key").agg(F.struct(*parts).alias("usage"), F.count("*").alias("groups"))


def last_value(facts: DataFrame, column: str, order: str = "line") -> DataFrame:
    """Last non-null value by line."""
    return facts.where(F.col(column).isNotNull()).groupBy("session_key").agg(F.max_by(column, order).alias(column))


def model_mode(facts: DataFrame) -> DataFrame:
    """Model of the largest summed weight, placeholders aside; the one seen first wins ties."""
    named = facts.where(F.col("model").isNotNull() & ~placeholder_model(F.col("model")))
    each = named.groupBy("session_key", "model").agg(F.sum("weight").alias("w"), F.min("line").alias("line"))
    return each.groupBy("session_key").agg(F.max_by("model", F.struct("w", -F.col("line"))).alias("model"))


def bounded(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def events_of(lines: DataFrame, tool: str) -> DataFrame:
    """Numbered lines -> one event row each (see adapters): checks and mapping in one pass, nothing shuffled."""
    return ADAPTERS[tool](checked(lines.withColumn("session_key", F.col("source_path")), tool))


def stepped(events: DataFrame, tool: str, span: int = SEGMENT) -> DataFrame:
    """Group names that hold the running count of the file's steps, by prefix sums over ranges of lines."""
    if tool not in STEPPED:
        return events
    r = F.col("record")
    counted = running(events, ["session_key"], {"steps": (["line"], F.col("emits"))}, span)
    named = F.when(r["step"].isNotNull() & r["grp"].isNotNull(), r.withField("grp", F.concat(r["grp"], (F.col("steps") + r["step"]).cast("string")))).otherwise(r)
    return counted.withColumn("record", named).drop("steps")


def records_of(events: DataFrame) -> DataFrame:
    return events.where("record IS NOT NULL").select("session_key", "line", "record.*")


def turn_parts(events: DataFrame) -> DataFrame:
    """session_key, line, tkey (the turn it belongs to), role, seq, late, ts, blocks: records, and a turn of its own for each result."""
    r = F.col("record")
    merged = (r["role"] == "assistant") & r["grp"].isNotNull()
    line = F.col("line").cast("string")
    own = F.struct(
        F.when(merged, F.concat(F.lit("assistant-"), r["grp"])).otherwise(F.concat_ws("-", r["role"], line, r["seq"].cast("string"))).alias("tkey"), r["role"].alias("role"), r["seq"].alias("seq"),
        F.when(merged, 1).otherwise(0).alias("late"), r["ts"].alias("ts"), r["blocks"].alias("blocks"),
    )

    def result(x: Column) -> Column:
        b = block(kind="tool_result", tool_use_id=x["call_id"], output=x["output"], status=F.when(x["is_error"], "error").otherwise("success"))
        return F.struct(F.concat_ws("-", F.lit("tool-result"), x["call_id"], line, x["seq"].cast("string")).alias("tkey"), F.lit("tool").alias("role"), x["seq"].alias("seq"), F.lit(0).alias("late"), F.lit(None).cast("string").alias("ts"), F.array(b).alias("blocks"))

    parts = F.concat(F.array_compact(F.array(F.when(r.isNotNull(), own))), F.transform("results", result))
    return events.select("session_key", "line", F.explode(parts).alias("p")).select("session_key", "line", "p.*")


def normalise(lines: DataFrame, tool: str, max_turn_chars: int = MAX_TURN_CHARS, max_output_chars: int = MAX_TOOL_OUTPUT_CHARS, files: DataFrame | None = None, too_large: DataFrame | None = None, span: int = SEGMENT) -> Normalised:
    """Numbered lines (source_path, line, value) of one tool -> flat tables. Every source path of `files` (of the lines, if none is given) gives a session.

    Lines become events, which are written once; all tables read them. files(source_path) holds empty, blank and oversized files too; too_large(source_path, code)
    is size_guard's second table. Ranges of `span` lines of a session are tasks of their own.
    """
    events = written(stepped(events_of(lines, tool), tool, span))
    every = turn_parts(events)
    turns = numbered_turns(every, span)
    blocks = placed_blocks(every, turns)
    flaws = F.array_compact(F.array(
        F.when((F.col("kind") == "tool_result") & ~F.col("matched"), F.struct(F.lit("unmatched_tool_result").alias("code"), "line")),
        F.when((F.col("kind") == "tool_result") & (F.length("output") > max_output_chars), F.struct(F.lit("truncated_tool_output").alias("code"), "line")),
        F.when(F.col("kind").isin("text", "thinking") & (F.length("text") > max_turn_chars), F.struct(F.lit("truncated_turn").alias("code"), F.col("source_line").alias("line"))),
    ))
    said = F.transform(F.concat(F.array_compact(F.array("problem")), "codes"), lambda c: F.struct(c.alias("code"), F.col("line").alias("line")))
    warn = lambda df, found: df.select("session_key", F.explode(found).alias("w")).select("session_key", "w.code", F.col("w.line").cast("int").alias("line"))
    warnings = warn(events, said).union(warn(blocks, flaws))
    unusable = events.where("tokens IS NOT NULL").groupBy("session_key").agg(F.bool_or("tokens").alias("usable")).where("NOT usable")
    warnings = warnings.union(unusable.select("session_key", F.lit("missing_token_usage"), F.lit(None).cast("int")))
    blocks = blocks.withColumns({"text": bounded(F.col("text"), max_turn_chars), "output": bounded(F.col("output"), max_output_chars)})
    tool_calls = blocks.where("kind = 'tool_use'").select("session_key", "turn_index", F.col("block_pos").alias("call_pos"), F.col("tool_use_id").alias("id"), "name", "input", "output", "status")
    if too_large is not None:
        warnings = warnings.union(too_large.select(F.col("source_path").alias("session_key"), "code", F.lit(None).cast("int").alias("line")))
    paths = [x.select("source_path") for x in (files, too_large) if x is not None]
    sessions = build_sessions(reduce(DataFrame.union, [events.select(F.col("session_key").alias("source_path")), *paths]), tool, events, every)
    return Normalised(sessions, turns.drop("tkey"), blocks.drop("line", "matched", "source_line"), tool_calls, warnings)


def merged_parts(every: DataFrame) -> DataFrame:
    """A1, A3: parts of one turn merged: its first line, and its first time that is not empty."""
    return every.groupBy("session_key", "tkey", "role").agg(
        F.min("line").alias("line"), F.min("seq").alias("seq"), F.max("late").alias("late"), F.min_by("ts", F.when(F.coalesce("ts", F.lit("")) != "", F.struct("line", "seq"))).alias("ts")
    )


def numbered_turns(every: DataFrame, span: int = SEGMENT) -> DataFrame:
    """every(session_key, tkey, role, line, seq, late, ts) -> session_key, tkey, turn_index, turn_id, role, timestamp, source_line.

    Both counts are prefix sums over ranges of lines, so a huge session is numbered by many tasks.
    """
    one = F.lit(1)
    turn = running(merged_parts(every), ["session_key"], {"n": (["line", "seq", "late", "tkey"], one), "place": (["line", "late", "seq", "tkey"], one)}, span)
    turn_id = F.when(F.col("late") == 1, F.col("tkey")).when(F.col("role") == "tool", F.regexp_replace("tkey", r"-\d+$", "")).otherwise(F.concat_ws("-", "role", F.col("line").cast("string"), F.col("n").cast("string")))
    return turn.select("session_key", "tkey", F.col("place").cast("int").alias("turn_index"), turn_id.alias("turn_id"), "role", F.col("ts").alias("timestamp"), F.col("line").alias("source_line"))


def answered(own: DataFrame) -> DataFrame:
    """Rows (session_key, tkey, line, seq, b: a block) with `answer` of calls (J1, J3) and `matched` of results.

    A call's answer is the last result that comes after the call's first line. Shuffled by call id, blocks without one by their turn.
    """
    b = F.col("b")
    is_call, is_result = b["kind"] == "tool_use", b["kind"] == "tool_result"
    call = Window.partitionBy("session_key", "call_key")
    own = own.withColumn("call_key", F.when((is_call | is_result) & b["tool_use_id"].isNotNull(), F.concat(F.lit("c"), b["tool_use_id"])).otherwise(F.concat(F.lit("t"), "tkey")))
    own = own.withColumn("_called", F.min(F.when(is_call, F.col("line"))).over(call))
    own = own.withColumn("matched", is_result & F.coalesce(F.col("_called") < F.col("line"), F.lit(False)))
    answer = F.max_by(F.struct(b["output"].alias("output"), b["status"].alias("status")), F.when(F.col("matched"), F.struct("line", "seq"))).over(call)
    return own.withColumn("answer", F.when(is_call, answer))


def placed_blocks(every: DataFrame, turns: DataFrame) -> DataFrame:
    """Blocks with their turn's index, their place in it, and calls with their answers (A2, J1-J3): shuffled by turn, then by call id, never by session alone."""
    b = F.col("b")
    own = every.select("session_key", "tkey", "line", "seq", "late", F.posexplode("blocks").alias("pos", "b"))
    same = F.when(F.col("late") == 1, F.coalesce(block_key(b), F.lit(""))).otherwise(F.col("pos").cast("string"))
    own = first_blocks(own.withColumn("bkey", same), ["session_key", "tkey"])
    place = F.row_number().over(Window.partitionBy("session_key", "tkey").orderBy("line", "pos")) - 1
    own = own.withColumn("block_pos", place.cast("int")).join(turns.select("session_key", "tkey", "turn_index", "source_line"), ["session_key", "tkey"])
    own = answered(own)
    is_call = b["kind"] == "tool_use"
    return own.select(
        "session_key", "turn_index", "b.kind", "b.text", "b.media_type", "b.bytes", "b.note", "b.tool_use_id", "b.name", "b.input",
        F.when(is_call, F.col("answer.output")).otherwise(b["output"]).alias("output"), F.coalesce("answer.status", "b.status").alias("status"), "block_pos", "line", "matched", "source_line",
    )


def bounds(every: DataFrame) -> DataFrame:
    """A10: turns, first and last time of each session, as texts. every has a row a part, with its turn in `tkey` and its time in `ts`."""
    ts = F.nullif(F.col("ts"), F.lit(""))
    return every.groupBy("session_key").agg(F.count_distinct("tkey").alias("turn_count"), F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"))


def build_sessions(paths: DataFrame, tool: str, events: DataFrame, every: DataFrame) -> DataFrame:
    s = paths.select(F.col("source_path").alias("session_key")).distinct()
    if tool == "codex":
        used = last_value(events, "total").select("session_key", F.col("total").alias("usage"), F.lit(1).cast("bigint").alias("groups"))
    else:
        used = session_usage(group_usage(records_of(events).where("role = 'assistant'")))
    model = last_value(events, "model") if tool == "gemini" else model_mode(events)
    last = events.groupBy("session_key").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line"))).alias(c) for c in ("cwd", "meta_id")))
    for part in (bounds(every), used, model, last):
        s = s.join(part, "session_key", "left")
    return session_rows(s, tool)


def session_rows(s: DataFrame, tool: str, *more: str) -> DataFrame:
    """session_key with what its events amount to -> session rows, and the columns named in more."""
    reports = {"claude-code": (1, 1, 1, 1, 0), "codex": (1, 1, 1, 0, 1), "gemini": (1, 1, 0, 0, 0)}[tool]
    seen = F.when(F.col("usage").isNotNull(), F.struct(*((F.lit(bool(r)) | (F.col("groups") > 1)).alias(c) for c, r in zip(("input", "output", "cache_read", "cache_write", "reasoning"), reports))))
    slug = F.element_at(F.split("session_key", "/"), -2)
    project = F.coalesce("cwd", project_from_slug(slug)) if tool == "claude-code" else F.col("cwd")
    version = "experimental" if tool == "gemini" else "unknown"
    return s.select(
        "session_key", F.coalesce("meta_id", session_id_from_path(F.col("session_key"))).alias("id"), F.lit(tool).alias("tool"), F.lit(ADAPTER_VERSIONS[tool]).alias("adapter_version"), F.lit(version).alias("log_format_version"),
        F.col("session_key").alias("source_path"), project.alias("project_path"), "model", "started_at", "ended_at", F.coalesce("turn_count", F.lit(0)).alias("turn_count"), F.lit(None).cast("double").alias("cost_usd"), "usage", seen.alias("observed"), *more,
    )


def nested(n: Normalised) -> DataFrame:
    """One row a session with its turns and their blocks, in order."""
    blocks = n.blocks.groupBy("session_key", "turn_index").agg(F.array_sort(F.collect_list(F.struct("block_pos", "kind", "text", "media_type", "bytes", "note", "tool_use_id", "name", "input", "output", "status"))).alias("content"))
    turns = n.turns.join(blocks, ["session_key", "turn_index"], "left").groupBy("session_key").agg(F.array_sort(F.collect_list(F.struct("turn_index", "turn_id", "role", "timestamp", "source_line", "content"))).alias("turns"))
    return n.sessions.join(turns, "session_key", "left")
