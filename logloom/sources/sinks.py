"""Exports (K1-K11, R3, R6-R8, R12, W11): rows are rendered with built-ins and written by Spark, never gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..constants import TOOLS
from ..functions.display import money
from ..functions.privacy import anonymize_path, anonymize_paths_in_text, csv_cell, neutral_markdown, redact, redact_json


def sanitised(sessions: DataFrame, reasoning: bool = False, raw_paths: bool = False) -> DataFrame:
    """Nested sessions for export: thinking blocks stay only with `reasoning`, paths only with `raw_paths`."""
    out = sessions
    if not reasoning:
        out = out.withColumn("turns", F.transform("turns", lambda t: t.withField("content", F.filter(t["content"], lambda b: b["kind"] != "thinking"))))
    return out if raw_paths else out.withColumn("project_path", anonymize_path(F.col("project_path"))).drop("source_path", "session_key")


#: Text leaves that may hold JSON; they are redacted leaf by leaf, so that they stay JSON.
ISLANDS = ("input", "output")


def clean_leaves(c: Column, kind: DataType, clean: Callable[[Column], Column]) -> Column:
    """Every text leaf of a column, whatever its shape; map keys, numbers and the fields of ISLANDS stay."""
    if isinstance(kind, StringType):
        return clean(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: clean_leaves(x, kind.elementType, clean))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: clean_leaves(v, kind.valueType, clean))
    if isinstance(kind, StructType):
        parts = [(c[f.name] if f.name in ISLANDS else clean_leaves(c[f.name], f.dataType, clean)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c


def redacted(sessions: DataFrame, extra: tuple[str, ...] = (), raw_paths: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every text leaf of nested sessions: ids, names, models, notes and paths like texts; inputs and outputs of blocks leaf by leaf. Columns in `keep` stay.

    Home folders in texts, inputs and outputs are hidden too unless raw_paths.
    """
    clean = lambda c: redact(c, extra)
    said = clean if raw_paths else (lambda c: redact(anonymize_paths_in_text(c), extra))
    pick = lambda f: F.flatten(F.filter(F.transform("turns", lambda t: F.transform(t["content"], lambda b: b[f])), lambda x: x.isNotNull()))
    islands = sessions
    for f in ISLANDS:
        islands = islands.withColumn(f"_{f}", redact_json(pick(f), extra, paths=not raw_paths, lists=True))
    # the place of a turn's first block among all blocks of the session
    before = F.transform("turns", lambda t, k: F.aggregate(F.slice("turns", F.lit(1), k), F.lit(0), lambda n, u: n + F.coalesce(F.size(u["content"]), F.lit(0))))
    islands = islands.withColumn("_before", before)
    turn = sessions.schema["turns"].dataType.elementType
    content = turn["content"].dataType.elementType

    def block(at: Column):
        return lambda b, k: clean_leaves(b, content, clean).withField("text", said(b["text"])).withField("input", F.get("_input", at + k)).withField("output", F.get("_output", at + k))

    def whole(t: Column, k: Column) -> Column:
        parts = [F.transform(t["content"], block(F.get("_before", k))).alias("content") if f.name == "content" else clean_leaves(t[f.name], f.dataType, clean).alias(f.name) for f in turn.fields]
        return F.struct(*parts)

    head = [F.col(f.name) if f.name in keep else clean_leaves(F.col(f.name), f.dataType, clean).alias(f.name) for f in sessions.schema.fields if f.name != "turns"]
    return islands.select(*head, F.transform("turns", whole).alias("turns")).select(*sessions.columns)


def json_lines(records: DataFrame, generated_at: str, format_: str = "logloom.record.v1") -> DataFrame:
    return records.select(F.to_json(F.struct(F.lit(format_).alias("format"), F.lit(generated_at).alias("generated_at"), F.struct(*records.columns).alias("record"))).alias("value"))


def envelope(payload: DataFrame, name: str, generated_at: str) -> DataFrame:
    """One-row envelope of a report that is one row already."""
    return payload.select(F.lit(f"logloom.{name}.v1").alias("format"), F.lit(generated_at).alias("generated_at"), F.struct(*payload.columns).alias("payload"))


SESSIONS_HEADER = ("session_id", "tool", "project", "turns", "tokens", "cost")
SUMMARY_HEADER = ("date", "tool", "project", "turns", "tokens", "cost")


def sessions_csv(s: DataFrame, keep: tuple[str, ...] = ("session_key",)) -> DataFrame:
    u = F.col("usage")
    tokens = F.coalesce(u["total_tokens"], F.when(u.isNotNull(), F.coalesce(u["input_tokens"], F.lit(0)) + F.coalesce(u["output_tokens"], F.lit(0))))
    return csv_rows(s, ["id", "tool", "project_path", "turn_count", tokens, F.coalesce(F.col("cost_usd").cast("string"), F.lit("unknown"))], keep)


def summary_csv(s: DataFrame, keep: tuple[str, ...] = ("session_key",)) -> DataFrame:
    est = F.concat(money(F.col("estimated_cost"), True), F.lit(" est"))
    cost = F.coalesce(F.when(F.col("estimated_cost").isNotNull(), est), F.col("cost_usd").cast("string"), F.lit("unknown"))
    return csv_rows(s, ["started_at", "tool", "project_path", "turn_count", "total_tokens", cost], keep)


def csv_rows(s: DataFrame, cells: list[str | Column], keep: tuple[str, ...] = ("session_key",)) -> DataFrame:
    """One text line a row, cells guarded and quoted; write_csv adds the header of each file."""
    text = [csv_cell(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))) for c in cells]
    return s.select(*keep, F.concat_ws(",", *text).alias("value"))


def block_line(b: Callable[[str], Column], raw: bool = False) -> Column:
    """Markdown of a block whose fields b gives."""
    k = b("kind")
    return (
        F.when(k == "text", neutral_markdown(b("text"), raw)).when(k == "thinking", neutral_markdown(F.concat(F.lit("[thinking] "), b("text")), raw))
        .when(k == "image", F.concat(F.lit("[image: "), F.coalesce(b("note"), F.lit("omitted")), F.lit("]"))).when(k == "tool_use", F.concat(F.lit("[tool "), b("name"), F.lit("]")))
        .when(k == "tool_result", neutral_markdown(F.concat(F.lit("[tool result "), F.coalesce(b("status"), F.lit("success")), F.lit("] "), F.coalesce(b("output"), F.lit('""'))), raw)).otherwise("")
    )


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), F.upper(role), F.lit("\n\n"), body, F.lit("\n"))


def _head(s: Callable[[str], Column]) -> Column:
    return F.concat(F.lit("# Session "), s("id"), F.lit("\n\n- Tool: "), s("tool"), F.lit("\n- Project: "), F.coalesce(s("project_path"), F.lit("unknown")), F.lit("\n\n"))


def turn_markdown(blocks: DataFrame, raw: bool = False) -> DataFrame:
    """blocks(session_key, turn_index, block_pos, role, kind, text, ...) -> markdown of each turn."""
    parts = F.array_sort(F.collect_list(F.struct("block_pos", block_line(F.col, raw).alias("line"))))["line"]
    g = blocks.groupBy("session_key", "turn_index", "role").agg(F.array_join(parts, "\n\n").alias("body"))
    return g.select("session_key", "turn_index", _turn(F.col("role"), F.col("body")).alias("markdown"))


def session_markdown(sessions: DataFrame, turns_md: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn_index", "markdown")))["markdown"]
    body = turns_md.groupBy("session_key").agg(F.array_join(parts, "\n").alias("body"))
    return sessions.join(body, "session_key", "left").select("session_key", F.concat(_head(F.col), F.coalesce("body", F.lit(""))).alias("markdown"))


def write_text(rows: DataFrame, path: str, column: str = "value", force: bool = False) -> None:
    """No overwrite unless forced."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite" if force else "errorifexists").text(path)


def write_csv(rows: DataFrame, path: str, header: tuple[str, ...], force: bool = False) -> None:
    """Rows of one text column, already cells, with the header line in every part file, so that each part stands alone."""
    line = ",".join(header)
    rows.select(F.col("value").alias(line)).write.mode("overwrite" if force else "errorifexists").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("sep", "\x01").csv(path)


def tool_place(tool: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, TOOLS)), tool)
    return F.when(at > 0, at).otherwise(len(TOOLS) + 1)


def in_order(rows: DataFrame, tool: str = "tool", path: str = "source_path") -> DataFrame:
    """By tool in their fixed order, then by path; a range sort at the sink."""
    return rows.orderBy(tool_place(F.col(tool)), path)


def turn_records(sessions: DataFrame) -> DataFrame:
    """K8: one record a turn, with the head of its session."""
    head = [c for c in sessions.columns if c != "turns"]
    return sessions.select(F.struct(*head).alias("session"), F.explode("turns").alias("turn"))


def write_json_document(records: DataFrame, warnings: DataFrame, path: str, generated_at: str, granularity: str = "session", force: bool = False) -> None:
    """K2, K3: a folder in place of one document: records/ and warnings/ as partitioned JSON, manifest/ with one row, written last."""
    mode = "overwrite" if force else "errorifexists"
    records.write.mode(mode).json(f"{path}/records")
    warnings.write.mode(mode).json(f"{path}/warnings")
    n = records.sparkSession.read.text(f"{path}/records").count()
    manifest = records.sparkSession.createDataFrame([("logloom.export.v1", generated_at, granularity, n)], "format string, generated_at string, granularity string, records long")
    manifest.write.mode(mode).json(f"{path}/manifest")


ENVELOPE_ROWS = 10_000


def list_envelope(rows: DataFrame, name: str, payload: str, generated_at: str, warnings: DataFrame | None = None, limit: int = ENVELOPE_ROWS) -> DataFrame:
    """One document of a list, search, statistics or inventory result: format, generated_at, an array, warnings.

    One row can't be distributed, so a result of more than `limit` rows is refused: write it with write_json_document.
    """
    held = rows.limit(limit + 1)
    if held.count() > limit:
        raise ValueError(f"more than {limit} rows: use write_json_document")
    out = held.agg(F.collect_list(F.struct(*rows.columns)).alias(payload))
    if warnings is not None:
        out = out.join(F.broadcast(warnings.limit(limit).agg(F.collect_list(F.struct(*warnings.columns)).alias("warnings"))))
    return out.select(F.lit(f"logloom.{name}.v1").alias("format"), F.lit(generated_at).alias("generated_at"), payload, *(["warnings"] if warnings is not None else []))


FORMATS = ("jsonl", "json", "markdown", "csv", "summary-csv", "document")


def redacts(format_: str, asked: bool | None) -> bool:
    """Transcripts are redacted unless that is turned off, the summary only if that is asked for."""
    return format_ != "summary-csv" if asked is None else asked


def export(
    sessions: DataFrame, path: str, generated_at: str, redact_secrets: bool | None = None, reasoning: bool = False, raw_paths: bool = False, extra: tuple[str, ...] = (), force: bool = False,
    format_: str = "jsonl", granularity: str = "session", prices: DataFrame | None = None, warnings: DataFrame | None = None, raw_markdown: bool = False,
) -> None:
    """Estimate (with `prices`), sanitise, redact, write nested sessions in one of FORMATS, by session or by turn."""
    if format_ not in FORMATS or granularity not in ("session", "turn"):
        raise ValueError(f"unknown export {format_!r} by {granularity!r}")
    if prices is not None:
        from ..operators.pricing import with_estimate

        sessions = with_estimate(sessions, prices)
    if format_ in ("csv", "summary-csv"):
        clean = (lambda c: redact(c, extra)) if redacts(format_, redact_secrets) else (lambda c: c)
        s = in_order(sessions).withColumn("project_path", clean(F.col("project_path") if raw_paths else anonymize_path(F.col("project_path"))))
        if format_ == "csv":
            return write_csv(sessions_csv(s), path, SESSIONS_HEADER, force)
        from ..operators.stats import summary_tokens

        cost = F.col("estimate.cost_usd") if prices is not None else F.lit(None).cast("double")
        return write_csv(summary_csv(s.withColumns({"estimated_cost": cost, "total_tokens": summary_tokens(F.col("usage"))})), path, SUMMARY_HEADER, force)
    # the place in W11's order stays beside each row until it is written; it is the last thing that is sorted by
    out = sanitised(sessions.withColumn("_order", F.struct(tool_place(F.col("tool")).alias("tool"), F.col("source_path").alias("path"))), reasoning, raw_paths)
    if redacts(format_, redact_secrets):
        out = redacted(out, extra, raw_paths, ("_order",))
    if format_ == "markdown":
        rows = nested_markdown(out, granularity, raw_markdown, ("_order",)).withColumnRenamed("turn_index", "_turn")
        return write_text(rows.orderBy("_order", "_turn"), path, force=force)
    flat = out.select("_order", F.struct(*(c for c in out.columns if c != "_order")).alias("session"))
    if granularity == "turn":
        flat = flat.select("_order", F.posexplode("session.turns").alias("_turn", "turn"), F.col("session").dropFields("turns").alias("session"))
        records = flat.select("_order", "_turn", "session", "turn")
    else:
        records = flat.select("_order", F.lit(0).alias("_turn"), "session.*")
    named = [c for c in records.columns if c not in ("_order", "_turn")]
    none = out.sparkSession.createDataFrame([], "code string, line int")
    if format_ == "json":
        return write_json_document(records.orderBy("_order", "_turn").select(*named), none if warnings is None else warnings, path, generated_at, granularity, force)
    if format_ == "document":
        return write_whole_document(records, none if warnings is None else warnings, path, generated_at, granularity, force)
    rows = json_lines(records.orderBy("_order", "_turn").select(*named), generated_at)
    write_text(rows, path, force=force)


def write_whole_document(records: DataFrame, warnings: DataFrame, path: str, generated_at: str, granularity: str = "session", force: bool = False) -> None:
    """K2, K3: one JSON document, written in parallel as text parts: in the order of their names they are the document, records in W11's order, warnings last.

    records(_order, _turn, ...). Nothing but the smallest place passes one task.
    """
    named = [c for c in records.columns if c not in ("_order", "_turn")]
    placed = records.select(F.struct("_order", "_turn").alias("at"), F.to_json(F.struct(*named)).alias("json"))
    first = F.broadcast(placed.agg(F.min("at").alias("first")))
    comma = lambda c, is_first: F.concat(F.when(is_first, "").otherwise(","), c)
    kind = records.select(F.struct("_order", "_turn").alias("at")).schema["at"].dataType.simpleString()
    said = warnings.select(F.to_json(F.struct(*warnings.columns)).alias("json"))
    least = F.broadcast(said.agg(F.min("json").alias("first"), F.count("*").alias("n")))
    # of equal first warnings one goes without its comma: they are numbered, the others stay as they are
    lead = said.join(least, said["json"] == least["first"]).select("json").groupBy("json").agg(F.count("*").alias("n"))
    leads = lead.select(F.lit(3).alias("part"), F.lit(None).cast(kind).alias("at"), F.array_join(F.array_repeat("json", F.col("n").cast("int")), ",").alias("value"))
    rest = said.join(least, said["json"] != least["first"]).select(F.lit(4).alias("part"), F.lit(None).cast(kind).alias("at"), F.concat(F.lit(","), "json").alias("value"))
    head = f'{{"format":"logloom.export.v1","generated_at":"{generated_at}","granularity":"{granularity}","records":['
    spark = records.sparkSession
    frame = spark.createDataFrame([(0, head), (2, '],"warnings":['), (5, "]}")], "part int, value string").select("part", F.lit(None).cast(kind).alias("at"), "value")
    body = placed.join(first).select(F.lit(1).alias("part"), "at", comma(F.col("json"), F.col("at") == F.col("first")).alias("value"))
    write_text(frame.unionByName(body).unionByName(leads).unionByName(rest).orderBy("part", "at", "value"), path, force=force)


def nested_markdown(sessions: DataFrame, granularity: str = "session", raw: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """K4, K5: markdown (`value`) of nested sessions, one row a session or a turn, with turn_index (-1 for a session) and the columns of `keep`. No shuffle: a session's turns are in its row."""
    body = lambda t: F.array_join(F.transform(F.coalesce(t["content"], F.array().cast(t_content)), lambda b: block_line(lambda n: b[n], raw)), "\n\n")
    t_content = sessions.schema["turns"].dataType.elementType["content"].dataType
    text = lambda t: _turn(t["role"], body(t))
    if granularity == "turn":
        turns = sessions.select(*keep, "id", F.explode("turns").alias("t"))
        title = F.concat(F.lit("# "), "id", F.lit(" / turn "), F.col("t.turn_index").cast("string"), F.lit("\n\n"))
        return turns.select(*keep, F.col("t.turn_index").alias("turn_index"), F.concat(title, text(F.col("t"))).alias("value"))
    whole = F.concat(_head(F.col), F.coalesce(F.array_join(F.transform("turns", text), "\n"), F.lit("")))
    return sessions.select(*keep, F.lit(-1).alias("turn_index"), whole.alias("value"))
