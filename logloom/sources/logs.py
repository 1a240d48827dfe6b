"""Scans of agent logs (S1-S18): files, numbered lines, quarantine, tool inference and inventory."""

from __future__ import annotations



from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DEFAULT_TOOL, INVENTORY_LIMIT, MAX_FILE_BYTES, TOOL_A_LINE_TYPES, TOOL_B_LINE_TYPES, TOOLS

# --- fixed values: adapter versions and capabilities -------------------------------------------
ADAPTER_VERSIONS = {"claude-code": "0.1.1", "codex": "0.1.1", "gemini": "0.1.1-experimental"}
CAPABILITIES = {
    "claude-code": {"discovery": "full", "transcript": "full", "tool_calls": "full", "usage": "full", "model": "partial", "reasoning": "full"},
    "codex": {"discovery": "full", "transcript": "partial", "tool_calls": "full", "usage": "full", "model": "partial", "reasoning": "partial"},
    "gemini": {"discovery": "experimental", "transcript": "partial", "tool_calls": "partial", "usage": "partial", "model": "partial", "reasoning": "none"},
}
DEFAULT_ROOTS = {"claude-code": ".claude/projects", "codex": ".codex", "gemini": ".gemini/tmp"}
# --- end of fixed values -------------------------------------------------------------------------


def default_roots(home: str) -> dict[str, str]:
    """The tools' usual roots under a home folder, for `scan`."""
    return {tool: f"{home.rstrip('/')}/{tail}" for tool, tail in DEFAULT_ROOTS.items()}


def reachable(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """tool, root, accessible: whether the root's file system answers and holds it. One row a tool, on the driver."""
    rows = []
    for tool, root in roots.items():
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            rows.append((tool, root, bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))))
        except Exception:  # an unknown or refused file system
            rows.append((tool, root, False))
    return spark.createDataFrame(rows, "tool string, root string, accessible boolean")


def capabilities(spark: SparkSession) -> DataFrame:
    """What each tool's adapter can read; joins to `inventory` by tool."""
    names = [*CAPABILITIES["codex"]]
    return spark.createDataFrame([(tool, *(c[n] for n in names)) for tool, c in CAPABILITIES.items()], ", ".join(["tool string", *(f"{n} string" for n in names)]))


def _paths(tool: str, root: str) -> str:
    tails = {"claude-code": "/{*,*/*}.jsonl", "codex": "", "gemini": "/*/chats/session-*.jsonl"}
    if tool not in tails:
        raise ValueError(f"unknown tool {tool!r}")
    return root.rstrip("/") + tails[tool]


def _reader(spark: SparkSession, tool: str, kind: str) -> DataFrameReader:
    read = spark.read.format(kind)
    return read.option("recursiveFileLookup", True).option("pathGlobFilter", "rollout-*.jsonl") if tool == "codex" else read


def file_table(spark: SparkSession, tool: str, root: str) -> DataFrame:
    """Every file of one tool's root by the driver's file index, since scans skip empty files: tool, source_path (local ones spelt as _metadata spells them)."""
    found = _reader(spark, tool, "text").load(_paths(tool, root)).inputFiles()
    return spark.createDataFrame([(tool, path.replace("file:///", "file:/", 1)) for path in found], "tool string, source_path string")


def log_files(spark: SparkSession, tool: str, root: str) -> DataFrame:
    """Raw lines of one tool's root: value, source_path, file_size, block_start. A missing root raises AnalysisException."""
    raw = _reader(spark, tool, "text").load(_paths(tool, root))
    m = F.col("_metadata")
    return raw.select(F.lit(tool).alias("tool"), "value", m["file_path"].alias("source_path"), m["file_size"].alias("file_size"), m["file_block_start"].alias("block_start"))


def scan(spark: SparkSession, roots: dict[str, str], tools: list[str] | None = None) -> tuple[DataFrame | None, list[dict]]:
    """Union of the chosen tools' files; a root that can't be read becomes a warning."""
    parts, warnings = [], []
    for tool in TOOLS:
        if tool in roots and (not tools or tool in tools):
            try:
                parts.append(log_files(spark, tool, roots[tool]))
            except Exception as error:  # a missing or unreadable root must not stop the others
                warnings.append({"code": "source_unavailable", "message": f"{tool}: {type(error).__name__}", "severity": "warning", "scope": "source", "source_path": roots[tool]})
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out, warnings


def within_path_dates(raw: DataFrame, since: str | None, until: str | None, path: str = "source_path", exact: bool = False) -> DataFrame:
    """Keeps files whose /sessions/YYYY/MM/DD/ lies between two days (text YYYY-MM-DD); undated paths stay.

    exact: bounds are ISO times, compared with the folder's midnight in UTC, so a bound later that day leaves the folder out.
    """
    if exact:
        at = F.try_to_timestamp(F.concat(F.regexp_replace(F.regexp_extract(path, r"/sessions/(\d{4}/\d{2}/\d{2})/", 1), "/", "-"), F.lit(" 00:00:00+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
        for bound, keep in ((since, lambda b: at >= b), (until, lambda b: at <= b)):
            if bound:
                raw = raw.where(at.isNull() | keep(F.to_timestamp(F.lit(bound))))
        return raw
    day = F.regexp_replace(F.regexp_extract(path, r"/sessions/(\d{4}/\d{2}/\d{2})/", 1), "/", "-")
    if since:
        raw = raw.where((day == "") | (day >= since))
    return raw.where((day == "") | (day <= until)) if until else raw


def numbered(raw: DataFrame) -> DataFrame:
    """1-based line numbers that count blank lines; blank lines are dropped afterwards.

    Lines are counted by split, the counts are summed over a file's splits, and a line's number is its place in its split after what came before: no file passes
    one task, and lines are not shuffled. raw must be a scan (its rows keep their places when it is read again), with block_start rising along each file.
    """
    seen = raw.withColumn("seen", F.monotonically_increasing_id())
    splits = seen.groupBy("source_path", "block_start").agg(F.count("*").alias("lines"), F.min("seen").alias("first"))
    earlier = Window.partitionBy("source_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("source_path", "block_start", "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    n = seen.join(before, ["source_path", "block_start"]).withColumn("line", (F.col("before") + F.col("seen") - F.col("first") + 1).cast("int"))
    return n.where(F.col("value").rlike(r"\S")).drop("seen", "block_start", "first", "before")


def size_guard(raw: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lines of files within the bound or of unknown size, one warning row for each larger file)."""
    fits = F.coalesce(F.col("file_size") <= max_bytes, F.lit(True))
    big = raw.where(~fits).select("source_path").distinct()
    return raw.where(fits), big.select("source_path", F.lit("file_too_large").alias("code"))


def typed(path: str, kind: str = "STRING") -> Column:
    """True if the JSON value at the path is missing or of the kind; `v` holds the variant."""
    return F.expr(f"coalesce(schema_of_variant(variant_get(v, '{path}')), '{kind}') = '{kind}'")


#: Line checks of each tool: paths whose value must be text if present.
TEXT_PATHS = {
    "claude-code": ("$.type", "$.timestamp", "$.cwd", "$.sessionId", "$.model"),
    "codex": ("$.type", "$.timestamp"),
    "gemini": ("$.role", "$.timestamp", "$.model", "$.modelVersion"),
}


#: Paths whose value must be a number, an object, an array of objects, or text or an array, if present.
SHAPES = {
    "claude-code": {
        "text": ("$.message.id", "$.message.role", "$.message.model"), "object": ("$.message", "$.message.usage"), "content": ("$.message.content",),
        "number": ("$.message.usage.input_tokens", "$.message.usage.output_tokens", "$.message.usage.cache_read_input_tokens", "$.message.usage.cache_creation_input_tokens"),
    },
    "codex": {"object": ("$.payload",), "required": ("$.type",)},
    "gemini": {"object": ("$.usageMetadata",), "objects": ("$.parts",), "number": ("$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount", "$.usageMetadata.totalTokenCount")},
}
_MATCH = {
    "text": "= 'STRING'", "object": "LIKE 'OBJECT%'", "objects": "RLIKE '^ARRAY<(OBJECT.*|VOID)>$'", "content": "RLIKE '^(STRING|ARRAY.*)$'",
    "number": "RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$'", "required": "= 'STRING'",
}


def shaped(tool: str) -> Column:
    """True if every value below the top level that is present has its shape."""
    fine = F.lit(True)
    for kind, paths in SHAPES[tool].items():
        for p in paths:
            fine = fine & F.expr(f"coalesce(schema_of_variant(variant_get(v, '{p}')) {_MATCH[kind]}, {'false' if kind == 'required' else 'true'})")
    return fine


def checked(lines: DataFrame, tool: str) -> DataFrame:
    """lines with `problem`: null, malformed_line or invalid_line_shape."""
    v = lines.withColumn("v", F.expr("try_parse_json(value)"))
    fine = typed(TEXT_PATHS[tool][0])
    for p in TEXT_PATHS[tool][1:]:
        fine = fine & typed(p)
    shape = F.expr("schema_of_variant(v) LIKE 'OBJECT%'") & fine & shaped(tool)
    return v.withColumn("problem", F.when(F.col("v").isNull(), "malformed_line").when(~F.coalesce(shape, F.lit(False)), "invalid_line_shape")).drop("v")


def infer_from_path(path: Column) -> Column:
    p = F.translate(path, "\\", "/")
    base = F.element_at(F.split(p, "/"), -1)
    return (
        F.when(p.contains("/.codex/sessions/") | (base.startswith("rollout-") & base.endswith(".jsonl")), "codex")
        .when(p.contains("/.gemini/") & p.contains("/chats/") & base.startswith("session-"), "gemini")
        .when(p.contains("/.claude/projects/"), "claude-code")
    )


def sniff(line: Column) -> Column:
    """Tool of a file from its first line that is not blank."""
    has = lambda k: F.array_contains(F.json_object_keys(line), k)
    kind, role = F.get_json_object(line, "$.type"), F.get_json_object(line, "$.role")
    return F.when(has("payload") & kind.isin(*TOOL_B_LINE_TYPES), "codex").when(has("message") & kind.isin(*TOOL_A_LINE_TYPES), "claude-code").when(has("parts") & role.isNotNull(), "gemini")


def resolve_tool(explicit: Column, path: Column, line: Column) -> tuple[Column, Column]:
    """(tool: explicit, else by path, else by line, else the default; whether an explicit one disagrees)."""
    guessed = F.coalesce(infer_from_path(path), sniff(line))
    return F.coalesce(explicit, guessed, F.lit(DEFAULT_TOOL)), F.coalesce(explicit != guessed, F.lit(False))


def inventory(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """files(tool, source_path) -> a row a tool: candidate files (capped count), detected, status, adapter version.

    roots: `reachable`'s rows. A tool whose root can't be reached, or that has neither a root nor files, is not detected; one whose root holds no log has no files.
    """
    every = files.sparkSession.createDataFrame(list(ADAPTER_VERSIONS.items()), "tool STRING, adapter_version STRING")
    n = files.where(F.col("source_path").isNotNull()).select("tool", "source_path").distinct().groupBy("tool").agg(F.count("*").alias("n"))
    every = every.join(n, "tool", "left")
    if roots is not None:
        every = every.join(roots.select("tool", "accessible"), "tool", "left")
    found = F.coalesce("n", F.lit(0))
    open_ = found > 0 if roots is None else F.coalesce("accessible", F.lit(False))
    status = F.when(~open_, "not detected").when(found == 0, "no files").otherwise("ok")
    count = F.when(open_, F.least(found, F.lit(INVENTORY_LIMIT))).otherwise(F.lit(0)).cast("bigint")
    return every.select("tool", "adapter_version", count.alias("candidates"), (open_ & (found > 0)).alias("detected"), status.alias("status"))


def project_from_slug(slug: Column) -> Column:
    rest = F.translate(F.substring(slug, 2, 1 << 30), "-", "/")
    return F.when(slug.startswith("-"), F.concat(F.lit("/"), rest, F.when(rest.contains("/"), "").otherwise("/"))).otherwise(slug)


def session_id_from_path(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl$", "")


