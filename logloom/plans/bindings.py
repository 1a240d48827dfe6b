"""Views of the driver's tables as sessions, turns, fragments and log lines: once in Spark, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.adapters import USAGE


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tool_of(n: Column) -> Column:
    return F.element_at(F.array(F.lit("claude-code"), F.lit("codex"), F.lit("gemini")), (F.pmod(n, F.lit(3)) + 1).cast("int"))


def project_of(n: Column) -> Column:
    return F.when(F.pmod(n, F.lit(11)) != 0, F.format_string("/Users/u%d/app%d", F.pmod(n, F.lit(7)), F.pmod(n, F.lit(5))))


#: Model by user: an exact id, a suffixed one, a dotted one, an unknown one, none.
MODELS = ("claude-sonnet-4-5", "gpt-4o-mini-2024-07-18", "gpt-5.4", "mystery-1", None)


def sessions_from_events(spark: SparkSession, sf: str) -> DataFrame:
    """A session is a user's day; tokens come from the events' values, by event type."""
    e = read(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.floor(F.col("value") * 100).cast("bigint").alias("tokens"), "value")
    cat = lambda t: F.sum(F.when(F.col("event_type") == t, F.col("tokens")))
    g = e.groupBy("user_id", "day").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("turn_count"), F.sum("tokens").alias("total"),
        cat("view").alias("i"), cat("click").alias("o"), cat("purchase").alias("cr"), cat("signup").alias("cw"), cat("error").alias("re"), F.round(F.sum("value"), 2).alias("logged"),
    )
    u = F.col("user_id")
    usage = F.when(F.pmod(u, F.lit(13)) != 0, F.struct(F.col("i").alias("input_tokens"), F.col("o").alias("output_tokens"), F.col("cr").alias("cache_read_tokens"), F.col("cw").alias("cache_write_tokens"), F.col("re").alias("reasoning_tokens"), F.when(F.pmod(u, F.lit(2)) == 0, F.col("total")).alias("total_tokens")).cast(USAGE))
    observed = F.struct(*(F.col(c).isNotNull().alias(n) for c, n in (("i", "input"), ("o", "output"), ("cr", "cache_read"), ("cw", "cache_write"), ("re", "reasoning"))))
    model = F.element_at(F.array(*(F.lit(m).cast("string") for m in MODELS)), (F.pmod(u, F.lit(len(MODELS))) + 1).cast("int"))
    return g.select(
        F.concat_ws(":", u.cast("string"), "day").alias("session_key"), F.concat(F.lit("s"), u.cast("string"), F.lit("-"), "day").alias("id"), tool_of(u).alias("tool"), F.lit("1").alias("adapter_version"), F.lit("unknown").alias("log_format_version"),
        F.concat(F.lit("/logs/"), u.cast("string"), F.lit(".jsonl")).alias("source_path"), project_of(u).alias("project_path"), model.alias("model"), "started_at", "ended_at", "turn_count",
        F.when(F.pmod(u, F.lit(4)) == 0, F.col("logged")).alias("cost_usd"), usage.alias("usage"), F.when(usage.isNotNull(), observed).alias("observed"), "user_id",
    )


EVENTS_SQL = """
ev AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(floor(value * 100) AS BIGINT) AS tokens, value FROM events),
eg AS (SELECT user_id, day, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS turn_count, CAST(sum(tokens) AS BIGINT) AS total,
  CAST(sum(CASE WHEN event_type = 'view' THEN tokens END) AS BIGINT) AS i, CAST(sum(CASE WHEN event_type = 'click' THEN tokens END) AS BIGINT) AS o,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN tokens END) AS BIGINT) AS cr, CAST(sum(CASE WHEN event_type = 'signup' THEN tokens END) AS BIGINT) AS cw,
  CAST(sum(CASE WHEN event_type = 'error' THEN tokens END) AS BIGINT) AS re, round(sum(value), 2) AS logged FROM ev GROUP BY user_id, day),
s AS (SELECT user_id || ':' || day AS session_key, 's' || user_id || '-' || day AS id, (['claude-code', 'codex', 'gemini'])[user_id % 3 + 1] AS tool,
  CASE WHEN user_id % 11 <> 0 THEN '/Users/u' || (user_id % 7) || '/app' || (user_id % 5) END AS project_path,
  (['claude-sonnet-4-5', 'gpt-4o-mini-2024-07-18', 'gpt-5.4', 'mystery-1', NULL])[user_id % 5 + 1] AS model, started_at, ended_at, turn_count,
  CASE WHEN user_id % 4 = 0 THEN logged END AS cost_usd, user_id % 13 <> 0 AS used, user_id,
  CASE WHEN user_id % 13 <> 0 THEN i END AS i, CASE WHEN user_id % 13 <> 0 THEN o END AS o, CASE WHEN user_id % 13 <> 0 THEN cr END AS cr,
  CASE WHEN user_id % 13 <> 0 THEN cw END AS cw, CASE WHEN user_id % 13 <> 0 THEN re END AS re, CASE WHEN user_id % 13 <> 0 AND user_id % 2 = 0 THEN total END AS total FROM eg),
f AS (SELECT session_key, tool, CASE WHEN project_path IS NULL THEN 'unknown' ELSE regexp_replace(project_path, '^/Users/[^/]+', '~') END AS project, substr(started_at, 1, 10) AS day, turn_count AS turns,
  coalesce(total, coalesce(i, 0) + coalesce(o, 0) + coalesce(cr, 0) + coalesce(cw, 0) + coalesce(re, 0)) AS tokens, * EXCLUDE (session_key, tool) FROM s)
"""


def blocks_from_conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("session_key"), F.col("turn").alias("turn_index"), F.lit(0).alias("block_pos"), "role", F.lit("text").alias("kind"), "text", F.lit(None).cast("string").alias("output"))


def sessions_from_conversations(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("session_key")).agg(F.count("*").alias("turn_count"))
    k = F.col("session_key")
    return c.select("session_key", tool_of(k).alias("tool"), project_of(k).alias("project_path"), F.format_string("2024-01-%02d", F.pmod(k, F.lit(28)) + 1).alias("started_at"), "turn_count")


CONV_SQL = """
cs AS (SELECT conv_id AS session_key, count(*) AS turn_count, (['claude-code', 'codex', 'gemini'])[conv_id % 3 + 1] AS tool,
  CASE WHEN conv_id % 11 <> 0 THEN '/Users/u' || (conv_id % 7) || '/app' || (conv_id % 5) END AS project_path, '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS started_at FROM conversations GROUP BY conv_id)
"""


def fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as message fragments: session, group, line, usage."""
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_shipdate", "l_linestatus")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    q = F.col("l_quantity").cast("bigint")
    use = F.struct(q.alias("input_tokens"), (q * 2).alias("output_tokens"), F.when(F.pmod("l_partkey", F.lit(3)) == 0, q).alias("cache_read_tokens"), F.lit(None).cast("bigint").alias("cache_write_tokens"), F.lit(None).cast("bigint").alias("reasoning_tokens"), (q * 3).alias("total_tokens"))
    return li.select(
        F.col("l_orderkey").alias("session_key"), F.pmod("l_suppkey", F.lit(3)).alias("grp"), F.row_number().over(w).alias("line"), F.lit(0).alias("seq"), use.cast(USAGE).alias("usage"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("ts"),
        F.concat(F.lit("m"), F.pmod("l_partkey", F.lit(4)).cast("string")).alias("model"), q.alias("weight"), F.pmod("l_partkey", F.lit(5)).alias("call_id"), (F.col("l_returnflag") == "R").alias("is_result"), F.col("l_linestatus").alias("output"),
    )


FRAG_SQL = """
fr AS (SELECT l_orderkey AS session_key, l_suppkey % 3 AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS line,
  CAST(l_quantity AS BIGINT) AS q, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_quantity AS BIGINT) END AS cr, strftime(l_shipdate, '%Y-%m-%d') AS ts, 'm' || (l_partkey % 4) AS model,
  l_partkey % 5 AS call_id, l_returnflag = 'R' AS is_result, l_linestatus AS output FROM lineitem)
"""


def raw_lines(spark: SparkSession, sf: str, tool: str) -> DataFrame:
    """Conversations rendered as numbered log lines of a tool; each session also gets one malformed and one wrong-shape line."""
    c = read(spark, sf, "conversations")
    path = F.concat(F.lit("/logs/-home-dev-app/c"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    ts = F.format_string("2024-01-01T00:%02d:00Z", F.pmod("turn", F.lit(60)))
    s = F.struct
    a = lambda *x: F.array(*x)
    lit = lambda v, n: F.lit(v).alias(n)
    if tool == "claude-code":
        text = a(s(lit("text", "type"), F.col("text").alias("text")))
        use = F.when(F.col("role") == "assistant", s(F.length("text").alias("input_tokens"), F.lit(7).alias("output_tokens")))
        row = s(F.col("role").alias("type"), ts.alias("timestamp"), lit("/home/dev/app", "cwd"), s(F.concat(F.lit("g"), F.col("turn").cast("string")).alias("id"), F.col("role").alias("role"), lit("claude-sonnet-4-5", "model"), text.alias("content"), use.alias("usage")).alias("message"))
    elif tool == "codex":
        kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
        row = s(lit("response_item", "type"), ts.alias("timestamp"), s(lit("message", "type"), F.col("role").alias("role"), a(s(kind.alias("type"), F.col("text").alias("text"))).alias("content")).alias("payload"))
    else:
        use = F.when(F.col("role") == "assistant", s(F.length("text").alias("promptTokenCount"), F.lit(7).alias("candidatesTokenCount"), (F.length("text") + 7).alias("totalTokenCount")))
        row = s(F.when(F.col("role") == "assistant", "model").otherwise(F.col("role")).alias("role"), ts.alias("timestamp"), lit("gemini-2.5-pro", "model"), a(s(F.col("text").alias("text"))).alias("parts"), use.alias("usageMetadata"))
    own = c.select(path.alias("source_path"), (F.col("turn") + 1).cast("int").alias("line"), F.to_json(row).alias("value"))
    bad = c.where("turn = 0").select(path.alias("source_path"), F.explode(F.array(s(F.lit(100001).alias("line"), F.lit('{"type": "user", ').alias("value")), s(F.lit(100002).alias("line"), F.lit('{"type": 5, "timestamp": 7, "role": 3}').alias("value")))).alias("x")).select("source_path", "x.line", "x.value")
    return own.unionByName(bad)
