"""Conversations as log lines that hold every kind of record and block, good and bad, with the SQL of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import read

SECRET = "x; TOKEN=abc"
STAMP = "'2024-01-01T00:' || lpad(CAST(turn % 60 AS VARCHAR), 2, '0') || ':00Z'"
PATH = "'/logs/-home-dev-app/c' || conv_id || '.jsonl'"


def _lines(spark: SparkSession, sf: str, rows) -> DataFrame:
    """rows: (condition, place after 10 * turn, line as a struct, columns that are null are left out of it)."""
    path = F.concat(F.lit("/logs/-home-dev-app/c"), F.col("conv_id").cast("string"), F.lit(".jsonl"))
    each = F.array_compact(F.array(*(F.when(c, F.struct((F.col("turn") * 10 + k).cast("int").alias("line"), F.to_json(v).alias("value"))) for c, k, v in rows)))
    return read(spark, sf, "conversations").select(path.alias("source_path"), F.explode(each).alias("x")).select("source_path", "x.*")


def _s(**fields) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))


def _id(head: str, n: Column) -> Column:
    return F.concat(F.lit(head), n.cast("string"))


def _stamp() -> Column:
    return F.format_string("2024-01-01T00:%02d:00Z", F.pmod("turn", F.lit(60)))


def tool_a_lines(spark: SparkSession, sf: str) -> DataFrame:
    """User lines with text, image, a block without its text and a result; assistant messages in two fragments; ignored lines."""
    t, text, ts = F.col("turn"), F.col("text"), _stamp()
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    none = F.lit(None).cast("string")

    def item(kind: str, **f) -> Column:
        own = {n: f.get(n, none) for n in ("text", "thinking", "id", "name", "tool_use_id", "content")}
        call, image = f.get("input"), f.get("data")
        return _s(
            type=kind, **own, is_error=f.get("is_error", F.lit(None).cast("boolean")), input=F.when(F.lit(call is not None), _s(n=t, cmd=SECRET)),
            source=F.when(F.lit(image is not None), _s(media_type="image/png", data=none if image is None else image)),
        )

    said = F.array(item("text", text=text), item("image", data=F.left(text, F.lit(40))), item("text"), item("tool_result", tool_use_id=_id("k", t - 1), content=F.concat(F.lit("out "), text), is_error=t % 4 == 0))
    first = F.array(item("thinking", thinking=F.concat(F.lit("hm "), F.left(text, F.lit(20)))), item("text", text=text))
    second = F.array(item("text", text=text), item("tool_use", id=_id("k", t), name=F.lit("run"), input=True), item("tool_use", id=_id("bad", t)))
    cwd = F.when(t % 3 == 0, "").otherwise(_id("/home/dev/app", t % 3))
    use = lambda n: _s(input_tokens=F.length("text"), output_tokens=n)
    message = lambda content, u: _s(id=_id("g", t), role="assistant", model="claude-sonnet-4-5", content=content, usage=u)
    return _lines(spark, sf, [
        (user, 1, _s(type="user", timestamp=ts, cwd=cwd, message=_s(role="user", content=said))),
        (assistant, 1, _s(type="assistant", timestamp=ts, cwd=cwd, message=message(first, use(1)))),
        (assistant, 2, _s(type="assistant", timestamp=ts, message=message(second, use(7)))),
        (F.col("role") == "system", 1, _s(type="system", timestamp=ts, cwd=cwd)),
        (F.lit(True), 9, _s(type="attachment", timestamp="2030-01-01T00:00:00Z", cwd="/ignored")),
    ])


#: a(session_key, conv_id, line, sub, role, turn, text, turn_index): turns of tool_a_lines; x: the user's text after a call.
A_SQL = f"""
a AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY line, sub) - 1 AS INTEGER) AS turn_index FROM (
  SELECT {PATH} AS session_key, conv_id, turn * 10 + 1 AS line, sub, CASE sub WHEN 1 THEN 'tool' ELSE role END AS role, turn, text
  FROM conversations, (VALUES (0), (1)) v(sub) WHERE role = 'user' OR (role = 'assistant' AND sub = 0))),
x AS (SELECT conv_id, turn - 1 AS turn, text, turn % 4 = 0 AS failed FROM conversations WHERE role = 'user'),
ab AS (
  SELECT session_key, conv_id, turn, turn_index, 0 AS block_pos, 'text' AS kind, text, NULL AS media_type, NULL AS bytes, NULL AS tool_use_id, NULL AS name, NULL AS input, NULL AS output, NULL AS status FROM a WHERE role = 'user'
  UNION ALL SELECT session_key, conv_id, turn, turn_index, 1, 'image', NULL, 'image/png', length(left(text, 40)), NULL, NULL, NULL, NULL, NULL FROM a WHERE role = 'user'
  UNION ALL SELECT session_key, conv_id, turn, turn_index, 0, 'tool_result', NULL, NULL, NULL, 'k' || (turn - 1), NULL, NULL, 'out ' || text, CASE WHEN turn % 4 = 0 THEN 'error' ELSE 'success' END FROM a WHERE role = 'tool'
  UNION ALL SELECT session_key, conv_id, turn, turn_index, 0, 'thinking', 'hm ' || left(text, 20), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM a WHERE role = 'assistant'
  UNION ALL SELECT session_key, conv_id, turn, turn_index, 1, 'text', text, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM a WHERE role = 'assistant'
  UNION ALL SELECT session_key, a.conv_id, a.turn, turn_index, 2, 'tool_use', NULL, NULL, NULL, 'k' || a.turn, 'run', '{{"n":' || a.turn || ',"cmd":"{SECRET}"}}', 'out ' || x.text, CASE WHEN failed THEN 'error' WHEN NOT failed THEN 'success' END
    FROM a LEFT JOIN x ON a.conv_id = x.conv_id AND a.turn = x.turn WHERE role = 'assistant')
"""


def tool_b_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Meta, messages, reasoning (open and encrypted), calls by either id, their output, web searches and token events."""
    t, text, ts = F.col("turn"), F.col("text"), _stamp()
    assistant, open_ = F.col("role") == "assistant", t % 4 != 1
    item = lambda payload: _s(type="response_item", timestamp=ts, payload=payload)
    kind = F.when(F.col("role") == "assistant", "output_text").otherwise("input_text")
    call = _id("k", t)
    tokens = lambda info: _s(type="event_msg", timestamp=ts, payload=_s(type="token_count", info=info))
    total = F.when(F.col("conv_id") % 2 == 1, _s(total_token_usage=_s(input_tokens=t, output_tokens=t + 1, total_tokens=t * 2 + 1)))
    return _lines(spark, sf, [
        (t == 0, 1, _s(type="session_meta", timestamp=ts, payload=_s(id=_id("m", F.col("conv_id")), cwd=_id("/w/p", F.col("conv_id") % 3)))),
        (t == 0, 2, _s(type="turn_context", timestamp=ts, payload=_s(model="gpt-5.4"))),
        (F.lit(True), 3, item(_s(type="message", role=F.col("role"), content=F.array(_s(type=kind, text=text))))),
        (assistant & open_, 4, item(_s(type="reasoning", summary=F.concat(F.lit("think "), F.left(text, F.lit(10)))))),
        (assistant & ~open_, 4, item(_s(type="reasoning", encrypted_content="x"))),
        (assistant, 5, item(_s(type="function_call", call_id=F.when(open_, call), id=F.when(~open_, call), name="run", arguments='{"n":1}'))),
        (assistant, 6, item(_s(type="function_call_output", call_id=call, output=F.left(text, F.lit(30)), is_error=t % 3 == 0))),
        (assistant, 7, item(_s(type="web_search_call"))),
        (assistant, 8, tokens(total)),
    ])


#: bb: one row a turn of tool_b_lines, each of one block.
B_SQL = f"""
k AS (SELECT *, {PATH} AS session_key, CASE WHEN turn % 3 = 0 THEN 'error' ELSE 'success' END AS ended FROM conversations),
bb AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_key ORDER BY line) - 1 AS INTEGER) AS turn_index FROM (
  SELECT session_key, turn * 10 + 3 AS line, role, 'text' AS kind, text, NULL AS tool_use_id, NULL AS name, NULL AS input, NULL AS output, NULL AS status FROM k WHERE role IN ('user', 'assistant') AND text <> ''
  UNION ALL SELECT session_key, turn * 10 + 4, role, 'thinking', 'think ' || left(text, 10), NULL, NULL, NULL, NULL, NULL FROM k WHERE role = 'assistant' AND turn % 4 <> 1
  UNION ALL SELECT session_key, turn * 10 + 5, role, 'tool_use', NULL, 'k' || turn, 'run', '{{"n":1}}', left(text, 30), ended FROM k WHERE role = 'assistant'
  UNION ALL SELECT session_key, turn * 10 + 6, 'tool', 'tool_result', NULL, 'k' || turn, NULL, NULL, left(text, 30), ended FROM k WHERE role = 'assistant'
  UNION ALL SELECT session_key, turn * 10 + 7, role, 'tool_use', NULL, 'web-' || (turn * 10 + 7), 'web_search', '{{"type":"web_search_call"}}', NULL, NULL FROM k WHERE role = 'assistant'))
"""


def tool_c_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Model lines with text and a call, user lines with a response and text."""
    t, text = F.col("turn"), F.col("text")
    none = F.lit(None).cast("string")
    part = lambda text=none, call=False, response=False: _s(
        text=text, functionCall=F.when(F.lit(call), _s(id=_id("k", t), name="run", args=_s(n=t))), functionResponse=F.when(F.lit(response), _s(id=_id("k", t - 1), name="run", response=_s(r=t)))
    )
    line = lambda role, *parts: _s(role=role, timestamp=_stamp(), model="gemini-2.5-pro", parts=F.array(*parts))
    return _lines(spark, sf, [(F.col("role") == "assistant", 1, line("model", part(text), part(call=True))), (F.col("role") == "user", 1, line("user", part(response=True), part(text)))])


C_SQL = f"""
a AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, sub) - 1 AS INTEGER) AS turn_index FROM (
  SELECT {PATH} AS session_key, conv_id, sub, CASE sub WHEN 0 THEN 'tool' ELSE role END AS role, turn, text
  FROM conversations, (VALUES (0), (1)) v(sub) WHERE role = 'user' OR (role = 'assistant' AND sub = 1))),
x AS (SELECT conv_id, turn - 1 AS turn, '{{"r":' || turn || '}}' AS output FROM conversations WHERE role = 'user')
"""
