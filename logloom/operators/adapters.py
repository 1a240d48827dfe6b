"""Per-tool line mapping (N1-N17): each checked line becomes one event row, by one projection and without a shuffle.

Events: session_key, line, problem, record (or null), emits (steps that the line adds to its file's count), results (array), cwd, meta_id, model, weight,
total (usage so far, or null), tokens (null unless a token event; whether it is usable), codes (warnings of the line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IGNORED_LINE_TYPES
from ..functions.predicates import model_id

BLOCK = "struct<kind:string,text:string,media_type:string,bytes:bigint,note:string,tool_use_id:string,name:string,input:string,output:string,status:string>"
USAGE = "struct<input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,cache_write_tokens:bigint,reasoning_tokens:bigint,total_tokens:bigint>"
#: step: null, or the place among the line's steps that is added to the file's count and to the group's name.
RECORD = f"struct<seq:int,role:string,grp:string,step:int,ts:string,usage:{USAGE},blocks:array<{BLOCK}>>"
RESULT = "struct<seq:int,call_id:string,output:string,is_error:boolean>"
IMAGE_NOTE = "image data omitted"


def block(**fields: Column | str) -> Column:
    names = [x.split(":")[0] for x in BLOCK[len("struct<") : -1].split(",")]
    return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(n) if (v := fields.get(n)) is not None else F.lit(None).alias(n) for n in names)).cast(BLOCK)


def usage(**fields: Column) -> Column:
    names = [x.split(":")[0] for x in USAGE[len("struct<") : -1].split(",")]
    return F.struct(*((fields[n].cast("bigint") if n in fields else F.lit(None).cast("bigint")).alias(n) for n in names))


def record(role: Column, grp: Column, blocks: Column, ts: Column, use: Column | None = None, step: Column | None = None, seq: int = 0) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(seq).alias("seq"), role.alias("role"), grp.alias("grp"), (none if step is None else step).alias("step"), ts.alias("ts"), (none if use is None else use).alias("usage"), blocks.alias("blocks")).cast(RECORD)


def event(p: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"record": RECORD, "emits": "int", "results": f"array<{RESULT}>", "cwd": "string", "meta_id": "string", "model": "string", "weight": "bigint", "total": USAGE, "tokens": "boolean", "codes": "array<string>"}
    empty = {"emits": F.lit(0), "results": F.array(), "codes": F.array(), "weight": F.lit(1)}
    return p.select("session_key", "line", "problem", *(F.coalesce(columns.get(n, empty.get(n, F.lit(None))), empty.get(n, F.lit(None))).cast(k).alias(n) for n, k in kinds.items()))


def _kind(path: str) -> Column:
    return F.expr(f"schema_of_variant(variant_get(try_parse_json(value), '{path}'))")


def tool_a(read: DataFrame) -> DataFrame:
    item = "struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,source:struct<media_type:string,data:string>>"
    shape = "type string, timestamp string, cwd string, model string, message struct<id:string,role:string,model:string,content:string,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>"
    p = read.select("session_key", "line", "problem", F.when(F.col("problem").isNull(), F.from_json("value", shape)).alias("j"), F.get_json_object("value", "$.message.content").alias("content"), _kind("$.message.content").alias("kind"))
    p = p.withColumn("j", F.when(F.col("j.type").isNotNull() & ~F.col("j.type").isin(*IGNORED_LINE_TYPES), F.col("j")))
    whole = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))), item))
    p = p.withColumn("items", F.when(F.col("j.message").isNotNull(), F.when(F.col("kind") == "STRING", whole).otherwise(F.from_json("content", f"array<{item}>"))))

    def shown(i: Column) -> Column:
        return (
            F.when((i["type"] == "text") & i["text"].isNotNull(), block(kind="text", text=i["text"]))
            .when((i["type"] == "thinking") & i["thinking"].isNotNull(), block(kind="thinking", text=i["thinking"]))
            .when((i["type"] == "tool_use") & i["id"].isNotNull() & i["name"].isNotNull(), block(kind="tool_use", tool_use_id=i["id"], name=i["name"], input=i["input"]))
            .when((i["type"] == "image"), block(kind="image", media_type=i["source"]["media_type"], bytes=F.length(i["source"]["data"]), note=IMAGE_NOTE))
        )

    j, u = F.col("j"), F.col("j.message.usage")
    by_user, by_model = F.coalesce(j["type"] == "user", F.lit(False)), F.coalesce(j["type"] == "assistant", F.lit(False))
    total = sum((F.coalesce(u[c], F.lit(0)) for c in ("output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")), F.coalesce(u["input_tokens"], F.lit(0)))
    use = F.when(by_model & u.isNotNull(), usage(input_tokens=u["input_tokens"], output_tokens=u["output_tokens"], cache_read_tokens=u["cache_read_input_tokens"], cache_write_tokens=u["cache_creation_input_tokens"], total_tokens=total))
    group = F.when(by_model, F.coalesce(j["message"]["id"], F.concat(F.lit("line-"), F.col("line").cast("string"))))
    said = F.filter("items", lambda i: (by_user & i["type"].isin("text", "image")) | (by_model & i["type"].isin("text", "thinking", "tool_use")))
    p = p.withColumn("blocks", F.coalesce(F.array_compact(F.transform(said, shown)), F.array().cast(f"array<{BLOCK}>")))
    made = F.when(j["message"].isNotNull() & (by_model | (by_user & (F.size("blocks") > 0))), record(j["type"], group, F.col("blocks"), j["timestamp"], use))
    answer = lambda i, k: F.when((i["type"] == "tool_result") & i["tool_use_id"].isNotNull(), F.struct((k + 1).alias("seq"), i["tool_use_id"].alias("call_id"), i["content"].alias("output"), F.coalesce(i["is_error"], F.lit(False)).alias("is_error")))
    return event(
        p, record=made, results=F.when(by_user, F.array_compact(F.transform("items", answer))), cwd=F.nullif(j["cwd"], F.lit("")), model=F.when(by_model, F.coalesce(j["message"]["model"], j["model"])), weight=F.when(total > 0, total),
    )


def tool_b(read: DataFrame) -> DataFrame:
    shape = """type string, timestamp string, payload struct<type:string,id:string,cwd:string,model:string,model_provider:string,role:string,content:string,summary:string,
      encrypted_content:string,call_id:string,name:string,arguments:string,input:string,output:string,is_error:boolean,
      info:struct<total_token_usage:struct<input_tokens:bigint,output_tokens:bigint,cached_input_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint>>>"""
    kinds = {f"{n}_kind": _kind(f"$.payload.{n}") for n in ("call_id", "id", "summary", "name")}
    p = read.select("session_key", "line", "problem", F.when(F.col("problem").isNull(), F.from_json("value", shape)).alias("j"), F.get_json_object("value", "$.payload").alias("whole"), *(k.alias(n) for n, k in kinds.items()))
    y, ts = F.col("j.payload"), F.col("j.timestamp")
    own_id = F.when(F.col("call_id_kind").isNull() | (F.col("call_id_kind") == "STRING"), y["call_id"])
    any_id = F.when(F.col("call_id_kind").isNull(), F.when(F.col("id_kind") == "STRING", y["id"])).otherwise(own_id)
    texts = F.transform(F.from_json(y["content"], "array<struct<type:string,text:string>>"), lambda i: i["text"])
    p = p.withColumns({
        "tag": F.when(F.col("j.type") == "response_item", y["type"]).otherwise(F.col("j.type")), "said": F.nullif(F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n"), F.lit("")),
        "own_id": own_id, "call_id": F.nullif(any_id, F.lit("")),
    })
    p = p.withColumn("thought", F.nullif(F.when(F.col("summary_kind") == "STRING", y["summary"]).otherwise(F.col("said")), F.lit("")))
    tag, model, line = F.col("tag"), F.lit("assistant"), F.col("line").cast("string")
    one = lambda b: F.array(b)
    name = F.when(F.col("name_kind") == "STRING", y["name"]).otherwise("unknown")
    web_id = F.coalesce(F.nullif(F.col("own_id"), F.lit("")), F.concat(F.lit("web-"), line))
    call = lambda c: F.concat(F.lit("call-"), c)
    is_call = tag.isin("function_call", "custom_tool_call") & F.col("call_id").isNotNull()
    made = (
        F.when((tag == "message") & F.col("said").isNotNull() & y["role"].isin("user", "assistant"), record(y["role"], F.when(y["role"] == "assistant", "assistant-step-"), one(block(kind="text", text=F.col("said"))), ts, step=F.lit(1)))
        .when((tag == "reasoning") & F.col("thought").isNotNull(), record(model, F.lit("reasoning-"), one(block(kind="thinking", text=F.col("thought"))), ts, step=F.lit(1)))
        .when(is_call, record(model, call(F.col("call_id")), one(block(kind="tool_use", tool_use_id=F.col("call_id"), name=name, input=F.coalesce(y["arguments"], y["input"]))), ts))
        .when((tag == "web_search_call") & (F.col("call_id_kind").isNull() | (F.col("call_id_kind") == "STRING")), record(model, call(web_id), one(block(kind="tool_use", tool_use_id=web_id, name="web_search", input=F.col("whole"))), ts))
    )
    out = F.when(tag.isin("function_call_output", "custom_tool_call_output") & F.col("own_id").isNotNull(), F.array(F.struct(F.lit(0).alias("seq"), F.col("own_id").alias("call_id"), y["output"].alias("output"), F.coalesce(y["is_error"], F.lit(False)).alias("is_error"))))
    t = y["info"]["total_token_usage"]
    counted = (tag == "event_msg") & (y["type"] == "token_count")
    total = F.when(counted & t.isNotNull(), usage(input_tokens=t["input_tokens"], output_tokens=t["output_tokens"], cache_read_tokens=t["cached_input_tokens"], reasoning_tokens=t["reasoning_output_tokens"], total_tokens=t["total_tokens"]))
    meta = tag == "session_meta"
    named = F.when(tag.isin("session_meta", "turn_context") & model_id(y["model"]), y["model"]).when(meta & model_id(y["model_provider"]), y["model_provider"])
    codes = F.array_compact(F.array(F.when((tag == "message") & y["role"].isin("developer", "system"), "skipped_role"), F.when((tag == "reasoning") & (y["encrypted_content"] != ""), "dropped_encrypted_reasoning")))
    return event(
        p.withColumn("made", made), record=F.col("made"), emits=F.when(F.col("made").isNotNull(), 1), results=out, cwd=F.when(meta, F.nullif(y["cwd"], F.lit(""))), meta_id=F.when(meta, F.nullif(y["id"], F.lit(""))), model=named,
        total=total, tokens=F.when(counted, t.isNotNull()), codes=codes,
    )


def tool_c(read: DataFrame) -> DataFrame:
    call = "struct<id:string,name:string,args:string,response:string>"
    part = f"struct<text:string,functionCall:{call},functionResponse:{call}>"
    shape = f"role string, timestamp string, model string, modelVersion string, parts array<{part}>, usageMetadata struct<promptTokenCount:bigint,candidatesTokenCount:bigint,totalTokenCount:bigint>"
    p = read.select("session_key", "line", "problem", F.when(F.col("problem").isNull(), F.from_json("value", shape)).alias("j"))
    j, m = F.col("j"), F.col("j.usageMetadata")
    kept = F.coalesce(j["role"].isin("user", "model"), F.lit(False))
    own_id = F.concat(F.lit("call-"), F.col("line").cast("string"))
    p = p.withColumn("parts", F.when(kept, F.coalesce(j["parts"], F.array().cast(f"array<{part}>"))))

    def shown(x: Column) -> Column:
        c = x["functionCall"]
        said = F.when(x["text"] != "", block(kind="text", text=x["text"]))
        called = F.when(c.isNotNull(), block(kind="tool_use", tool_use_id=F.coalesce(c["id"], own_id), name=F.coalesce(c["name"], F.lit("unknown")), input=c["args"]))
        return F.array_compact(F.array(said, called))

    def answer(x: Column, k: Column) -> Column:
        r = x["functionResponse"]
        return F.when(r.isNotNull(), F.struct(k.alias("seq"), F.coalesce(r["id"], own_id).alias("call_id"), r["response"].alias("output"), F.lit(False).alias("is_error")))

    p = p.withColumns({"blocks": F.flatten(F.transform("parts", shown)), "calls": F.size(F.filter("parts", lambda x: x["functionCall"].isNotNull()))})
    by_model = j["role"] == "model"
    use = F.when(by_model & m.isNotNull(), usage(input_tokens=m["promptTokenCount"], output_tokens=m["candidatesTokenCount"], total_tokens=m["totalTokenCount"]))
    some = F.size("blocks") > 0
    made = F.when(some, record(F.when(by_model, "assistant").otherwise("user"), F.when(by_model, "model-"), F.col("blocks"), j["timestamp"], use, F.col("calls") + 1, 1 << 20))
    return event(p, record=made, emits=F.when(some, F.col("calls") + 1), results=F.array_compact(F.transform("parts", answer)), model=F.coalesce(j["model"], j["modelVersion"]))


ADAPTERS = {"claude-code": tool_a, "codex": tool_b, "gemini": tool_c}
#: Tools whose group names hold the running count of their file's steps.
STEPPED = ("codex", "gemini")
