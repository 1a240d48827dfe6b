"""Warnings and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIES, TOOLS

KEY = ("code", "message", "scope", "line", "session_id", "source_path")


def merged_warnings(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Union of warnings, the first of equal ones kept; `ord` orders them."""
    every = first
    for m in more:
        every = every.unionByName(m, allowMissingColumns=True)
    return every.groupBy(*KEY).agg(F.min_by("severity", "ord").alias("severity"), F.min("ord").alias("ord"))


def warning_summary(warnings: DataFrame) -> DataFrame:
    return warnings.groupBy("code", "message", "scope", "session_id", "source_path").agg(F.count("*").alias("count"), F.min_by("severity", "ord").alias("severity"))


def public_warnings(warnings: DataFrame) -> DataFrame:
    return warnings.drop("source_path")


def _broken(df: DataFrame, rules: dict[str, Column], *more: str) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return df.select("session_key", *more, F.explode(found).alias("rule"))


def turn_violations(turns: DataFrame) -> DataFrame:
    """turns(session_key, turn_index, turn_id, role) -> session_key, turn_index, rule."""
    rules = {
        "turn_id_missing": F.col("turn_id").isNull(), "turn_role_unknown": ~F.coalesce(F.col("role").isin("user", "assistant", "tool"), F.lit(False)),
        "turn_index_missing": F.col("turn_index").isNull(), "turn_index_negative": F.col("turn_index") < 0,
    }
    return _broken(turns, rules, "turn_index")


def block_violations(blocks: DataFrame) -> DataFrame:
    """blocks(session_key, turn_index, kind, text, tool_use_id, name, status) -> session_key, turn_index, rule."""
    kind = F.col("kind")
    rules = {
        "block_kind_unknown": ~F.coalesce(kind.isin("text", "thinking", "image", "tool_use", "tool_result"), F.lit(False)),
        "block_text_missing": kind.isin("text", "thinking") & F.col("text").isNull(), "block_call_id_missing": kind.isin("tool_use", "tool_result") & F.col("tool_use_id").isNull(),
        "block_name_missing": (kind == "tool_use") & F.col("name").isNull(), "block_status_unknown": F.col("status").isNotNull() & ~F.col("status").isin("success", "error"),
    }
    return _broken(blocks, rules, "turn_index")


def usage_violations(sessions: DataFrame) -> DataFrame:
    """A row for each token count of a session's usage that is negative, and for a total below its input or output."""
    u = F.col("usage")
    parts = [f"{c}_tokens" for c in (*CATEGORIES, "total")]
    rules = {f"usage_{p}_negative": u[p] < 0 for p in parts} | {"usage_total_too_small": u["total_tokens"] < F.greatest(F.coalesce(u["input_tokens"], F.lit(0)), F.coalesce(u["output_tokens"], F.lit(0)))}
    return _broken(sessions, rules)


def envelope_violations(envelopes: DataFrame, payload: str, format_: str) -> DataFrame:
    """envelopes(format, generated_at, payload, ...) -> format, rule: another format, no ISO time, no payload."""
    rules = {
        "format_unknown": ~F.coalesce(F.col("format") == format_, F.lit(False)), "generated_at_invalid": ~F.coalesce(F.col("generated_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.lit(False)),
        "payload_missing": F.col(payload).isNull(),
    }
    return _broken(envelopes.withColumn("session_key", F.col("format")), rules).withColumnRenamed("session_key", "format")


def all_violations(sessions: DataFrame, turns: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every broken rule of normalised tables: session_key, turn_index (null for a session's own), rule."""
    own = violations(sessions).unionByName(usage_violations(sessions)).withColumn("turn_index", F.lit(None).cast("int"))
    return own.unionByName(turn_violations(turns)).unionByName(block_violations(blocks))


def violations(sessions: DataFrame) -> DataFrame:
    """A row for each broken rule of a session."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = {
        "id_missing": blank("id"), "tool_unknown": ~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)), "source_missing": blank("source_path"),
        "turn_count_negative": F.coalesce(F.col("turn_count") < 0, F.lit(True)), "cost_negative": F.coalesce(F.col("cost_usd") < 0, F.lit(False)),
        "ends_before_start": F.coalesce(F.col("ended_at") < F.col("started_at"), F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return sessions.select("session_key", F.explode(broken).alias("rule"))
