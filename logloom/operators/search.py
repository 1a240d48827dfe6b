"""Per-turn search with snippets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_SNIPPETS, NO_PREVIEW, PREVIEW_CHARS, SNIPPET_RADIUS
from ..functions.predicates import any_project, parse_query, text_matches
from ..functions.privacy import anonymize_path, redact


def turn_texts(blocks: DataFrame, reasoning: bool = False, tool_output: bool = False) -> DataFrame:
    """blocks(session_key, turn_index, block_pos, role, kind, text, output) -> searchable text of each turn."""
    kinds = ["text", *(["thinking"] if reasoning else []), *(["tool_result"] if tool_output else [])]
    part = F.when(F.col("kind") == "tool_result", F.coalesce("output", F.lit('""'))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("block_pos", part.alias("part"))))
    return blocks.where(F.col("kind").isin(*kinds)).groupBy("session_key", "turn_index", "role").agg(F.array_join(parts["part"], "\n").alias("text"))


def snippet(text: Column, needle: str, radius: int = SNIPPET_RADIUS) -> Column:
    at = F.instr(F.lower(text), needle.lower()) - 1
    start = F.greatest(at - radius, F.lit(0))
    end = F.least(F.length(text), at + len(needle) + radius)
    found = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at < 0, F.left(text, F.lit(radius * 2))).otherwise(found)


def marked(text: Column, needles: list[str], open_: str = "<m>", close: str = "</m>") -> Column:
    """Hits in a snippet, any case, original case kept."""
    if not needles:
        return text
    each = "|".join(re.escape(n) for n in sorted(needles, key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)({each})", f"{open_}$1{close}")


def hits(turns: DataFrame, query: str, tool_output: bool = False) -> DataFrame:
    """Turns(session_key, turn_index, role, text) that match by themselves."""
    q = parse_query(query)
    roles = F.lit(True) if tool_output else F.col("role").isin("user", "assistant")
    return turns.where(roles & text_matches(F.col("text"), q))


def search(sessions: DataFrame, turns: DataFrame, query: str, max_snippets: int = MAX_SNIPPETS, tool_output: bool = False, redacted: bool = True, redact_first: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """Match rows: session_key, tool, project_path (anonymised), timestamp, snippets in turn order, total_hits."""
    q = parse_query(query)
    chosen = sessions.where(any_project(F.col("project_path"), q.projects))
    clean = (lambda c: redact(c, extra)) if redacted else (lambda c: c)
    head = ["session_key", "tool", anonymize_path(F.col("project_path")).alias("project_path"), F.col("started_at").alias("timestamp")]
    if not q.has_text:
        first = previews(turns).withColumn("preview", clean(F.col("preview")))
        return chosen.join(first, "session_key", "left").select(*head, F.array(F.coalesce("preview", F.lit(NO_PREVIEW))).alias("snippets"), F.lit(1).cast("long").alias("total_hits"))
    found = hits(turns.join(chosen.select("session_key"), "session_key", "left_semi"), query, tool_output)
    needle = q.needle(query)
    w = Window.partitionBy("session_key").orderBy("turn_index")
    found = found.withColumn("n", F.row_number().over(w))
    shown = F.when(F.col("n") <= max_snippets, F.struct("n", (snippet(clean(F.col("text")), needle) if redact_first else clean(snippet(F.col("text"), needle))).alias("s")))
    grouped = found.withColumn("shown", shown).groupBy("session_key").agg(F.array_sort(F.collect_list("shown"))["s"].alias("snippets"), F.count("*").alias("total_hits"))
    return chosen.join(grouped, "session_key").select(*head, "snippets", "total_hits")


def previews(turns: DataFrame) -> DataFrame:
    """First user turn of each session that is not blank, cut to the preview length."""
    own = turns.where((F.col("role") == "user") & F.col("text").rlike(r"\S"))
    first = own.groupBy("session_key").agg(F.min_by("text", "turn_index").alias("text"))
    cut = F.when(F.length("text") > PREVIEW_CHARS, F.concat(F.left("text", F.lit(PREVIEW_CHARS)), F.lit("..."))).otherwise(F.col("text"))
    return first.select("session_key", cut.alias("preview"))


def hidden_hits(matches: DataFrame) -> DataFrame:
    return matches.withColumn("hidden", F.col("total_hits") - F.size("snippets"))
