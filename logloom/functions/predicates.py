"""Filters of sessions and turns (F1-F11): Column builders and driver-side parsing of their arguments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PLACEHOLDER_MODELS, PROVIDER_NAMES


def tool_in(tool: Column, tools: list[str] | None) -> Column:
    return tool.isin(*tools) if tools else F.lit(True)


def project_is(path: Column, wanted: str | None) -> Column:
    """Path-like filters match a path or what lies below it; others match any segment, ignoring case."""
    if not wanted:
        return F.lit(True)
    clean = lambda c: F.regexp_replace(F.translate(c, "\\", "/"), "/$", "")
    path, wanted = clean(path), re.sub("/$", "", wanted.replace("\\", "/"))
    if "/" in wanted or wanted[:1] in ("~", "."):
        hit = (path == wanted) | path.startswith(wanted + "/")
    else:
        hit = F.array_contains(F.split(F.lower(path), "/"), wanted.lower())
    return F.coalesce(hit & (path != ""), F.lit(False))


def any_project(path: Column, wanted: list[str] | None) -> Column:
    return reduce(or_, (project_is(path, w) for w in wanted)) if wanted else F.lit(True)


def in_dates(started: Column, ended: Column, since: datetime | None, until: datetime | None) -> Column:
    """Both ends count; a missing date passes only without bounds, one that can't be read passes."""
    text = F.nullif(F.coalesce(ended, started), F.lit(""))
    ts = F.try_to_timestamp(text)
    checks = []
    if since is not None:
        checks.append(~F.coalesce(ts < F.lit(since), F.lit(False)))
    if until is not None:
        checks.append(~F.coalesce(ts > F.lit(until), F.lit(False)))
    return reduce(and_, checks, text.isNotNull()) if checks else F.lit(True)


def parse_bound(text: str | None, now: datetime) -> datetime | None:
    """ISO text, or 7d / 24h / 30m before `now`; None if it can't be read."""
    if not text:
        return None
    if m := re.fullmatch(r"(\d+)([dhm])", text.strip()):
        return now - timedelta(**{{"d": "days", "h": "hours", "m": "minutes"}[m[2]]: int(m[1])})
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


@dataclass
class TextQuery:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    every: bool = False
    projects: list[str] = field(default_factory=list)

    @property
    def has_text(self) -> bool:
        return bool(self.terms or self.phrases)

    def needle(self, raw: str) -> str:
        return next(iter([*self.phrases, *self.terms]), raw)


def parse_query(text: str) -> TextQuery:
    """project: fields leave a space, quoted phrases leave nothing, and/or words pick the operator."""
    q, rest = TextQuery(), text.strip()

    def take(m: re.Match) -> str:
        if m[1].lower() != "project":
            return m[0]
        q.projects.append(m[3] if m[3] is not None else m[4])
        return " "

    rest = re.sub(r'\b([a-z][a-z0-9_-]*):("([^"]*)"|(\S+))', take, rest, flags=re.I | re.A)
    q.every = bool(re.search(r"\bAND\b", rest, re.I)) and not re.search(r"\bOR\b", rest, re.I)
    q.phrases = re.findall(r'"([^"]+)"', rest)
    rest = re.sub(r'"[^"]+"', "", rest)
    q.terms = re.sub(r"\b(AND|OR)\b", " ", rest, flags=re.I).split()
    return q


def text_matches(text: Column, q: TextQuery, case_sensitive: bool = False) -> Column:
    needles = [*q.phrases, *q.terms]
    if not needles:
        return F.lit(True)
    fold = (lambda c: c) if case_sensitive else F.lower
    hits = [F.contains(fold(text), F.lit(n if case_sensitive else n.lower())) for n in needles]
    return reduce(and_ if q.every else or_, hits)


def sessions_with_text(sessions: DataFrame, blocks: DataFrame, q: TextQuery) -> DataFrame:
    """Session-level text filter: words may lie in different turns.

    blocks(session_key, turn_index, block_pos, role, kind, text). Needles without a newline lie inside one
    block, so each is a bool_or with map-side combine; only phrases with a newline gather the text.
    """
    needles = [*q.phrases, *q.terms]
    if not needles:
        return sessions
    own = blocks.where((F.col("kind") == "text") & F.col("role").isin("user", "assistant"))
    if any("\n" in n for n in needles):
        parts = F.array_sort(F.collect_list(F.struct("turn_index", "block_pos", "text")))
        found = own.groupBy("session_key").agg(F.array_join(parts["text"], "\n").alias("text")).where(text_matches(F.col("text"), q))
    else:
        hits = [F.bool_or(F.contains(F.lower("text"), F.lit(n.lower()))) for n in needles]
        found = own.groupBy("session_key").agg(reduce(and_ if q.every else or_, hits).alias("hit")).where("hit")
    return sessions.join(found.select("session_key"), "session_key", "left_semi")


def placeholder_model(model: Column) -> Column:
    m = F.lower(F.trim(model))
    return F.coalesce((m == "") | m.isin(*PLACEHOLDER_MODELS) | m.rlike("^<.*>$"), F.lit(True))


def model_id(value: Column) -> Column:
    v = F.lower(value)
    return F.coalesce(~v.isin(*PROVIDER_NAMES) & v.rlike(r"^(claude|codex|gemini|gpt|o\d)") & v.rlike(r"[\d-]"), F.lit(False))
