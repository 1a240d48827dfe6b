"""A whole run over log roots: choose and scan sources, normalise each tool, union, filter (S1-S8, N*, U1, F1-F9)."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import fields
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MAX_FILE_BYTES, TOOLS
from ..functions.predicates import any_project, in_dates, parse_query, sessions_with_text
from ..sources import agent_logs, logs
from .normalize import Normalised, normalise


def read_tool(spark: SparkSession, tool: str, root: str, since: datetime | None = None, until: datetime | None = None, max_file_bytes: int = MAX_FILE_BYTES, guarded: bool = True) -> Normalised:
    """One tool's root as tables. guarded: by the data source, so that a file that can't be read gives a warning; else by Spark's text reader, which then fails the job.

    since and until prune tool B's dated folders before anything is read: a folder counts as its day's midnight in UTC.
    """
    if guarded:
        found = agent_logs.listed(tool, root)
        files = spark.createDataFrame([(tool, agent_logs.shown(f.path)) for f in found], "tool string, source_path string")
        days = {k: v.strftime("%Y-%m-%d") for k, v in (("since", since), ("until", until)) if v and tool == "codex"}
        raw, broken = agent_logs.readable(agent_logs.load(spark, tool, root, **days))
    else:
        files = logs.file_table(spark, tool, root)
        raw, broken = logs.log_files(spark, tool, root), None
    if tool == "codex" and (since or until):
        raw, files = (logs.within_path_dates(x, *(d.isoformat() if d else None for d in (since, until)), exact=True) for x in (raw, files))
    small, large = logs.size_guard(raw, max_file_bytes)
    left_out = large if broken is None else large.unionByName(broken)
    return normalise(logs.numbered(small), tool, files=files, too_large=left_out)


def run(
    spark: SparkSession, roots: dict[str, str], tools: Iterable[str] | None = None, since: datetime | None = None, until: datetime | None = None, projects: list[str] | None = None, text: str | None = None,
    max_file_bytes: int = MAX_FILE_BYTES, guarded: bool = True,
) -> Normalised:
    """Tables of all chosen tools whose root can be reached, of the sessions that pass the project, date and text filters in that order.

    text is a query as in `parse_query`; its `project:` fields are filters beside `projects`. A root that can't be reached is a warning (`source_unavailable`, without a session); so is one
    that fails to be listed.
    """
    parts, absent = [], []
    chosen = [t for t in TOOLS if t in roots and (not tools or t in set(tools))]
    open_ = {r.tool for r in logs.reachable(spark, {t: roots[t] for t in chosen}).where("accessible").collect()} if chosen else set()
    for tool in chosen:
        try:
            if tool not in open_:
                raise FileNotFoundError(roots[tool])
            parts.append(read_tool(spark, tool, roots[tool], since, until, max_file_bytes, guarded))
        except Exception:  # one source that can't be listed must not stop the others
            absent.append((None, "source_unavailable", None))
    if not parts:
        raise FileNotFoundError("none of the roots can be read: " + ", ".join(roots[t] for t in chosen))
    every = Normalised(*(reduce(DataFrame.unionByName, (getattr(p, f.name) for p in parts)) for f in fields(Normalised)))
    s = every.sessions
    query = parse_query(text) if text else None
    for some in [projects, *([p] for p in (query.projects if query else ()))]:
        if some:
            s = s.where(any_project(F.col("project_path"), some))
    s = s.where(in_dates(F.col("started_at"), F.col("ended_at"), since, until))
    if query:
        said = every.blocks.join(every.turns.select("session_key", "turn_index", "role"), ["session_key", "turn_index"])
        s = sessions_with_text(s, said, query)
    if since or until or projects or text:
        kept = s.select("session_key")
        every = Normalised(s, *(getattr(every, f.name).join(kept, "session_key", "left_semi") for f in fields(Normalised)[1:]))
    if absent:
        every.warnings = every.warnings.unionByName(spark.createDataFrame(absent, every.warnings.schema))
    return every
