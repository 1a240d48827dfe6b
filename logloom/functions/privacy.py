"""Column functions that hide secrets, paths and unsafe text (R1-R11). All stay in whole-stage codegen or built-ins."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import REDACT_HEADS, REDACT_PATTERNS, REDACTED


def redact(text: Column, extra: Iterable[str] = ()) -> Column:
    """Built-in secret patterns, then extra ones, each hit replaced. Texts without the head of any built-in pattern skip these."""
    clean = text
    for p in REDACT_PATTERNS:
        clean = F.regexp_replace(clean, p, REDACTED)
    text = F.when(text.rlike(REDACT_HEADS), clean).otherwise(text)
    for p in extra:
        text = F.regexp_replace(text, p, REDACTED)
    return text


def parse_patterns(patterns: Iterable[str]) -> tuple[list[str], list[str]]:
    """(usable, invalid) extra patterns."""
    good, bad = [], []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            bad.append(p)
    return good, bad


def redact_json(column: Column, extra: Iterable[str] = (), paths: bool = False, lists: bool = False) -> Column:
    """Redacts every string leaf of a JSON text (`lists`: of each text of an array); keys, numbers and unparsable text's shape stay.
    `paths` hides home folders too. One Arrow UDF: regexes on the serialised text would eat quotes."""
    import json

    homes = [(re.compile(p), "~") for p in (r"/Users/[^/\s'\"]+", r"/home/[^/\s'\"]+")] if paths else []
    rules = [*homes, *((re.compile(p), REDACTED) for p in (*REDACT_PATTERNS, *extra))]
    # what a serialised text must hold for any rule to match; an escape may hide anything
    gate = None if extra else re.compile("|".join([REDACT_HEADS, r"\\", *(("/Users/", "/home/") if paths else ())]))

    def clean(x):
        if isinstance(x, str):
            for r, into in rules:
                x = r.sub(into, x)
            return x
        if isinstance(x, list):
            return [clean(v) for v in x]
        return {k: clean(v) for k, v in x.items()} if isinstance(x, dict) else x

    def one(v):
        if v is None or (gate and not gate.search(v)):
            return v
        try:
            return json.dumps(clean(json.loads(v)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return clean(v)

    @F.pandas_udf("array<string>" if lists else "string")
    def leaves(values: pd.Series) -> pd.Series:
        return values.map((lambda vs: [one(v) for v in vs]) if lists else one, na_action="ignore")

    if gate is None:
        return leaves(column)
    some = F.exists(column, lambda x: x.rlike(gate.pattern)) if lists else column.rlike(gate.pattern)
    return F.when(some, leaves(F.when(some, column))).otherwise(column)  # only texts that may change go through Python


def anonymize_path(path: Column, home: str = "") -> Column:
    plain = F.regexp_replace(F.regexp_replace(path, "^/Users/[^/]+", "~"), "^/home/[^/]+", "~")
    if not home:
        return plain
    return F.when(path.startswith(home), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(plain)


def anonymize_paths_in_text(text: Column, home: str = "") -> Column:
    if home:
        text = F.replace(text, F.lit(home), F.lit("~"))
    return F.regexp_replace(F.regexp_replace(text, r"/Users/[^/\s'\"]+", "~"), r"/home/[^/\s'\"]+", "~")


def csv_cell(value: Column) -> Column:
    """Guards formula leads, quotes where needed."""
    safe = F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def neutral_markdown(text: Column, raw: bool = False) -> Column:
    if raw:
        return text
    text = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for scheme in ("javascript", "data"):
        text = F.regexp_replace(text, rf"(?i)\[([^\]]+)\]\(\s*{scheme}:[^)]+\)", "[$1](#)")
    return text


def strip_control(text: Column, inline: bool = False) -> Column:
    """Terminal escapes and control characters; inline also folds tab and newline runs to one space."""
    for p in ("\x1b\\[[0-9;?]*[ -/]*[@-~]", "\x1b\\][^\x1b\x07]*(?:\x07|\x1b\\\\)", "\x1b[@-_]", "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]"):
        text = F.regexp_replace(text, p, "")
    return F.regexp_replace(text, "[\\t\\r\\n]+", " ") if inline else text
