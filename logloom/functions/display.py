"""Scalar display functions (X1-X10): numbers, costs, dates, cut texts, warning lines, generation time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def humanize_tokens(n: Column) -> Column:
    two = lambda x: F.format_string("%.2f", x.cast("double"))
    return (
        F.when(n.isNull(), "-").when(n >= 1_000_000_000, F.concat(two(n / 1e9), F.lit("B"))).when(n >= 999_995_000, "1.00B")
        .when(n >= 1_000_000, F.concat(two(n / 1e6), F.lit("M"))).when(n >= 999_950, "1.00M")
        .when(n >= 1000, F.concat(F.format_string("%.1f", (n / 1000).cast("double")), F.lit("k"))).otherwise(n.cast("string"))
    )


def money(amount: Column, estimated: bool = False) -> Column:
    """Whole cents of amount * 100 in doubles, halves away from zero, as a cast to DECIMAL(18, 2) rounds in the queries' SQL."""
    return F.concat(F.lit("~$" if estimated else "$"), F.format_string("%.2f", F.round(amount.cast("double") * 100) / 100))


def percent(value: Column, digits: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", value.cast("double")), F.lit("%"))


def pad(value: Column, width: int) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def cost_cell(logged: Column, estimated: Column) -> Column:
    return F.when(logged.isNotNull(), money(logged)).when(estimated.isNotNull(), F.concat(money(estimated, True), F.lit(" est"))).otherwise("unknown")


def date_cell(ts: Column) -> Column:
    return F.when(F.coalesce(ts, F.lit("")) == "", "-").otherwise(F.substring(ts, 1, 10))


def cut_tail(path: Column, width: int, keep: int | None = None) -> Column:
    """Leading '...' and the last `keep` characters (width - 1 unless given)."""
    p = F.coalesce(path, F.lit("-"))
    return F.when(F.length(p) <= width, p).otherwise(F.concat(F.lit("..."), F.right(p, F.lit(width - 1 if keep is None else keep))))


def cut_middle(text: Column, width: int) -> Column:
    if width <= 0:
        return F.lit("")
    if width <= 3:
        return F.left(text, F.lit(width))
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.left(text, F.lit(width // 2)), F.lit("…"), F.right(text, F.lit((width - 1) // 2))))


def logged_cost_label(logged: Column) -> Column:
    return F.coalesce(money(logged), F.lit("unknown (local logs have no USD)"))


def estimated_cost_label(estimated: Column, priced: Column, sessions: Column, unpriced: Column, used: bool = True) -> Column:
    """Label of summed estimates; says how many sessions are priced where some are not."""
    if not used:
        return F.lit("not computed (use --estimate-cost)")
    amount = F.concat(money(estimated, True), F.lit(" est"))
    part = F.concat(amount, F.lit(" ("), priced.cast("string"), F.lit("/"), sessions.cast("string"), F.lit(" sessions priced)"))
    return F.when(estimated.isNull(), "unknown (no priced model for matched sessions)").when(unpriced > 0, part).otherwise(amount)


def unpriced_label(unpriced_sessions: Column, unpriced_tokens: Column, tokens: Column) -> Column:
    share = F.when(tokens > 0, percent(unpriced_tokens / tokens * 100)).otherwise("0.0%")
    return F.when(unpriced_sessions > 0, F.concat(humanize_tokens(unpriced_tokens), F.lit(" ("), share, F.lit(" of total)")))


def warning_line(code: Column, message: Column, count: Column, session_id: Column, source_path: Column) -> Column:
    """One line a summarised warning: count and place where it is repeated, the place alone where it is not."""
    from .privacy import anonymize_path, anonymize_paths_in_text

    place = anonymize_path(source_path)
    head = F.concat(F.lit("Warning ["), code, F.lit("]: "), anonymize_paths_in_text(message))
    where = F.when(source_path.isNotNull(), F.concat(F.lit(" in "), place)).when(session_id.isNotNull(), F.concat(F.lit(" in session "), session_id)).otherwise("")
    many = F.concat(F.lit(" ("), count.cast("string"), F.lit(" occurrences"), where, F.lit(")"))
    once = F.when(source_path.isNotNull(), F.concat(F.lit(" ("), place, F.lit(")"))).otherwise("")
    return F.concat(head, F.when(count > 1, many).otherwise(once))


def generated_at(now: str | None = None) -> Column:
    """ISO time in UTC with milliseconds; `now` fixes it."""
    return F.lit(now) if now else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
