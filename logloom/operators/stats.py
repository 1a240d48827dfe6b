"""Session statistics (A11-A25, W5-W10). Facts are flat rows; every aggregate combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CATEGORIES, MOST_ACTIVE_DAYS, UNKNOWN_PROJECT
from ..functions.privacy import anonymize_path


def five(usage: Column) -> Column:
    return sum((F.coalesce(usage[f"{c}_tokens"], F.lit(0)) for c in CATEGORIES[1:]), F.coalesce(usage["input_tokens"], F.lit(0)))


def summary_tokens(usage: Column) -> Column:
    return F.coalesce(usage["total_tokens"], F.nullif(five(usage), F.lit(0)))


def stats_tokens(usage: Column) -> Column:
    return F.coalesce(usage["total_tokens"], five(usage), F.lit(0)).cast("long")


def summaries(sessions: DataFrame, home: str = "") -> DataFrame:
    """One row a session: id, tool, anonymised project, model, bounds, turns, tokens, cost."""
    return sessions.select(
        "session_key", "id", "tool", anonymize_path(F.col("project_path"), home).alias("project_path"), "model", "started_at", "ended_at", "turn_count",
        summary_tokens(F.col("usage")).alias("total_tokens"), "cost_usd",
    )


def facts(sessions: DataFrame, home: str = "", *more: str) -> DataFrame:
    """The narrow row that all statistics share, and the columns named in more."""
    return sessions.select(
        "session_key", "tool", F.coalesce(anonymize_path(F.nullif(F.col("project_path"), F.lit("")), home), F.lit(UNKNOWN_PROJECT)).alias("project"),
        F.nullif(F.substring(F.coalesce("started_at", "ended_at"), 1, 10), F.lit("")).alias("day"), F.coalesce("turn_count", F.lit(0)).cast("long").alias("turns"), stats_tokens(F.col("usage")).alias("tokens"), *more,
    )


_SUMS = lambda: (F.count("*").alias("sessions"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def totals(f: DataFrame) -> DataFrame:
    return f.agg(*_SUMS())


def by(f: DataFrame, key: str) -> DataFrame:
    return f.where(F.col(key).isNotNull()).groupBy(key).agg(*_SUMS())


def most_active_days(f: DataFrame, n: int = MOST_ACTIVE_DAYS) -> DataFrame:
    return by(f, "day").drop("tokens").orderBy(F.desc("sessions"), F.desc("turns"), "day").limit(n)


def _breakdown() -> list[Column]:
    seen = [F.coalesce(F.col("observed")[c], F.lit(False)) for c in CATEGORIES]
    sums = [F.coalesce(F.sum(F.when(s, F.coalesce(F.col("usage")[f"{c}_tokens"], F.lit(0)))), F.lit(0)).cast("long").alias(c) for c, s in zip(CATEGORIES, seen)]
    flags = [F.coalesce(F.bool_or(s), F.lit(False)).alias(f"observed_{c}") for c, s in zip(CATEGORIES, seen)]
    return [*sums, *flags, F.count_if(seen[0] | seen[1] | seen[2] | seen[3] | seen[4]).alias("observed_sessions")]


def token_breakdown(sessions: DataFrame) -> DataFrame:
    """Sums, observed flags and the count of sessions that report any category; observed means the key is present."""
    return sessions.agg(*_breakdown())


def _costs(use_estimates: bool) -> list[Column]:
    logged, est = F.col("cost_usd"), F.col("estimate.cost_usd") if use_estimates else F.lit(None).cast("double")
    kind = F.when(logged.isNotNull(), "logged").when(est.isNotNull(), "estimated").otherwise("unpriced")
    return [
        F.sum(logged).alias("logged_cost"), F.count_if(kind == "logged").alias("logged_sessions"),
        F.sum(F.when(kind == "estimated", est)).alias("estimated_cost"), F.count_if(kind == "estimated").alias("estimated_sessions"),
        F.count_if(kind == "unpriced").alias("unpriced_sessions"), F.coalesce(F.sum(F.when(kind == "unpriced", stats_tokens(F.col("usage")))), F.lit(0)).alias("unpriced_tokens"),
    ]


def cost_partition(sessions: DataFrame, use_estimates: bool) -> DataFrame:
    return sessions.agg(*_costs(use_estimates))


def report(f: DataFrame) -> DataFrame:
    """Totals, tools, projects and days in one pass: grouping sets over the narrow facts."""
    cube = f.groupingSets([[], ["tool"], ["project"], ["day"]], "tool", "project", "day").agg(F.grouping_id().alias("g"), *_SUMS())
    part = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "tool").when(F.col("g") == 5, "project").otherwise("day")
    return cube.where((F.col("g") != 6) | F.col("day").isNotNull()).select(part.alias("part"), F.coalesce("tool", "project", "day").alias("key"), "sessions", "turns", "tokens")


def coverage(cost: DataFrame, total: DataFrame) -> DataFrame:
    """Priced sessions and the share of unpriced tokens in percent, one decimal. Both sides are one row."""
    share = F.when(F.col("tokens") > 0, F.round(F.col("unpriced_tokens") / F.col("tokens") * 100, 1)).otherwise(0.0)
    return cost.join(F.broadcast(total)).select((F.col("logged_sessions") + F.col("estimated_sessions")).alias("priced_sessions"), "sessions", share.alias("unpriced_share"))


def split_coverage(breakdown: DataFrame, total: DataFrame) -> DataFrame:
    seen = sum((F.when(F.col(f"observed_{c}"), F.col(c)).otherwise(0) for c in CATEGORIES[1:]), F.when(F.col("observed_input"), F.col("input")).otherwise(0))
    j = breakdown.join(F.broadcast(total)).withColumn("observed_sum", seen)
    return j.select("observed_sum", "observed_sessions", (F.col("observed_sessions") < F.col("sessions")).alias("partial"), (F.col("observed_sum") != F.col("tokens")).alias("divergent"))


def ranked(groups: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Groups by tokens descending with rank; `top` keeps that many and says how many are left out.

    The window runs over one row a group (tools, projects), not over sessions.
    """
    w = Window.orderBy(F.desc("tokens"), key)
    r = groups.withColumn("rank", F.row_number().over(w))
    return r if top is None else r.withColumn("hidden", F.greatest(F.count("*").over(Window.partitionBy()) - top, F.lit(0))).where(F.col("rank") <= top)


def last_days(days: DataFrame, n: int) -> DataFrame:
    return days.orderBy(F.desc("day")).limit(n).orderBy("day")


def spark_levels(series: DataFrame, value: str, levels: int = 8) -> DataFrame:
    """Level 0 .. levels-1 of each value between the series' minimum and maximum; null where the maximum is 0. The series is one row a day."""
    all_ = Window.partitionBy()
    lo, hi, v = F.min(value).over(all_), F.max(value).over(all_), F.col(value)
    level = F.when(hi == 0, None).when(lo == hi, 0).otherwise(F.floor((v - lo) / (hi - lo) * (levels - 1) + 0.5))
    return series.withColumn("level", level.cast("int"))


def bar_widths(series: DataFrame, value: str, width: int) -> DataFrame:
    top, v = F.max(value).over(Window.partitionBy()), F.col(value)
    return series.withColumn("bar", F.when((top <= 0) | (v <= 0), 0).otherwise(F.least(F.lit(width), F.greatest(F.lit(1), F.floor(v / top * width + 0.5)))).cast("int"))


def stacked_widths(segments: DataFrame, ord_: str, value: str, width: int) -> DataFrame:
    """Integer widths of positive segments; the last takes what is left."""
    s = segments.where(F.col(value) > 0)
    w = Window.orderBy(ord_)
    s = s.withColumn("w", F.floor(F.col(value) / F.sum(value).over(Window.partitionBy()) * width).cast("int"))
    used = F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(w) == F.count("*").over(Window.partitionBy())
    return s.withColumn("width", F.when(last, F.lit(width) - used).otherwise(F.col("w")).cast("int")).drop("w")


def full_report(sessions: DataFrame, use_estimates: bool = False, home: str = "") -> DataFrame:
    """One row with totals, costs and breakdown, and maps by tool, project and day.

    Sessions are read once and combined by tool, project and day; grouping sets over those rows give all parts. The maps hold
    a row a group, never a row a session; most active days are the first ten of their order. No sessions give zeros and empty maps.
    """
    more = ["usage", "observed", "cost_usd", *(["estimate"] if use_estimates else [])]
    cells = facts(sessions, home, *more).groupBy("tool", "project", "day").agg(*_SUMS(), *_costs(use_estimates), *_breakdown())
    parts, flags = cells.columns[3:], {f"observed_{c}" for c in CATEGORIES}

    def filled(x: Column, c: str) -> Column:
        """Costs that no session has stay null; counts are 0 and flags false."""
        return (x if c in ("logged_cost", "estimated_cost") else F.coalesce(x, F.lit(False if c in flags else 0))).alias(c)

    cube = cells.groupingSets([[], ["tool"], ["project"], ["day"]], "tool", "project", "day").agg(F.grouping_id().alias("g"), *(filled((F.bool_or if c in flags else F.sum)(c), c) for c in parts))
    total = lambda c: filled(F.max(F.when(F.col("g") == 7, F.col(c))), c)

    def groups(g: int, key: str, *row: Column) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("g") == g) & F.col(key).isNotNull(), F.struct(*row))))

    as_map = lambda g, key: F.map_from_entries(groups(g, key, F.col(key).alias("key"), F.struct("sessions", "turns", "tokens").alias("value"))).alias(f"by_{key}")
    days = F.slice(groups(6, "day", (-F.col("sessions")).alias("s"), (-F.col("turns")).alias("t"), F.col("day"), F.col("sessions"), F.col("turns")), 1, MOST_ACTIVE_DAYS)
    seen = parts[parts.index(CATEGORIES[0]) :]
    return cube.agg(
        *(total(c) for c in parts[: -len(seen)]), F.struct(*(total(c) for c in seen)).alias("token_breakdown"), as_map(3, "tool"), as_map(5, "project"), as_map(6, "day"),
        F.transform(days, lambda d: F.struct(d["day"].alias("day"), d["sessions"].alias("sessions"), d["turns"].alias("turns"))).alias("most_active_days"),
    )
