"""Running sums over groups of any size: a group is cut into segments, each summed in a task of its own, and small sums carry over from segment to segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the leading order column that one segment spans.
SEGMENT = 1 << 16


def carried(frame: DataFrame, keys: list[str], segment: str, sums: dict[str, Column]) -> DataFrame:
    """keys, segment and, by name, the sum over all earlier segments of the key: one row a segment, so the window over keys is small."""
    each = frame.groupBy(*keys, segment).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*keys, segment, *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast("bigint").alias(n) for n in sums))


def running(frame: DataFrame, keys: list[str], orders: dict[str, tuple[list[str], Column]], span: int = SEGMENT) -> DataFrame:
    """frame with, by name, the sum of a value over all earlier rows of the key.

    orders: name -> (order, value). All orders start with the same column of whole numbers, whose ranges of `span` are the segments; the key and a segment are
    shuffled together, so a key with a third of all rows spreads over as many tasks as it has segments. The window form over whole keys gives the same sums.
    """
    by = next(iter(orders.values()))[0][0]
    cut = frame.withColumn("_segment", F.floor(F.col(by) / span))
    before = carried(cut, keys, "_segment", {f"_{n}": v for n, (_, v) in orders.items()})
    for name, (order, value) in orders.items():
        local = Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn(name, F.coalesce(F.sum(value).over(local), F.lit(0)))
    joined = cut.join(before, [*keys, "_segment"])
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in orders}).drop("_segment", *(f"_{n}" for n in orders))
