"""Running sums and gapless numbers over long sequences, in two levels.

A key's rows are cut into ranges of their order. The ranges are summed map-side; a window over the few sums of a key
gives what lies before each range, and windows within ranges do the rest. No task holds a key, only one range of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(rows: DataFrame, keys: list[str], by: Column, value: Column) -> DataFrame:
    """(keys, range, in_range, before): the sum of each range and of all ranges of its key before it."""
    sums = rows.groupBy(*keys, by.alias("range")).agg(F.sum(value).alias("in_range"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)))


def running(rows: DataFrame, keys: list[str], order: list[str], width: int, value: Column | None = None, name: str = "running", only: Column | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``value`` (1 a row without it) over the key's rows up to and with each.

    ``order``: columns of which the first is a whole number, cut into ranges of ``width``; together they tell rows of a key
    apart, or the order among equals is open. Keys are not null. ``only``: a condition on in_range and before; other ranges
    are left out, and their rows are not sorted.
    """
    value = F.lit(1) if value is None else value
    by = F.floor(F.col(order[0]) / width).cast("long")
    cut = ranges(rows, keys, by, value)
    if only is not None:
        cut = cut.where(only)
    inside = Window.partitionBy(*keys, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.withColumn("range", by).join(cut.drop("in_range"), [*keys, "range"])
    return joined.withColumn(name, F.col("before") + F.sum(value).over(inside)).drop("range", "before")
