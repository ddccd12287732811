"""Gapless numbers for rows of groups of any size, without one task that sees a group whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

BROADCAST_RUNS = 200_000  # runs that are sent to every task; more are joined by a shuffle
_ROW_BITS = 33  # monotonically_increasing_id holds the row of a task in so many bits


def numbered(rows: DataFrame, group: list[str], order: list[Column | str], at: str = "at", size: str = "size") -> DataFrame:
    """``rows`` with their place in their group (from 0, by ``order``) and the group's size.

    Rows are range-sorted by group, order and a mark, so that neither a hot group nor ties can fill one task; the sorted table is written with each row's
    place in its task. A task's run of a group is counted, and the runs before it give its offset. Rows that tie are numbered by their marks, which depend
    on partitions. Null groups and null order values come first. ``rows`` is read twice (range bounds are sampled), so it should be cheap to read.
    """
    mark, place, part, first, count, before = "__mark", "__place", "__part", "__first", "__count", "__before"
    keys = [*group, *order, mark]
    ranged = rows.withColumn(mark, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(mark)
    ranged = written(ranged.withColumn(place, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(place, _ROW_BITS))
    by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    runs = ranged.groupBy(*group, part).agg(F.min(place).alias(first), F.count("*").alias(count))
    earlier = by_group.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(before, F.coalesce(F.sum(count).over(earlier), F.lit(0))).withColumn(size, F.sum(count).over(by_group))
    runs = written(runs, "runs")
    names = [*group, part]
    some = runs.limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    right = runs.select(*[F.col(c).alias(f"__run_{c}") for c in names], first, before, size)
    same = [F.col(c).eqNullSafe(F.col(f"__run_{c}")) for c in names]
    met = ranged.join(F.broadcast(right) if some else right, same)
    return met.withColumn(at, F.col(place) - F.col(first) + F.col(before)).select(*rows.columns, at, size)

