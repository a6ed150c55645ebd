"""Positions of rows in the order of their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import materialize

#: Rows of one range of the order.
RANGE_ROWS = 20_000


def ranges(rows: DataFrame, n: int | None = None) -> int:
    """How many ranges of ``RANGE_ROWS`` the rows make; it grows with the table alone."""
    return max(1, -(-(rows.count() if n is None else n) // RANGE_ROWS))


def ranked(rows: DataFrame, group: list[str], order: list[str], tag: str) -> DataFrame:
    """``rows`` with ``at`` (from 0, nulls first) and ``n`` (rows of the group), written to the shared folder.

    Rows are dealt to ranges of (group, order), so a group of a third of all rows spreads over a third of them. A
    window numbers each range's part of a group, and the counts of the ranges before it are added: one row a
    range and group. ``order`` should tell all rows apart, or equal ones share a range. Null groups are a group.
    """
    kept = rows.columns
    parted = rows.repartitionByRange(ranges(rows), *group, *order).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part", *group).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    # The ranges' bounds are drawn by sampling, so the numbered rows are written once and then counted.
    numbered = materialize(parted.withColumn("__rank", F.row_number().over(inside) - 1), f"{tag}-ranges")
    counts = numbered.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("__c").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__part", *group, F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__c").over(whole).alias("n"))
    a, b = numbered.alias("a"), counts.alias("b")
    same = F.col("a.__part") == F.col("b.__part")
    for c in group:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    at = (F.col("a.__rank") + F.col("b.__before")).cast("long")
    return materialize(a.join(b, same).select(*(F.col(f"a.{c}") for c in kept), at.alias("at"), F.col("b.n").cast("long").alias("n")), tag)
