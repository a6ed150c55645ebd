"""Exact quantiles of any number of groups of any size, by radix selection.

Values are counted by group and written once. A double's bits, put in order, are taken 16 at a time: the counts of the
leading digits say in which one each order statistic lies, and only values with those digits are counted by the next
ones. So a window sees at most 65,536 rows, a pass hands on a few rows a group, and four passes reach the value itself.
Where every group has few distinct values, one running count over them does the same.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.sources import sinks

#: Distinct values of a group that one window may count.
FEW = 100_000
DIGIT, DIGITS = 16, 4


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A long for each double that is not NaN, in the same order; the two zeros are one."""
    bits = (x.to_numpy(dtype=np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


def value_counts(rows: DataFrame, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ``v`` and ``c``: how often each group has each value; nulls and NaN are left out."""
    v = F.col(x).cast("double")
    used = rows.where(v.isNotNull() & ~F.isnan(v))
    return used.groupBy(*keys, (v + 0.0).alias("v")).agg(F.count(F.lit(1)).alias("c"))


def quantiles(rows: DataFrame, x: str, points: Sequence[float], keys: Sequence[str] = (), few: int = FEW, write: Callable[[DataFrame, str], DataFrame] = sinks.written) -> DataFrame:
    """keys and ``q``, the interpolated quantiles at ``points``. A null key is a group; groups without a value are left out. ``write`` keeps the counts."""
    counts = write(value_counts(rows, x, keys), "value-counts")
    most = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    found = _by_windows(counts, points, keys) if most <= few else _by_digits(counts, points, keys)
    values = found.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def point(p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = (F.element_at("at", k.cast("long")) for k in (F.floor(at), F.ceil(at)))
        return low + (high - low) * (at - F.floor(at))

    return values.where("n is not null").select(*keys, F.array(*map(point, points)).alias("q"))


def _ranks(n: Column, points: Sequence[float]) -> Column:
    """The order statistics (from 0) that the points lie between."""
    at = [(n - 1) * F.lit(float(p)) for p in points]
    return F.array_distinct(F.array(*(f(a).cast("long") for a in at for f in (F.floor, F.ceil))))


def _holding(ranks: Column, below: Column, c: Column) -> Column:
    return F.filter(ranks, lambda r: (below <= r) & (r < below + c))


def _by_windows(counts: DataFrame, points: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """keys, n, rank and v, from one running count."""
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    below = F.sum("c").over(group.orderBy("v")) - F.col("c")
    placed = counts.select(*keys, "v", "c", below.alias("below"), F.sum("c").over(group).alias("n"))
    return placed.select(*keys, "n", F.explode(_holding(_ranks(F.col("n"), points), F.col("below"), F.col("c"))).alias("rank"), "v")


def _by_digits(counts: DataFrame, points: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """The same by four passes over the counts. ``wanted``: of each prefix the ranks sought, as in the group and within it."""
    coded = counts.withColumn("bits", ordered_bits("v"))
    prefix = lambda k: F.shiftright("bits", 64 - DIGIT * k)
    wanted: DataFrame | None = None
    for k in range(1, DIGITS + 1):
        digits = coded.withColumn("p", prefix(k))
        if wanted is None:
            sums = digits.groupBy(*keys, "p").agg(F.sum("c").alias("c"), F.max("v").alias("v"))
            group = Window.partitionBy(*(keys or [F.lit(0)]))
            sums = sums.withColumn("n", F.sum("c").over(group))
            sums = sums.withColumn("ranks", F.transform(_ranks(F.col("n"), points), lambda r: F.struct(r.alias("rank"), r.alias("left"))))
        else:
            a, b = digits.withColumn("q", prefix(k - 1)).alias("a"), wanted.alias("b")
            same = F.col("a.q") == F.col("b.p")
            for c in keys:
                same = same & F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
            met = a.join(b, same).select(*(F.col(f"a.`{c}`").alias(c) for c in keys), "a.p", "a.q", "a.c", "a.v", "b.n", "b.ranks")
            sums = met.groupBy(*keys, "q", "p", "n").agg(F.sum("c").alias("c"), F.max("v").alias("v"), F.first("ranks").alias("ranks"))
            group = Window.partitionBy(*keys, "q")
        sums = sums.withColumn("below", F.sum("c").over(group.orderBy("p")) - F.col("c"))
        inside = F.filter("ranks", lambda r: (F.col("below") <= r["left"]) & (r["left"] < F.col("below") + F.col("c")))
        inside = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - F.col("below")).alias("left")))
        wanted = sums.select(*keys, "p", "n", "v", inside.alias("ranks")).where(F.size("ranks") > 0)
    return wanted.select(*keys, "n", F.explode("ranks.rank").alias("rank"), "v")
