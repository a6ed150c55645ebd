"""Bounded samples of labelled rows for fitting classifiers.

Rows are taken in an order that only their ids and texts decide, so a sample is the same on every run. Of a
group of n rows the first ``limit`` / n of that order are taken, so a sample has ``limit`` rows in expectation
(within five standard deviations, and exactly all rows of a smaller group), and no task ranks a group.

Null ids and labels are left out. Repeated rows count once. An id with several labels takes the largest, one
with several texts the smallest text. Empty tables give empty samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(*columns: Column) -> Column:
    """A number from 0 to 1 that is the same on every run."""
    return F.pmod(F.xxhash64(*columns, F.lit("sample")), F.lit(1 << 32)) / float(1 << 32)


def labels_of(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``__id`` and ``__label`` (0 or 1) of all ids."""
    each = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return each.groupBy(F.col(id_col).alias("__id")).agg((F.max(label_col).cast("int") > 0).cast("int").alias("__label"))


def labelled_ids(labels: DataFrame, label_col: str, limit: int, id_col: str = "doc_id") -> DataFrame:
    """``__id`` and ``__label`` (0 or 1) of ``limit`` ids: half of each label, or more of one where the other has fewer."""
    each = labels_of(labels, label_col, id_col)
    on, off = (x or 0 for x in each.agg(F.count_if(F.col("__label") == 1), F.count_if(F.col("__label") == 0)).first())
    take_on = min(on, max(limit // 2, limit - off))
    take_off = min(off, limit - take_on)
    quota = F.when(F.col("__label") == 1, F.lit(take_on / max(on, 1))).otherwise(F.lit(take_off / max(off, 1)))
    return each.where(place(F.col("__id").cast("string")) < quota)


def texts_with_labels(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__id``, ``__label`` and ``__text`` of the sampled ids, one row each; ``ids`` is bounded by its sample, so it is broadcast."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(ids), "__id")
    return rows.groupBy("__id", "__label").agg(F.min("__text").alias("__text"))


def texts_per_group(docs: DataFrame, group_col: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__label`` and ``__text`` of ``limit`` distinct rows of each group."""
    named = docs.where(F.col(id_col).isNotNull() & F.col(group_col).isNotNull())
    named = named.select(F.col(id_col).cast("string").alias("__id"), F.col(group_col).cast("string").alias("__label"), F.col(text_col).alias("__text"))
    key = ["__id", "__label", "__hash"]
    named = named.withColumn("__hash", F.xxhash64("__text"))
    rows = named.select(*key).distinct()
    counts = rows.groupBy("__label").agg(F.count(F.lit(1)).alias("__n"))
    kept = rows.join(counts, "__label").where(place(F.col("__id"), F.col("__hash")) * F.col("__n") < limit).drop("__n")
    return named.join(F.broadcast(kept), key).groupBy(*key).agg(F.min("__text").alias("__text")).select("__label", "__text")
