"""Exact dedup with a heavy-hitter split, in DataFrame functions alone.

1. Each row's normalised text becomes its SHA-256 digest; ids and digests are written once.
2. Frequent digests: a Misra-Gries family sketch (``approx_top_k``) for each of a fixed number of
   digest buckets. The sketches are built map-side; a digest of more than 3.5 / ``tracked`` of its
   bucket's rows is always among those found.
3. What the sketches name is verified: exact counts and smallest ids, at most ``buckets * per_bucket``
   rows, however large the input is.
4. These winners are broadcast, so rows of a frequent digest are resolved where they are and never
   shuffled. All other digests take an ordinary shuffle: partial counts and smallest ids of each digest, joined
   back to its rows, so no group is held in memory.

Nulls: a null text counts as empty, empty texts are equal to one another. The row with the smallest
id stays; a null id stays only in a group that has no other, and rows that share the staying id are
all marked kept, being the same document. Empty tables give empty results. Only the id and the text
are read, so extra columns of any name don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import SPACE, materialize


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def heavy_digests(rows: DataFrame, buckets: int, per_bucket: int, tracked: int) -> DataFrame:
    """The frequent digests with exact ``__size`` and ``__keep``, at most ``buckets * per_bucket`` rows."""
    sketch = F.expr(f"approx_top_k(__digest, {per_bucket}, {tracked})")
    named = (
        rows.groupBy(F.pmod(F.xxhash64("__digest"), F.lit(buckets)).alias("__bucket"))
        .agg(sketch.alias("__top"))
        .select(F.explode("__top").alias("__top"))
        .where("__top.count > 1")
        .select(F.col("__top.item").alias("__digest"))
    )
    return rows.join(F.broadcast(named), "__digest").groupBy("__digest").agg(F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__keep"))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64, per_bucket: int = 100, tracked: int = 512
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    digest = F.sha2(normalised(F.col(text_col)).cast("binary"), 256)
    rows = materialize(docs.select(F.col(id_col).alias("__id"), digest.alias("__digest")), "digests")
    heavy = materialize(heavy_digests(rows, buckets, per_bucket, tracked), "heavy-digests")
    marked = rows.join(F.broadcast(heavy), "__digest", "left")
    rest = marked.where("__size is null").select("__digest", "__id")
    groups = rest.groupBy("__digest").agg(F.count(F.lit(1)).alias("__size"), F.min("__id").alias("__keep"))
    rest = rest.join(groups, "__digest")
    both = marked.where("__size is not null").select("__digest", "__id", "__size", "__keep").unionByName(rest)
    return both.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )
