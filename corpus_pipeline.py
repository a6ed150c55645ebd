"""A training corpus in five stages, each on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import byte_bpe, decontaminate, line_dedup, quality, simhash_similar
from panelforge.llm.common import fold, fresh, materialize

#: The classifier and the line and near-duplicate stages can't be said in SQL.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled rows, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    score = fresh("__score", docs.columns)
    return quality.score(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose templates recur across documents."""
    return line_dedup.line_dedup(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of texts that share 0.8 or more of their 5-word shingles."""
    return simhash_similar.first_of_groups(docs, width=5, similarity=0.8)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark. Rows are told apart by id and text, so null and repeated ids do no harm."""
    key, row = F.xxhash64("doc_id", "text"), fresh("__row", docs.columns)
    hits = decontaminate.contained_items(docs.select(key.alias(row), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return docs.join(hits.select(row).distinct(), key == F.col(row), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
