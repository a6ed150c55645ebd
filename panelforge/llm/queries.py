"""The registered queries of this package's operators, and their SQL where SQL can express them."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import byte_bpe, conversations, decontaminate, exact_dedup, language, licenses, line_dedup, lm, merkle, oracles, quality, simhash, token_files, toxicity
from panelforge.llm.common import fold

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    coded = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN), BYTE_RANKS)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        byte_bpe.ids_sha256(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = language.predict(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return _labelled(toxicity.score(docs, model), fold(F.col("doc_id"), 5) == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return _labelled(quality.score(docs, model, keep=["doc_id"]), fold(F.col("doc_id"), 3) == 1)


def _labelled(scored: DataFrame, held_out: F.Column) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_index(_table(spark, sf_dir, "documents"), WORD_BPE, END_ID)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.summed(licenses.scan(_table(spark, sf_dir, "documents")))
    phrases = (F.col("phrases"), [label for _, label in licenses.PHRASES])
    templates = (F.col("templates"), [label for label, _ in licenses.TEMPLATES])
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.col("n_places").alias("n_base"),
        F.col("first_place").alias("first_word"),
        F.col("last_place").alias("last_word"),
        licenses.label_text([phrases]).alias("base_labels"),
        licenses.label_text([phrases, templates]).alias("labels"),
        F.when(F.col("n_places") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(fold(F.col("doc_id"), 5) == 0, lowered).otherwise(F.col("text"))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), changed={"text": tampered})
    folded = merkle.folded(F.col("changed_leaf"), F.col("path"))
    return found.select(
        "doc_id",
        *(merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")),
        F.sha2(merkle.proof_text(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == merkle.hexed(F.col("root"))).alias("verified"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_simhash_near_dedup,
        op3_benchmark_decontamination,
        op4_exact_dedup,
        op5_language_id,
        op6_toxicity,
        op7_quality,
        op8_line_dedup,
        op9_token_files,
        op10_lm_scoring,
        op11_license_scan,
        op12_merkle_manifest,
        op13_conversation_trie,
    )
}

ORACLE_SQL = {
    "op3_benchmark_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM d WHERE len(w) > 0
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM b WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared, count(*) / n_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING count(*) >= 0.8 * n_shingles""",
    "op4_exact_dedup": r"""
WITH h AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, text_sha256
FROM h WINDOW same AS (PARTITION BY text_sha256)""",
    "op11_license_scan": oracles.license_scan(),
    "op12_merkle_manifest": oracles.merkle_manifest(),
    "op13_conversation_trie": oracles.conversation_trie(),
}
