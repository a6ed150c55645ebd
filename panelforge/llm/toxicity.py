"""Toxicity by a factorization machine over hashed terms.

A document is the set of its terms: hashed words and beginnings of longer words. The terms that are learned carry
a weight and a factor vector each; the score is a logistic function of the weights' sum and of all pairwise
products of factors, so that two terms that mean something only together are learned as such. Trained in numpy by
Adagrad.

Learned are terms of ``LEAST_DOCS`` sampled documents or more whose document frequencies differ between the labels
(by the z-score of their log odds) or that label 1 has alone, at most ``MAX_TERMS``, and the most frequent terms,
which may matter in pairs alone: ``FREQUENT``, or a quarter of the rarer label's documents where that is less. Spark
counts the terms; the driver gets the chosen ones and the documents' places among them.

Fitting uses a sample of ``limit`` labelled rows, a parameter (see ``samples``); scoring covers all rows and whole
texts in one pass without a shuffle. Null and empty texts get the score of a text without known terms. Nothing
to learn from gives score 0. Rows with null ids are scored but not learned from; repeated rows are learned from
once and scored each for itself; other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, texts_of
from panelforge.llm.samples import labelled_ids, texts_with_labels

HASH_BITS = 22
LIMIT = 20_000
FACTORS = 8
#: Letters of a word's beginning that is a term of its own.
STEM = 6
MAX_TERMS, FREQUENT = 16_384, 256
LEAST_DOCS, LEAST_Z = 3, 2.5
#: Steps of training at least, so that small samples take more epochs.
STEPS = 2000
BATCH = 128
WORDS = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 500_000


def term(word: str) -> int:
    return crc32(word.encode("utf-8", "replace")) >> (32 - HASH_BITS)


def word_terms(word: str) -> tuple[int, ...]:
    return (term(word), term(f"^{word[:STEM]}")) if len(word) > STEM else (term(word),)


def terms_of(text: str) -> set[int]:
    return {t for w in set(WORDS.findall(text.lower())) for t in word_terms(w)}


@dataclass
class FactorizationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    index: dict[int, int]  # term -> row of weights and factors

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, row in enumerate(rows):
            v = self.factors[row]
            out[i] = self.bias + self.weights[row].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def choose_terms(counts: DataFrame, on: int, off: int, max_terms: int = MAX_TERMS, least_docs: int = LEAST_DOCS) -> list[int]:
    """The terms to learn, from ``term``, ``on`` and ``off`` (documents with it of either label) and all documents' labels."""
    counts = counts.where(F.col("on") + F.col("off") >= least_docs).withColumn("n", F.col("on") + F.col("off"))

    def part(n: str, total: int) -> tuple[Column, Column]:
        has, lacks = F.col(n) + 0.5, F.lit(total + 0.5) - F.col(n)
        return F.log(has / lacks), 1 / has + 1 / lacks

    (log_on, var_on), (log_off, var_off) = part("on", on), part("off", off)
    ranked = counts.withColumn("z", F.abs((log_on - log_off) / F.sqrt(var_on + var_off)))
    apart = ranked.where((F.col("z") >= LEAST_Z) | (F.col("off") == 0)).orderBy(F.desc("z"), "term").limit(max_terms)
    frequent = counts.orderBy(F.desc("n"), "term").limit(min(FREQUENT, min(on, off) // 4))
    return sorted({r.term for part in (apart, frequent) for r in part.select("term").collect()})


def _add_at(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by their numbers."""
    return np.stack([np.bincount(at, weights=column, minlength=n) for column in values.T], axis=1)


def train(rows: list[np.ndarray], terms: list[int], y: np.ndarray, epochs: int = 12, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """``rows``: numbers of each document's terms in ``terms``; ``y``: 0 or 1."""
    rng = np.random.default_rng(seed)
    n, bias = len(terms), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    w, v = np.zeros(n), rng.normal(0, 0.02, (n, FACTORS))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    for _ in range(max(epochs, STEPS * BATCH // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            flat = np.concatenate([rows[i] for i in part]).astype(np.int64)
            sample = np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            vx = v[flat]
            total, own = _add_at(sample, vx, len(part)), _add_at(sample, vx * vx, len(part))
            z = bias + np.bincount(sample, weights=w[flat], minlength=len(part)) + 0.5 * (total**2 - own).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            dw = np.bincount(flat, weights=error[sample], minlength=n) / len(part) + l2 * w
            dv = _add_at(flat, error[sample, None] * (total[sample] - vx), n) / len(part) + l2 * v
            db = error.mean()
            gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
            w, v, bias = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), bias - rate * db / np.sqrt(gb)
    return FactorizationMachine(bias, w, v, {t: i for i, t in enumerate(terms)})


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> FactorizationMachine | None:
    """Learn from a bounded sample of labelled rows; None unless it holds both labels and a term of some documents."""
    sample = texts_with_labels(docs, labelled_ids(labels, label_col, limit, id_col), id_col, text_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(terms_of(t)) for t in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(terms, pa.list_(pa.int32()))], names=["id", "y", "terms"])

    kind = sample.schema["__id"].dataType.simpleString()
    coded = materialize(sample.select("__id", "__label", "__text").mapInArrow(hashed, f"id {kind}, y int, terms array<int>"), "toxicity-terms")
    on, off = (x or 0 for x in coded.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first())
    if not on or not off:
        return None
    each = coded.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.sum("y").alias("on"), F.sum(1 - F.col("y")).alias("off"))
    terms = choose_terms(materialize(each, "term-counts"), on, off)
    if not terms:
        return None
    known = np.array(terms, dtype=np.int32)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.flatnonzero(np.isin(known, row)).astype("<u2" if len(known) <= 1 << 16 else "<u4").tobytes() for row in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary())], names=["id", "y", "terms"])

    rows = coded.mapInArrow(placed, f"id {kind}, y int, terms binary").collect()
    rows.sort(key=lambda r: r.id)
    y = np.array([r.y for r in rows], dtype=float)
    return train([np.frombuffer(r.terms, "<u2" if len(known) <= 1 << 16 else "<u4") for r in rows], terms, y)


class _Known(dict):
    """Word -> rows of the model; emptied when it is full."""

    def __init__(self, index: dict[int, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = rows = tuple(self.index[t] for t in word_terms(word) if t in self.index)
        return rows


def score(docs: DataFrame, model: FactorizationMachine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score (0 to 1) of every row."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = _Known(model.index if model else {})
        for batch in batches:
            found = [np.array(sorted(set(chain.from_iterable(map(known.__getitem__, WORDS.findall(t.lower()))))), dtype=np.int64) for t in texts_of(batch.column(1))]
            scores = model.score(found) if model else np.zeros(len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=[id_col, "score"])

    return rows.mapInArrow(scored, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")
