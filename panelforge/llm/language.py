"""Language identification by nearest centroid.

Features are hashed character n-grams (1 to 3, in lower case) with sublinear term frequency, inverse
document frequency and unit length. Each language has several centroids, found by spherical k-means
among its own rows; a text takes the language of the centroid of the largest cosine. A text further
from it than nearly all training rows of that language were from theirs is marked ``rejected``.

Fitting uses a sample of ``per_language`` rows of each language, a parameter (see ``samples``); scoring covers
all rows and whole texts in one pass without a shuffle.

A null text or one without letters is ``und`` with score 0, and so is everything when nothing could be
learned. Ties go to the language first in order. Rows without language or id are not learned from.
Repeated rows are learned from once and predicted each for itself; one id may come with several texts and
languages. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import texts_of
from panelforge.llm.samples import texts_per_group

DIM = 1 << 13
PER_LANGUAGE = 400
CENTROIDS = 3
UNKNOWN = "und"
#: Characters hashed at a time; counts add up, so whole texts are covered.
STEP = 1 << 20


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the text's hashed 1-, 2- and 3-grams of letters, with word borders as spaces."""
    counts = np.zeros(DIM, dtype=np.int64)
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")
    # Runs of ASCII that is no letter count as one space.
    codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    for at in range(0, max(1, len(codes) - 2), STEP):
        c = codes[at : at + STEP + 2].astype(np.uint32)
        one = c[:-2] * np.uint32(0x9E3779B1)
        two = (one ^ c[1:-1]) * np.uint32(0x85EBCA6B)
        three = (two ^ c[2:]) * np.uint32(0xC2B2AE35)
        for grams in (one, two, three):
            counts += np.bincount(grams >> np.uint32(32 - 13), minlength=DIM)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]  # of each centroid
    least: np.ndarray  # cosine below which a text is rejected, of each centroid

    def vectors(self, texts: list[str]) -> np.ndarray:
        return unit(np.log1p(np.stack([ngram_counts(t) for t in texts]).astype(np.float32)) * self.idf)

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and cosine of each text."""
        cosines = self.vectors(texts) @ self.centroids.T
        return cosines.argmax(axis=1), np.clip(cosines.max(axis=1), 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def k_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; each next start is the row furthest from the ones before."""
    starts = [unit(rows.sum(axis=0, keepdims=True))[0]]
    starts = [rows[(rows @ starts[0]).argmax()]]
    while len(starts) < min(k, len(rows)):
        starts.append(rows[(rows @ np.stack(starts).T).max(axis=1).argmin()])
    centroids = np.stack(starts)
    for _ in range(rounds):
        of = (rows @ centroids.T).argmax(axis=1)
        sums = np.stack([rows[of == i].sum(axis=0) if (of == i).any() else centroids[i] for i in range(len(centroids))])
        centroids = unit(sums)
    return centroids


def fit(docs: DataFrame, lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel | None:
    """Learn from a bounded sample of ``docs``; None if it holds no row with letters and a language."""
    sample = texts_per_group(docs, lang_col, per_language, id_col, text_col)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if has_letter(text):
                    counts = ngram_counts(text)
                    used = np.flatnonzero(counts)
                    columns = [pa.array([lang]), pa.array([used.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[used]], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "used", "n"])

    found = sorted(sample.select("__label", "__text").mapInArrow(counted, "lang string, used array<int>, n array<long>").collect())
    if not found:
        return None
    tf = np.zeros((len(found), DIM), dtype=np.float32)
    for row, (_, used, n) in zip(tf, found, strict=True):
        row[used] = np.log1p(n)
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))).astype(np.float32) + 1
    x, of = unit(tf * idf), np.array([r.lang for r in found])
    all_centroids, langs, least = [], [], []
    for lang in sorted({r.lang for r in found}):
        own = x[of == lang]
        c = k_means(own, centroids)
        all_centroids.append(c)
        langs += [lang] * len(c)
        least += [float(np.quantile((own @ c.T).max(axis=1), 0.01))] * len(c)
    return LanguageModel(idf, np.concatenate(all_centroids), langs, np.array(least))


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected of every row."""
    rows = docs.select(F.col(id_col), F.col(text_col))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = texts_of(batch.column(1))
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            known = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for at in range(0, len(known), 256):
                part = known[at : at + 256]
                nearest, cosine = model.nearest([texts[i] for i in part])
                score[part], rejected[part] = cosine, cosine < model.least[nearest]
                for i, c in zip(part, nearest.tolist(), strict=True):
                    lang[i] = model.langs[c]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(rejected)], names=[id_col, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(scored, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
