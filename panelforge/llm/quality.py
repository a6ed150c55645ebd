"""Quality by Bradley-Terry pairwise ranking.

Each preference pair is a document labelled 1 and one labelled 0; the difference of their features,
times the weights, is the log odds that the first is preferred (logistic loss). Features are shares and
rates of a text's characters, words and lines, each coded by the training quantiles it exceeds. What
results is a score on one scale; the threshold is the quantile of the training scores that splits them
as the labels do, and the score given is the logistic function of the distance to it.

Fitting covers every labelled row and every pair of rows with different labels. Quantiles and threshold are the exact
ones of all rows. The loss of all pairs comes from two histograms of scores, each row dealt between the two nearest of
``BINS`` places, so a Newton step is two scans of the features, which are written once; tasks hand on sums only.

Scoring covers all rows and whole texts in one pass without a shuffle. Null texts count as empty; empty texts
get the score of their features (zeros). Nothing to learn from gives score 1. Rows with null ids are scored but not
learned from; repeated rows are learned from once and scored each for itself. An id with several labels takes the
largest, one with several texts that of the smallest hash. Other columns may have any names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, texts_of
from panelforge.llm.samples import labels_of
from panelforge.operators.quantiles import quantiles
from panelforge.operators.sums import added_up

#: Places of the histograms of scores, and ranges of places whose rows share a curvature.
BINS, RANGES = 4096, 64
QUANTILES = np.arange(0.05, 1, 0.1)
#: Bytes by kind: 0 upper case, 1 lower case, 2 digit, 3 space, 4 line end, 5 sentence mark, 6 other
#: printable, 7 control, 8 part of a longer character.
_KIND = np.full(256, 8, dtype=np.uint8)
_KIND[:128] = 7
_KIND[33:127] = 6
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[32], _KIND[10] = 0, 1, 2, 3, 4
_KIND[[ord(c) for c in ".,;:'\"!?()-"]] = 5
N_FEATURES = 24


def features(text: str) -> np.ndarray:
    """Shares and rates of a whole text."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    out = np.zeros(N_FEATURES)
    if not words:
        return out
    raw = np.frombuffer(data, dtype=np.uint8)
    kinds = _KIND[raw]
    n, n_words = len(data), len(words)
    out[:9] = np.bincount(kinds, minlength=9) / n
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[9] = np.log1p(n_words)
    out[10] = lengths.mean()
    out[11] = lengths.std()
    out[12] = len(counts) / n_words
    out[13] = max(counts.values()) / n_words
    out[14] = sum(map(bytes.__eq__, words, words[1:])) / n_words
    out[15] = 1 - len(set(lines)) / len(lines)
    out[16] = n_words / len(lines)
    out[17] = data.count(b"|") / n_words
    out[18] = (data.count(b"!") + data.count(b"?")) / n_words
    # Printable marks and letters that repeat: "###", "$$$", "!!", "aaaa".
    same = raw[1:] == raw[:-1]
    out[19] = (same & (kinds[1:] == 6)).sum() / n_words
    out[20] = (same[1:] & same[:-1]).sum() / n
    out[21] = (kinds[np.minimum(np.cumsum(lengths + 1) - 2, n - 1)] == 6).mean()
    out[22] = data.count(b"http") / n_words
    p = np.bincount(raw, minlength=256) / n
    out[23] = -(p[p > 0] * np.log(p[p > 0])).sum()
    return out


@dataclass
class RankingModel:
    cuts: np.ndarray  # features x quantiles
    weights: np.ndarray
    threshold: float
    scale: float

    def coded(self, x: np.ndarray) -> np.ndarray:
        return (x[:, :, None] > self.cuts[None]).reshape(len(x), -1).astype(float)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.coded(x) @ self.weights - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _over_pairs(shares: np.ndarray, width: float) -> tuple[float, np.ndarray]:
    """Mean loss of all pairs, from the shares of rows labelled 0 and 1 at places ``width`` apart; and what the pairs of a row at each place lack on average."""
    n = shares.shape[1]
    apart = width * np.arange(1 - n, n)
    over = lambda share, of: np.convolve(share, of)[n - 1 : 2 * n - 1]
    lacking = np.exp(-np.logaddexp(0, apart))
    # ``apart`` is a place less that of the other label's row: good less bad, then bad less good.
    loss = shares[1] @ over(shares[0], np.logaddexp(0, -apart))
    return float(loss), np.stack([over(shares[1], lacking[::-1]), over(shares[0], lacking)])


def train(rows: DataFrame, cuts: np.ndarray, totals: np.ndarray, rounds: int = 50, l2: float = 1e-3) -> np.ndarray:
    """The weights of least mean loss over all pairs of ``rows`` (``__label``, ``__x``); ``totals``: how many are labelled 0 and 1.

    Newton steps. The curvature of a pair is that of the middles of its rows' ranges of places.
    """
    model, d = RankingModel(cuts, np.zeros(cuts.size), 0.0, 1.0), cuts.size

    def placed(batch: pa.RecordBatch, weights: np.ndarray, low: float, width: float) -> tuple[np.ndarray, ...]:
        """Labels and coded features; of each row's score the place below it and the part of the way to the next."""
        y, coded = batch.column(0).to_numpy(), model.coded(_vectors(batch.column(1)))
        at = np.clip((coded @ weights - low) / width, 0, BINS - 1)
        down = np.minimum(at.astype(np.int64), BINS - 2)
        return y, coded, down, at - down

    def scores(weights: np.ndarray) -> tuple[float, float, np.ndarray]:
        """Where the places begin and how far apart they are; shares of rows there, dealt between two places and by the lower one alone."""
        # Codes are nested: of a feature, a row has a sum of its first weights.
        sums = np.cumsum(weights.reshape(cuts.shape), axis=1)
        low, high = np.minimum(sums.min(axis=1), 0).sum(), np.maximum(sums.max(axis=1), 0).sum()
        width = max(high - low, 1e-6) / (BINS - 1)

        def counted(batch: pa.RecordBatch) -> np.ndarray:
            y, _, down, part = placed(batch, weights, low, width)
            cell = y * BINS + down
            dealt = np.bincount(cell, 1 - part, 2 * BINS) + np.bincount(cell + 1, part, 2 * BINS)
            return np.r_[dealt, np.bincount(cell, minlength=2 * BINS)].reshape(4, BINS)

        return low, width, added_up(rows, counted, 4) / np.r_[totals, totals][:, None]

    def derivatives(weights: np.ndarray, low: float, width: float, shares: np.ndarray, lacking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        used = np.flatnonzero(shares[2:].any(axis=0))
        size = -(-(used[-1] - used[0] + 1) // RANGES)
        of = np.clip((np.arange(BINS) - used[0]) // size, 0, RANGES - 1)
        odds = np.exp(-width * size * np.abs(np.subtract.outer(np.arange(RANGES), np.arange(RANGES))))
        curve = odds / (1 + odds) ** 2
        # Of a row labelled 0 over those labelled 1, and the other way.
        curvature = (np.stack([np.bincount(of, s, RANGES) for s in shares[2:]]) @ curve)[::-1]

        def summed(batch: pa.RecordBatch) -> np.ndarray:
            y, coded, down, part = placed(batch, weights, low, width)
            pull = (lacking[y, down] * (1 - part) + lacking[y, down + 1] * part) / totals[y] * np.where(y == 1, -1, 1)
            inside = np.zeros((2 * RANGES, len(y)))
            inside[y * RANGES + of[down], np.arange(len(y))] = 1 / totals[y]
            return np.concatenate([(pull @ coded)[None], (coded * (curvature[y, of[down]] / totals[y])[:, None]).T @ coded, inside @ coded])

        found = added_up(rows, summed, 1 + d + 2 * RANGES)
        bad, good = found[1 + d :].reshape(2, RANGES, d)
        cross = good.T @ curve @ bad
        return found[0], found[1 : 1 + d] - cross - cross.T

    weights = np.zeros(d)
    low, width, shares = scores(weights)
    loss, lacking = _over_pairs(shares[:2], width)
    for _ in range(rounds):
        gradient, hessian = derivatives(weights, low, width, shares, lacking)
        gradient = gradient + l2 * weights
        step = np.linalg.solve(hessian + l2 * np.eye(d), gradient)
        if gradient @ step < 1e-8:
            break
        for _ in range(20):
            low, width, shares = scores(weights - step)
            less, lacking = _over_pairs(shares[:2], width)
            less += l2 / 2 * (weights - step) @ (weights - step)
            if less < loss:
                break
            step = step / 2
        else:
            break
        weights, loss = weights - step, less
    return weights


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def labelled_features(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``__label`` and ``__x`` of every labelled id, one row each. Features are measured where the texts lie, so no text is shuffled."""
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__hash"), F.col(text_col).alias("__text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in texts_of(batch.column(2))]).reshape(batch.num_rows, N_FEATURES)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * N_FEATURES, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lists], names=["__id", "__hash", "__x"])

    kind = named.schema["__id"].dataType.simpleString()
    rows = named.mapInArrow(measured, f"__id {kind}, __hash long, __x array<double>").join(labels_of(labels, label_col, id_col), "__id")
    return rows.groupBy("__id").agg(F.max("__label").alias("__label"), F.min_by("__x", "__hash").alias("__x")).select("__label", "__x")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> RankingModel | None:
    """Learn from all labelled rows; None unless they hold both labels."""
    rows = materialize(labelled_features(docs, labels, label_col, id_col, text_col), "quality-features")
    totals = np.array(rows.agg(F.count_if(F.col("__label") == 0), F.count_if(F.col("__label") == 1)).first())
    if not totals.all():
        return None
    values = rows.select(F.posexplode("__x").alias("__i", "__v"))
    found = quantiles(values, "__v", QUANTILES.tolist(), ["__i"], write=materialize).collect()
    model = RankingModel(np.array([r.q for r in sorted(found, key=lambda r: r["__i"])]), np.zeros(0), 0.0, 1.0)
    model.weights = train(rows, model.cuts, totals)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.coded(_vectors(batch.column(1))) @ model.weights)], names=["s"])

    raw = materialize(rows.mapInArrow(scored, "s double"), "quality-scores")
    # As many training scores fall below the threshold as there are labels 0.
    model.threshold = float(quantiles(raw, "s", [totals[0] / totals.sum()], few=1000, write=materialize).first().q[0])
    model.scale = float(raw.agg(F.stddev_pop("s")).first()[0] or 1.0) / 2
    return model


def score(docs: DataFrame, model: RankingModel | None, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``score_col`` (0 to 1) of every row; a column of that name gives way to it."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != score_col.lower()]
    # By number on the way through Python, which takes no names with dots.
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), F.col(f"`{text_col}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = texts_of(batch.column(batch.num_columns - 1))
            scores = np.ones(len(texts))
            for at in range(0, len(texts) if model else 0, 1024):
                scores[at : at + 1024] = model.score(np.stack([features(t) for t in texts[at : at + 1024]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double"])
    return rows.mapInArrow(scored, fields).toDF(*kept, score_col)
