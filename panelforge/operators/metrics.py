"""Exact evaluation metrics as aggregates, for any number of groups at once.

``keys`` are the columns that name a group (none: one group). Rank metrics first count labels by
distinct score, so ties cost nothing and what is ordered is no longer than the distinct scores. For one
group with very many of them, the cumulative sums run over ranges of scores in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.operators.quantiles import quantiles
from panelforge.sources import sinks

#: Distinct scores of a range within which a window sums up, and the ranges at most (their borders are constants of a plan).
RANGE_ROWS, MOST_RANGES = 250_000, 4096


def _columns(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def score_counts(rows: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at each distinct score; rows without score or label are left out."""
    used = rows.where(F.col(y).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    positive = (F.col(y).cast("int") == 1).cast("long")
    return used.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def cumulative(rows: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """For each distinct score, from the highest: pos, neg, and ``tp``, ``fp`` at or above it, with the totals.

    The counts are written once. Scores are cut into ranges of some ``RANGE_ROWS`` distinct scores by approximate
    quantiles. Windows run within a range of a group; the sums of the ranges above are added by a join.
    """
    counts = sinks.written(score_counts(rows, y, score, keys), "score-counts")
    parts = min(MOST_RANGES, 1 + counts.count() // RANGE_ROWS)
    cuts = counts.agg(F.percentile_approx("score", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    counts = counts.withColumn("__range", F.size(F.filter(F.lit(cuts or []).cast("array<double>"), lambda c: c <= F.col("score"))))
    own = Window.partitionBy(*keys, "__range").orderBy(F.desc("score"))
    sums = counts.groupBy(*keys, "__range").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    above = Window.partitionBy(*keys).orderBy(F.desc("__range"))
    group = Window.partitionBy(*keys)
    sums = sums.select(
        *keys,
        "__range",
        (F.sum("__p").over(above) - F.col("__p")).alias("__p_above"),
        (F.sum("__n").over(above) - F.col("__n")).alias("__n_above"),
        F.sum("__p").over(group).alias("all_pos"),
        F.sum("__n").over(group).alias("all_neg"),
    )
    inside = counts.withColumns({"__tp": F.sum("pos").over(own), "__fp": F.sum("neg").over(own)})
    return inside.join(sums, [*keys, "__range"]).select(
        *keys,
        "score",
        "pos",
        "neg",
        (F.col("__tp") + F.col("__p_above")).alias("tp"),
        (F.col("__fp") + F.col("__n_above")).alias("fp"),
        "all_pos",
        "all_neg",
    )


def binary_scores(rows: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """roc_auc, average_precision and brier of each group from one count of its scores."""
    above = cumulative(rows, y, score, keys)
    wins = F.sum(F.col("pos") * ((F.col("all_neg") - F.col("fp")) + F.col("neg") / 2))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    p = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return above.groupBy(*keys).agg(
        F.try_divide(wins, F.max(F.col("all_pos").cast("double") * F.col("all_neg"))).alias("roc_auc"),
        F.try_divide(steps, F.max("all_pos")).alias("average_precision"),
        (F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p) / F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
    )


def roc_auc(rows: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, tied scores counting half; null with one label only."""
    above = cumulative(rows, y, score, keys)
    wins = F.sum(F.col("pos") * ((F.col("all_neg") - F.col("fp")) + F.col("neg") / 2))
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return above.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("roc_auc"))


def average_precision(rows: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Precision at each score weighted by the recall gained there (step form)."""
    above = cumulative(rows, y, score, keys)
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return above.groupBy(*keys).agg(F.try_divide(steps, F.max("all_pos")).alias("average_precision"))


def best_f1(rows: DataFrame, y: str = "y", score: str = "score", keys: Sequence[str] = (), grid: int = 120, ties: str = "small", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The threshold, among a grid of the scores' quantiles from ``low`` to ``high``, of the largest F1.

    ``ties``: whether the smallest or the largest such threshold wins.
    """
    counts = score_counts(rows, y, score, keys)
    cuts = quantiles(rows, score, [low + (high - low) * i / (grid - 1) for i in range(grid)], keys).select(*keys, F.array_sort(F.array_distinct("q")).alias("cuts"))
    joined = counts.join(cuts, list(keys)) if keys else counts.crossJoin(cuts)
    # Counts between neighbouring cuts, at most ``grid`` rows a group, then their sums from above.
    at = F.size(F.filter("cuts", lambda c: c <= F.col("score")))
    sums = joined.withColumn("__at", at).where(F.col("__at") > 0).groupBy(*keys, "__at").agg(F.element_at(F.first("cuts"), F.col("__at")).alias("threshold"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    over = Window.partitionBy(*keys).orderBy(F.desc("__at"))
    sums = sums.withColumns({"tp": F.sum("pos").over(over), "fp": F.sum("neg").over(over), "p": F.sum("pos").over(Window.partitionBy(*keys))})
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("p")), F.lit(0.0))
    order = F.struct(f1, -F.col("threshold") if ties == "small" else F.col("threshold"))
    return sums.groupBy(*keys).agg(F.max_by("threshold", order).alias("threshold"), F.max(f1).alias("f1"))


def confusion(rows: DataFrame, y: str = "y", predicted: str = "predicted", keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, and the rates made of them; a rate without cases is 0."""
    a, p = F.col(y).cast("int") == 1, F.col(predicted).cast("int") == 1
    counted = rows.where(F.col(y).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys)
    sums = counted.agg(*(F.count_if(c).alias(n) for n, c in (("tp", a & p), ("fp", ~a & p), ("fn", a & ~p), ("tn", ~a & ~p))))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    rate = lambda x, of: F.coalesce(F.try_divide(x, of), F.lit(0.0))
    n = tp + fp + fn + tn
    return sums.withColumns(
        {
            "precision": rate(tp, tp + fp),
            "recall": rate(tp, tp + fn),
            "f1": rate(2 * tp, 2 * tp + fp + fn),
            "accuracy": rate(tp + tn, n),
            "alert_rate": rate(tp + fp, n),
            "specificity": rate(tn, tn + fp),
            "naive_accuracy": rate(F.greatest(tp + fn, fp + tn), n),
        }
    )


def self_score(rows: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    """What a scored table with labels says of its own scores: counts, rates, and rank metrics where both labels occur.

    A label that is not a number counts as 0. Fails where the table has no label column.
    """
    if y not in rows.columns:
        raise ValueError(f"no column {y} to score by")
    used = rows.select(F.coalesce(F.col(y).cast("string").try_cast("double").cast("int"), F.lit(0)).alias("y"), F.col(p).alias("p"))
    marked = used.withColumn("predicted", (F.col("p") >= threshold).cast("int"))
    sums = used.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("failures"))
    return sums.crossJoin(confusion(marked)).crossJoin(binary_scores(used, score="p"))


def confusion_matrix(rows: DataFrame, y: str = "actual", predicted: str = "predicted", keys: Sequence[str] = ()) -> DataFrame:
    """Counts of every pair of labels that occur, zeros included."""
    counts = rows.groupBy(*keys, F.col(y).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    names = rows.select(F.col(y).cast("string").alias("name")).union(rows.select(F.col(predicted).cast("string"))).distinct()
    groups = rows.select(*keys).distinct() if keys else None
    grid = names.select(F.col("name").alias("actual")).crossJoin(names.select(F.col("name").alias("predicted")))
    grid = groups.crossJoin(grid) if groups is not None else grid
    return grid.join(counts, [*keys, "actual", "predicted"], "left").fillna(0, ["n"])


def macro_scores(rows: DataFrame, y: str = "actual", predicted: str = "predicted", keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and the mean F1 over all labels that occur."""
    a, p = F.col(y).cast("string"), F.col(predicted).cast("string")
    hit = (a == p).cast("long")
    each = rows.select(*keys, F.explode(F.array(F.struct(a.alias("label"), hit.alias("tp"), F.lit(1).alias("actual"), F.lit(0).alias("predicted")), F.struct(p.alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).alias("actual"), F.lit(1).alias("predicted")))).alias("x")).select(*keys, "x.*")
    sums = each.groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("actual") + F.col("predicted")), F.lit(0.0))
    return sums.groupBy(*keys).agg(F.avg(f1).alias("macro_f1"), (F.sum("tp") / F.sum("actual")).alias("accuracy"))


def regression_scores(rows: DataFrame, y: str = "y", predicted: str = "predicted", keys: Sequence[str] = ()) -> DataFrame:
    used = rows.where(F.col(y).isNotNull() & F.col(predicted).isNotNull())
    e = F.col(y) - F.col(predicted)
    spread = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(y)
    return used.groupBy(*keys).agg(
        (1 - F.try_divide(F.sum(e * e), spread)).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    )


def brier(rows: DataFrame, y: str = "y", score: str = "score", reference: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of probabilities (clipped to 0..1), and the skill against a reference forecast."""
    error = lambda p: F.avg(F.pow(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) - F.col(y), F.lit(2)))
    found = rows.groupBy(*keys).agg(error(score).alias("brier"), *([error(reference).alias("brier_reference")] if reference else []))
    return found.withColumn("skill", 1 - F.try_divide(F.col("brier"), F.col("brier_reference"))) if reference else found


def reliability(rows: DataFrame, edges: Sequence[float], y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Observed rate and mean probability in bins closed on the left; the last bin takes its upper edge in."""
    p, last = F.col(score), len(edges) - 2
    at = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        at = F.when((p >= edges[i]) & ((p < edges[i + 1]) | ((p == edges[i + 1]) & F.lit(i == last))), i).otherwise(at)
    return rows.withColumn("bin", at).where("bin is not null").groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("observed")
    )


def quantile_calibration(rows: DataFrame, bins: int = 6, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Bins between quantiles of the scores: a score is in the bin of as many inner edges as lie below it."""
    points = [i / bins for i in range(1, bins)]
    edges = quantiles(rows, score, points, keys).withColumnRenamed("q", "__edges")
    joined = rows.join(edges, list(keys)) if keys else rows.crossJoin(edges)
    at = F.size(F.filter("__edges", lambda e: e < F.col(score)))
    return joined.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("observed"))


def rate_curve(rows: DataFrame, x: str, low: float, step: float, bins: int, y: str = "y", least: int = 15, keys: Sequence[str] = ()) -> DataFrame:
    """Rate of ``y`` in equal bins closed on the right; the lowest edge is in none; bins of fewer rows are left out."""
    at = F.ceil((F.col(x) - low) / step).cast("int")
    used = rows.where((at >= 1) & (at <= bins))
    found = used.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"))
    return found.where(F.col("n") >= least).withColumn("middle", F.lit(low) + (F.col("bin") - 0.5) * step)


def alert_threshold(rows: DataFrame, rate: float, score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """The score above which the share ``rate`` of the rows lies."""
    return quantiles(rows, score, [1 - rate], keys).select(*keys, F.col("q")[0].alias("threshold"))


def cost_ratios(low: float = 0.005, high: float = 0.8, n: int = 40) -> list[float]:
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def value_curve(rows: DataFrame, ratios: Sequence[float] | None = None, y: str = "y", score: str = "score", keys: Sequence[str] = ()) -> DataFrame:
    """Relative economic value of acting when the score reaches the cost-loss ratio.

    0 is the better of acting always and never (also where nothing can be gained), 1 a perfect forecast. Ratios
    meet counts by score. The expenses are those of the forecast, of the better fixed choice and of a perfect one.
    """
    counts = score_counts(rows, y, score, keys)
    grid = F.explode(F.array(*(F.lit(float(r)) for r in (ratios or cost_ratios())))).alias("ratio")
    act = F.col("score") >= F.col("ratio")
    sums = counts.select("*", grid).groupBy(*keys, "ratio").agg(
        F.sum(F.when(act, (F.col("pos") + F.col("neg")) * F.col("ratio")).otherwise(F.col("pos"))).alias("spent"),
        F.sum("pos").alias("pos"),
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
    )
    rate = F.col("pos") / F.col("n")
    forecast, fixed, perfect = F.col("spent") / F.col("n"), F.least(F.col("ratio"), rate), rate * F.col("ratio")
    value = F.when(fixed > perfect, F.try_divide(fixed - forecast, fixed - perfect)).otherwise(0.0)
    return sums.select(*keys, "ratio", forecast.alias("expense"), fixed.alias("expense_fixed"), perfect.alias("expense_perfect"), value.alias("value"))


def peak_value(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    best = F.struct("value", -F.col("ratio"))
    return curve.where("value is not null").groupBy(*keys).agg(F.max("value").alias("value"), F.max_by("ratio", best).alias("ratio"))


def history_percentile(rows: DataFrame, peaks: DataFrame, score: str = "score", key: str = "site_id") -> DataFrame:
    """Share, in percent, of the key's own scores strictly below its ``peak``.

    Peaks take their place among the counted scores of their key, so no peak meets the scores one by one.
    """
    both = rows.select(key, F.col(score).cast("double").alias("__s"), F.lit(1).alias("__y")).unionByName(peaks.select(key, F.col("peak").cast("double").alias("__s"), F.lit(0).alias("__y")))
    placed = cumulative(both, "__y", "__s", [key]).where("neg > 0")
    return placed.select(key, F.col("score").alias("peak"), (F.try_divide(F.col("all_pos") - F.col("tp"), F.col("all_pos")) * 100).alias("percentile"))


def event_backtest(scored: DataFrame, events: DataFrame, days: int = 3, score: str = "score", key: str = "site_id", date: str = "date") -> DataFrame:
    """For each event: the peak score in the ``days`` before it, whether it was alerted, the first alert's lead.

    ``scored`` has ``threshold``; an event meets its days by equality, being exploded to their dates.
    """
    window = events.select(key, F.col("event_date"), F.explode(F.sequence(F.date_sub("event_date", days), F.date_sub("event_date", 1))).alias(date))
    joined = window.join(scored, [key, date], "left")
    alert = F.col(score) >= F.col("threshold")
    found = joined.groupBy(key, "event_date").agg(
        F.max(score).alias("peak"),
        F.coalesce(F.bool_or(alert), F.lit(False)).alias("alerted"),
        F.max(F.when(alert, F.datediff("event_date", date))).alias("lead_days"),
    )
    below = history_percentile(scored.select(key, score), found.select(key, "peak").where("peak is not null"), score, key)
    return found.join(below, [key, "peak"], "left").select(key, "event_date", "peak", "alerted", "lead_days", "percentile")


def lead_labels(panel: DataFrame, events: DataFrame, days: int = 7, key: str = "site_id", date: str = "date") -> DataFrame:
    """``days_to_event`` of days 1 to ``days`` before an event (the nearest), and ``y``."""
    window = events.select(key, "event_date", F.explode(F.sequence(F.date_sub("event_date", days), F.date_sub("event_date", 1))).alias(date))
    nearest = window.groupBy(key, date).agg(F.min(F.datediff("event_date", date)).alias("days_to_event"))
    return panel.join(nearest, [key, date], "left").withColumn("y", F.col("days_to_event").isNotNull().cast("int"))


def false_alerts_per_year(scored: DataFrame, y: str = "y", alert: str = "alert", keys: Sequence[str] = ()) -> DataFrame:
    """Alert days without an event for each 365.25 days without one."""
    quiet = F.col(y) == 0
    return scored.groupBy(*keys).agg(F.try_divide(F.count_if(quiet & F.col(alert)) * 365.25, F.count_if(quiet)).alias("false_alerts_per_year"))


def single_column_auc(rows: DataFrame, columns: Sequence[str], y: str = "y") -> DataFrame:
    """AUC of each numeric column alone, nulls at the median; either direction counts."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("score")) for c in columns))
    melted = rows.select(F.col(y).alias("y"), F.explode(pairs).alias("x")).select("y", "x.*")
    medians = quantiles(melted, "score", [0.5], ["column"]).select("column", F.col("q")[0].alias("__m"))
    melted = melted.join(medians, "column").withColumn("score", F.coalesce("score", "__m")).drop("__m")
    found = roc_auc(melted, keys=["column"])
    return found.withColumn("auc", F.greatest("roc_auc", 1 - F.col("roc_auc"))).drop("roc_auc")


def permutation_importance(rows: DataFrame, features: Sequence[str], score, metric=average_precision, id_col: str = "id", repeats: int = 3, seed: int = 7, y: str = "y") -> DataFrame:
    """Mean loss of ``metric`` when a feature's values are dealt out anew among the rows.

    ``score``: columns -> score column. In each repeat the rows are cut into blocks by a hash of their ids; within a block
    the values go from one hash order of the ids to another. Rows are read once and shuffled once a repeat, all features
    are dealt there, and ``metric`` (with ``keys``) runs once for all.
    """
    blocks = 256
    places = F.explode(F.array(*(F.struct(F.lit(r).alias("__r"), F.pmod(F.xxhash64(F.col(id_col), F.lit(f"{seed}{r}")), F.lit(blocks)).alias("__b")) for r in range(repeats)))).alias("__p")
    own = rows.select(F.col(id_col).alias("__id"), F.col(y).alias("__y"), *features, places).select("__id", "__y", *features, "__p.*").repartition("__r", "__b")
    order = lambda salt, f: F.xxhash64("__id", F.concat(F.lit(f"{salt}{seed}"), F.col("__r").cast("string"), F.lit(f)))
    hashed = own.select("__r", "__b", "__y", *features, *(order(salt, f).alias(f"__{salt}{k}") for k, f in enumerate(features) for salt in "ab"))
    kept = ["__r", "__y", *features]
    kinds = own.schema
    schema = T.StructType([kinds[c] for c in kept] + [T.StructField(f"__d{k}", kinds[f].dataType) for k, f in enumerate(features)])

    def deal(block: pa.Table) -> pa.Table:
        dealt = []
        for k, f in enumerate(features):
            a, b = (np.argsort(block[f"__{salt}{k}"].to_numpy(), kind="stable") for salt in "ab")
            source = np.empty_like(a)
            source[a] = b
            dealt.append(block[f].take(pa.array(source)))
        return pa.table([*(block[c] for c in kept), *dealt], names=schema.names)

    dealt = hashed.groupBy("__r", "__b").applyInArrow(deal, schema)
    scores = [F.struct(F.lit(k).alias("__f"), score({g: F.col(f"__d{k}") if g == f else F.col(g) for g in features}).alias("score")) for k, f in enumerate(features)]
    base = F.struct(F.lit(-1).alias("__f"), score({f: F.col(f) for f in features}).alias("score"))
    scored = dealt.select("__r", F.col("__y").alias("y"), F.explode(F.when(F.col("__r") == 0, F.array(base, *scores)).otherwise(F.array(*scores))).alias("v"))
    found = metric(scored.select("__r", "y", "v.*"), keys=["__f", "__r"])
    name = found.columns[-1]
    names = rows.sparkSession.createDataFrame(list(enumerate(features)), "__f int, feature string")
    means = names.join(found, "__f", "left").groupBy("feature").agg(F.avg(name).alias("__after"))
    whole = found.where("__f = -1").agg(F.max(name).alias("__base"))
    return means.crossJoin(whole).select("feature", (F.col("__base") - F.col("__after")).alias("importance"))
