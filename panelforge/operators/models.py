"""Estimators and evaluation workflows: splits, linear models for many groups at once, trees, explanations.

Many small fits run together. Those of disjoint groups (sources, modes) take a grouped aggregate of gradients and
Hessians a Newton step; those that share rows (folds, left-out groups, replicates) weigh each row as it is read. Only
d x d numbers a fit reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars
from panelforge.operators import metrics, sums
from panelforge.sources import sinks

MAX_CATEGORIES = 30

# Splits.


def shuffle_order(id_col: str, seed: int = 7) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def rank_within(df: DataFrame, y: str, id_col: str, seed: int = 7, blocks: int = 256) -> DataFrame:
    """``__rank`` (from 0) in each label's fixed random order, and ``__n`` rows of the label.

    The order is cut into blocks by its hash, so no task ranks a whole label: ranks in a block are added to
    the counts of the blocks before it, of which there are ``blocks`` a label.
    """
    order = shuffle_order(id_col, seed)
    placed = df.withColumn("__block", F.pmod(F.shiftrightunsigned(order, 32), F.lit(blocks)))
    counts = placed.groupBy(y, "__block").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(y).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(y).alias("__y"), F.col("__block").alias("__b"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(y)).alias("__n"))
    inside = placed.withColumn("__rank", F.row_number().over(Window.partitionBy(y, "__block").orderBy(order, id_col)) - 1)
    joined = inside.join(F.broadcast(counts), F.col(y).eqNullSafe(F.col("__y")) & (F.col("__block") == F.col("__b")))
    return joined.select(*df.columns, (F.col("__rank") + F.col("__before")).alias("__rank"), "__n")


def stratified_split(df: DataFrame, y: str, id_col: str, shares: Sequence[float] = (0.6, 0.2, 0.2), seed: int = 7) -> DataFrame:
    """``part`` 0, 1, 2 ...: within each label, that share of the rows in a fixed random order."""
    ranked = rank_within(df, y, id_col, seed)
    at = F.col("__rank") / F.greatest(F.col("__n") - 1, F.lit(1))
    part = scalars.band(at, np.cumsum(shares)[:-1].tolist(), list(map(str, range(len(shares))))).cast("int")
    return ranked.withColumn("part", part).drop("__rank", "__n")


def time_split(df: DataFrame, date: str, train_until: str, test_from: str) -> DataFrame:
    return df.withColumn("part", F.when(F.col(date) <= train_until, 0).when(F.col(date) >= test_from, 2).otherwise(1))


def folds(df: DataFrame, y: str, id_col: str, k: int = 5, seed: int = 7) -> DataFrame:
    """``fold`` 0 to k - 1, even within each label."""
    ranked = rank_within(df, y, id_col, seed)
    return ranked.withColumn("fold", F.pmod(F.col("__rank"), F.lit(k)).cast("int")).drop("__rank", "__n")


def without_each(df: DataFrame, group: str, most: int = 10_000) -> tuple[list, Column]:
    """The groups of ``df``, and for each of them the weight of a row in the training rows without it, 1 or 0.

    Fits take the weights as they read a row, so no row is copied. The names are a list on the driver; more than
    ``most`` are an error. Rows without a group train nothing.
    """
    names = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} groups of {group}")
    return names, F.transform(_literals(names, df.schema[group].dataType.simpleString()), lambda g: F.coalesce((F.col(group) != g).cast("double"), F.lit(0.0)))


def _literals(values: Sequence, kind: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{kind}>")


def stratified_sample(df: DataFrame, y: str, id_col: str, first: int = 8, total: int = 25) -> DataFrame:
    """The first positives by id, filled up with others to ``total`` rows."""
    rank = F.row_number().over(Window.partitionBy(y).orderBy(id_col))
    each = df.withColumn("__rn", rank).where(F.col("__rn") <= total)
    return each.orderBy(F.when((F.col(y) == 1) & (F.col("__rn") <= first), 0).otherwise(1), id_col).limit(total).drop("__rn")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows in an order that only their ids and the seed decide, the same on every run; ids tell the rows apart."""
    return df.orderBy(F.md5(F.concat_ws("/", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary")), id_col).limit(n)


def enough_groups(df: DataFrame, group: str, least: int = 8) -> DataFrame:
    """``df``, or an error where it has under ``least`` groups: too few for a fit across them."""
    there = df.select(group).where(F.col(group).isNotNull()).distinct().limit(least).count()
    if there < least:
        raise ValueError(f"a fit needs {least} groups of {group} at least, not {there}")
    return df


# Many logistic fits at once.


def fit_logistic_groups(df: DataFrame, features: Sequence[str], y: str = "y", group: str = "fold", c: float = 1.0, weight: str | None = None, rounds: int = 25, standardise: bool = True) -> DataFrame:
    """L2-regularised logistic regression of every group, on features standardised within it (or as they are).

    Rows are read once and kept while the rounds need them. Returns group, mean, scale, coefficients (for standardised features) and intercept. Groups with one
    label only are left out. The driver holds d x d numbers for each group.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    d = len(features)
    labelled = df.where(F.col(y).isNotNull()).dropna(subset=list(features)).select(*dict.fromkeys([group, y, *features, *([weight] if weight else [])])).persist()
    one = F.lit(1.0)
    stats = labelled.groupBy(group).agg(
        F.array(*(F.avg(f) if standardise else one * 0 for f in features)).alias("mean"),
        F.array(*(F.when(F.stddev_pop(f) > 0, F.stddev_pop(f)).otherwise(1.0) if standardise else one for f in features)).alias("scale"),
        F.count_distinct(y).alias("__labels"),
    )
    stats = {r[group]: r for r in stats.where(F.col("__labels") == 2).collect()}
    if not stats:
        labelled.unpersist()
        return df.sparkSession.createDataFrame([], f"`{group}` {df.schema[group].dataType.simpleString()}, mean array<double>, scale array<double>, coefficients array<double>, intercept double")
    beta = {g: np.zeros(d + 1) for g in stats}
    kind = df.schema[group].dataType.simpleString()
    x = F.array(*(F.col(f).cast("double") for f in features))
    for _ in range(rounds):
        current = df.sparkSession.createDataFrame([(g, list(map(float, stats[g]["mean"])), list(map(float, stats[g]["scale"])), b.tolist()) for g, b in beta.items()], f"`{group}` {kind}, __m array<double>, __s array<double>, __b array<double>")
        joined = labelled.join(F.broadcast(current), group)
        z = F.concat(F.zip_with(F.zip_with(x, F.col("__m"), lambda a, m: a - m), F.col("__s"), lambda a, s: a / s), F.array(F.lit(1.0)))
        rows = joined.select(group, F.col(y).cast("double").alias("__y"), w.alias("__w"), z.alias("__x"), "__b")
        rows = rows.withColumn("__p", scalars.sigmoid(F.aggregate(F.zip_with("__x", "__b", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)))
        e, v = F.col("__w") * (F.col("__y") - F.col("__p")), F.col("__w") * F.col("__p") * (1 - F.col("__p"))
        sums = [F.sum(e * F.col("__x")[i]) for i in range(d + 1)] + [F.sum(v * F.col("__x")[i] * F.col("__x")[j]) for i in range(d + 1) for j in range(i, d + 1)]
        largest = 0.0
        for row in rows.groupBy(group).agg(F.array(*sums).alias("s")).collect():
            g, s = row[0], np.array(row[1], dtype=float)
            hessian = np.zeros((d + 1, d + 1))
            hessian[np.triu_indices(d + 1)] = s[d + 1 :]
            hessian = hessian + np.triu(hessian, 1).T + np.diag([1 / c] * d + [1e-12])
            step = np.linalg.solve(hessian, s[: d + 1] - np.r_[beta[g][:d] / c, 0.0])
            beta[g] = beta[g] + step
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-8:
            break
    labelled.unpersist()
    found = [(g, list(map(float, stats[g]["mean"])), list(map(float, stats[g]["scale"])), b[:d].tolist(), float(b[d])) for g, b in beta.items()]
    return df.sparkSession.createDataFrame(found, f"`{group}` {kind}, mean array<double>, scale array<double>, coefficients array<double>, intercept double")


def fit_logistic_labels(df: DataFrame, features: Sequence[str], labels: Sequence[str], c: float = 1.0, rounds: int = 25, group: str = "mode") -> DataFrame:
    """A logistic regression of each of the columns ``labels`` (0, 1 or null: not among its rows), without copies of rows.

    ``df`` is scanned in each step and not kept: a table, not a long plan. Returns what ``fit_logistic_weighted`` does.
    """
    own = F.array(*(F.col(f"`{n}`").cast("double") for n in labels))
    weights = F.array(*(F.col(f"`{n}`").isNotNull().cast("double") for n in labels))
    return fit_logistic_weighted(df, features, weights, labels, own, c, rounds, group, "string", keep=False)


def fit_logistic_weighted(
    df: DataFrame, features: Sequence[str], weights: Column, names: Sequence, y: str | Column = "y", c: float = 1.0, rounds: int = 25, group: str = "fold", kind: str = "int", keep: bool = True
) -> DataFrame:
    """As many logistic regressions as ``names``, each on all rows by its own weight, in one scan a Newton step.

    ``weights``: an array of a row's weight in each fit (0: not among its rows), made as the row is read. In the tasks
    the gradients and Hessians of all fits are two matrix products over a batch of rows; what is shuffled is one row of
    sums a task and fit. Features are standardised over the rows of a fit, whatever their weight. Fits with one label
    only are left out. ``y``: the label, or an array of a row's labels in each fit. ``keep``: whether the rows are kept
    between the steps. Returns ``group`` (of SQL type ``kind``), mean, scale, coefficients and intercept.
    """
    d, m = len(features), len(names)
    schema = f"`{group}` {kind}, mean array<double>, scale array<double>, coefficients array<double>, intercept double"
    spark = df.sparkSession
    each = not isinstance(y, str)
    known = (df if each else df.where(F.col(y).isNotNull())).dropna(subset=list(features))
    known = known.persist() if keep else known
    values = [F.col(f).cast("double") for f in features]
    centre = known.agg(F.array(*(F.coalesce(F.avg(v), F.lit(0.0)) for v in values))).first()[0]
    rows = known.select((y if each else F.col(y).cast("double")).alias("y"), F.array(*(v - x for v, x in zip(values, centre, strict=True))).alias("x"), weights.alias("w"))

    def summed(step: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sums over all rows of ``step`` of x (rows x d), y (rows x 1, or x fits) and w (rows x fits), a line a fit."""

        def of(batch: pa.RecordBatch) -> np.ndarray:
            x, w = (np.asarray(batch.column(k).flatten(), dtype=float).reshape(batch.num_rows, -1) for k in (1, 2))
            label = np.asarray(batch.column(0).flatten() if each else batch.column(0), dtype=float).reshape(len(x), -1)
            return step(x, np.nan_to_num(label), w)

        found = sums.added_up(rows, of, m)
        return np.zeros((m, 0)) if found is None else found

    def moments(x: np.ndarray, label: np.ndarray, w: np.ndarray) -> np.ndarray:
        on = (w > 0).astype(float).T
        return np.c_[on.sum(axis=1), (on * label.T).sum(axis=1), on @ x, on @ (x * x)]

    first = summed(moments)
    n, ones = (first[:, 0], first[:, 1]) if first.size else (np.zeros(m), np.zeros(m))
    fitted = np.flatnonzero((ones > 0) & (ones < n))
    if not fitted.size:
        if keep:
            known.unpersist()
        return spark.createDataFrame([], schema)
    mean = first[:, 2 : 2 + d] / np.maximum(n, 1)[:, None]
    variance = first[:, 2 + d :] / np.maximum(n, 1)[:, None] - mean * mean
    scale = np.where(variance > 1e-12 * np.maximum(mean * mean, 1e-300), np.sqrt(np.maximum(variance, 0)), 1.0)
    upper = np.triu_indices(d + 1)
    beta = np.zeros((m, d + 1))
    for _ in range(rounds):
        # On the rows as they are: coefficients for unscaled features, sums scaled afterwards.
        raw = np.c_[beta[:, :d] / scale, beta[:, d] - (beta[:, :d] * mean / scale).sum(axis=1)]

        def gradients(x: np.ndarray, label: np.ndarray, w: np.ndarray, raw: np.ndarray = raw) -> np.ndarray:
            one = np.c_[x, np.ones(len(x))]
            p = 1 / (1 + np.exp(-(one @ raw.T)))
            return np.c_[(w * (label - p)).T @ one, (w * p * (1 - p)).T @ (one[:, upper[0]] * one[:, upper[1]])]

        found, largest = summed(gradients), 0.0
        for k in fitted:
            # z = A x: standardised features and the constant.
            a = np.diag(np.r_[1 / scale[k], 1.0])
            a[:d, d] = -mean[k] / scale[k]
            hessian = np.zeros((d + 1, d + 1))
            hessian[upper] = found[k, d + 1 :]
            hessian = a @ (hessian + np.triu(hessian, 1).T) @ a.T + np.diag([1 / c] * d + [1e-12])
            step = np.linalg.solve(hessian, a @ found[k, : d + 1] - np.r_[beta[k, :d] / c, 0.0])
            beta[k] += step
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-8:
            break
    if keep:
        known.unpersist()
    found = [(names[k], (mean[k] + centre).tolist(), scale[k].tolist(), beta[k, :d].tolist(), float(beta[k, d])) for k in fitted]
    return spark.createDataFrame(found, schema)


def score_groups(df: DataFrame, fits: DataFrame, features: Sequence[str], group: str = "fold") -> DataFrame:
    """``p`` of each row by its own group's fit."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    z = F.zip_with(F.zip_with(x, F.col("mean"), lambda a, m: a - m), F.col("scale"), lambda a, s: a / s)
    total = F.aggregate(F.zip_with(z, F.col("coefficients"), lambda a, b: a * b), F.col("intercept"), lambda t, v: t + v)
    return df.join(fits, group).withColumn("p", scalars.sigmoid(total)).select(*df.columns, "p")


def score_each(fits: DataFrame, features: Sequence[str]) -> tuple[Column, int]:
    """An array of a row's probabilities by every fit, and their number; the fits are a constant of the plan."""
    rows = fits.select("mean", "scale", "coefficients", "intercept").collect()  # one row a fit
    table = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), "array<struct<mean array<double>, scale array<double>, coefficients array<double>, intercept double>>")
    x = F.array(*(F.col(f).cast("double") for f in features))

    def score(fit: Column) -> Column:
        z = F.zip_with(F.zip_with(x, fit["mean"], lambda a, m: a - m), fit["scale"], lambda a, s: a / s)
        return scalars.sigmoid(F.aggregate(F.zip_with(z, fit["coefficients"], lambda a, b: a * b), fit["intercept"], lambda t, v: t + v))

    return F.transform(table, score), len(rows)


def leave_one_out(df: DataFrame, features: Sequence[str], group: str, y: str = "y", c: float = 1.0) -> DataFrame:
    """For each group the fit on all rows of the others, as ``fit_logistic_groups`` returns it."""
    names, weights = without_each(df, group)
    return fit_logistic_weighted(df, features, weights, names, y, c, group=group, kind=df.schema[group].dataType.simpleString())


def across(df: DataFrame, features: Sequence[str], part: str, y: str = "y", c: float = 1.0) -> DataFrame:
    """Every row's probability by the fit on the rows of all other values of ``part``: one terrain by the other."""
    return score_groups(df.dropna(subset=list(features)), leave_one_out(df, features, part, y, c), features, part)


def cross_validate(df: DataFrame, features: Sequence[str], y: str, id_col: str, k: int = 5, c: float = 1.0) -> DataFrame:
    """Out-of-fold probabilities: every row scored by the fit on the other folds."""
    dealt = sinks.written(folds(df, y, id_col, k), "folds")  # read by every step of the fits and by all that uses the scores
    weights = F.transform(_literals(range(k), "int"), lambda i: (F.col("fold") != i).cast("double"))
    return score_groups(dealt, fit_logistic_weighted(dealt, features, weights, range(k), y, c, keep=False), features)


def poisson_draws(id_col: str, replicates: int, seed: int = 7) -> Column:
    """How often each replicate draws a row: an array of Poisson numbers of mean 1 that only the id decides."""
    steps, total, term = [], 0.0, float(np.exp(-1))
    for n in range(8):
        total += term
        steps.append(total)
        term /= n + 1
    u = lambda r: F.pmod(F.xxhash64(F.col(id_col), r, F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    return F.transform(_literals(range(replicates), "int"), lambda r: F.size(F.filter(F.lit(steps), lambda s: u(r) >= s)).cast("double"))


def bootstrap_intervals(df: DataFrame, features: Sequence[str], y: str, id_col: str, replicates: int = 100, c: float = 1.0, seed: int = 7) -> DataFrame:
    """p10, p90 and deviation of each row's probability over Poisson resamples; one-label draws are skipped."""
    fits = fit_logistic_weighted(df, features, poisson_draws(id_col, replicates, seed), range(replicates), y, c, group="replicate")
    p, n = score_each(fits, features)
    scored = df.select(id_col, F.array_sort(p).alias("__p")).where(F.lit(n > 0))

    def point(q: float) -> Column:
        at = q * (n - 1)
        low, high = (F.get("__p", F.lit(int(k))) for k in (np.floor(at), np.ceil(at)))
        return low + (high - low) * float(at - np.floor(at))

    mean = F.aggregate("__p", F.lit(0.0), lambda t, v: t + v) / n
    spread = F.aggregate("__p", F.lit(0.0), lambda t, v: t + (v - F.col("__mean")) * (v - F.col("__mean"))) / n
    return scored.withColumn("__mean", mean).select(id_col, point(0.1).alias("p10"), point(0.9).alias("p90"), F.sqrt(spread).alias("deviation"))


def recalibrate(scored: DataFrame, y: str = "y", p: str = "p", source: str = "source", least_years: float = 5.0, least_positives: int = 10, date: str = "date", alert_rate: float = 0.05) -> DataFrame:
    """Platt scaling of each source by its own labels: source, slope, intercept, threshold.

    Sources of under ``least_years`` or ``least_positives`` are left out, as not to be recalibrated.
    """
    known = scored.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    enough = known.groupBy(source).agg(F.sum(y).alias("__p"), F.datediff(F.max(date), F.min(date)).alias("__d"))
    enough = enough.where((F.col("__p") >= least_positives) & (F.col("__d") >= least_years * 365.25)).select(source)
    rows = known.join(enough, source).withColumn("__z", scalars.logit(F.col(p)))
    fits = fit_logistic_groups(rows, ["__z"], y, source, c=1.0, standardise=False)
    again = score_groups(rows.drop("p").withColumnRenamed("__z", "z"), fits, ["z"], source).withColumnRenamed("p", "__q")
    limits = metrics.alert_threshold(again, alert_rate, "__q", [source])
    return fits.select(source, F.col("coefficients")[0].alias("slope"), "intercept").join(limits, source)


def recalibrated(scored: DataFrame, fits: DataFrame, p: str = "p", source: str = "source") -> DataFrame:
    """``p_adapted`` and ``alert_adapted`` of each row of a source that could be recalibrated; null for the others."""
    z = F.col("slope") * scalars.logit(F.col(p)) + F.col("intercept")
    joined = scored.join(fits.withColumnRenamed("threshold", "__line"), source, "left").withColumn("p_adapted", scalars.sigmoid(z))
    return joined.withColumn("alert_adapted", F.col("p_adapted") >= F.col("__line")).drop("slope", "intercept", "__line")


# Single models by Spark ML.


def preprocessing(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Median imputation, and one-hot codes of the ``MAX_CATEGORIES`` most frequent categories; rarer and unseen ones share a code."""
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__i" for c in numeric])] if numeric else []
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}__n", handleInvalid="keep") for c in categorical]
    if categorical:
        folded = ", ".join(f"least(`{c}__n`, {MAX_CATEGORIES}) AS `{c}__k`" for c in categorical)
        stages.append(SQLTransformer(statement=f"SELECT *, {folded} FROM __THIS__"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__k" for c in categorical], outputCols=[f"{c}__h" for c in categorical], handleInvalid="keep", dropLast=True))
    inputs = [f"{c}__i" for c in numeric] + [f"{c}__h" for c in categorical]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="features")]


def logistic(n: int, c: float = 1.0, weight: str | None = None) -> LogisticRegression:
    model = LogisticRegression(labelCol="y", regParam=1 / (c * n), standardization=False, tol=1e-10, maxIter=200)
    return model.setWeightCol(weight) if weight else model


def ridge(n: int, label_std: float, alpha: float = 1.0) -> LinearRegression:
    """The closed-form ridge: Spark scales the label, so the penalty is given in its units."""
    return LinearRegression(labelCol="y", regParam=alpha / n * label_std, elasticNetParam=0.0, standardization=False, solver="l-bfgs", tol=1e-10, maxIter=200)


def boosted(regression: bool = False, depth: int = 4, rate: float = 0.05, rounds: int = 100):
    kind = GBTRegressor if regression else GBTClassifier
    return kind(labelCol="y", maxDepth=depth, stepSize=rate, maxIter=rounds, seed=7)


def forest(trees: int = 300, weight: str | None = None) -> RandomForestClassifier:
    model = RandomForestClassifier(labelCol="y", numTrees=trees, minInstancesPerNode=2, seed=7)
    return model.setWeightCol(weight) if weight else model


def balanced_weights(df: DataFrame, y: str = "y", classes: int = 2) -> DataFrame:
    """``weight``: all rows over ``classes`` times the rows of the label."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return df.join(F.broadcast(counts), y).crossJoin(F.broadcast(total)).withColumn("weight", F.col("__all") / (F.col("__n") * classes)).drop("__n", "__all")


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], estimator) -> PipelineModel:
    return Pipeline(stages=[*preprocessing(numeric, categorical), estimator]).fit(df)


def prepared(train: DataFrame, rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], keep: Sequence[str]) -> tuple[PipelineModel, DataFrame]:
    """The preparation fitted on ``train``, and ``keep`` and ``features`` of ``rows``, written once for several estimators."""
    preparation = Pipeline(stages=preprocessing(numeric, categorical)).fit(train)
    return preparation, sinks.written(preparation.transform(rows).select(*keep, "features"), "prepared")


def probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn("p", vector_to_array("probability")[1]).select(*df.columns, "p")


def monotone_model(df: DataFrame, rising: Sequence[str], free: Sequence[str] = (), bins: int = 8, c: float = 1.0) -> tuple[PipelineModel, Callable[[DataFrame], DataFrame]]:
    """A logistic model that never falls in the ``rising`` features: steps at quantiles with coefficients at least 0.

    Returns the model and the function that codes a table for it.
    """
    from pyspark.ml.linalg import Matrices

    points = [i / bins for i in range(1, bins)]
    long = df.select(*(F.col(f).cast("double").alias(f) for f in rising)).unpivot([], list(rising), "name", "value")
    cuts = {r["name"]: dict.fromkeys(r.q) for r in metrics.quantiles(long, "value", points, ["name"]).collect()}  # one row a feature
    steps = [(f, cut) for f in rising for cut in cuts.get(f, ())]

    def coded(table: DataFrame) -> DataFrame:
        return table.select("*", *((F.col(f) > cut).cast("double").alias(f"__s{i}") for i, (f, cut) in enumerate(steps)))

    inputs = [*(f"__s{i}" for i in range(len(steps))), *free]
    bounds = Matrices.dense(1, len(inputs), [0.0] * len(steps) + [float("-inf")] * len(free))
    n = df.count()
    model = LogisticRegression(labelCol="y", regParam=1 / (c * n), standardization=False, lowerBoundsOnCoefficients=bounds)
    return Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), model]).fit(coded(df)), coded


# Explanations.


def reset_one_feature(df: DataFrame, features: Sequence[str], typical: DataFrame, score: Callable[[DataFrame], DataFrame], id_col: str = "id", n: int = 3) -> DataFrame:
    """What each row's probability owes to each feature: its fall when that feature takes its typical value.

    Every row is copied once for each feature and all copies are scored in one pass. Returns id, p and the
    text of the ``n`` largest.
    """
    usual = {r["name"]: float(r["typical"]) for r in typical.collect()}  # one row a feature
    which = F.explode(F.array(F.lit(""), *map(F.lit, features))).alias("__reset")
    copies = df.select("*", which)
    copies = copies.withColumns({f: F.when(F.col("__reset") == f, F.lit(usual[f])).otherwise(F.col(f)) for f in features})
    scored = score(copies).groupBy(id_col).agg(F.max(F.when(F.col("__reset") == "", F.col("p"))).alias("p"), F.collect_list(F.struct(F.col("__reset").alias("name"), "p")).alias("__each"))
    falls = F.transform(F.filter("__each", lambda x: x["name"] != ""), lambda x: F.struct((x["p"] - F.col("p")).alias("rank"), x["name"].alias("name")))
    top = F.slice(F.array_sort(F.filter(falls, lambda x: x["rank"] < 0)), 1, n)
    text = F.concat_ws("; ", F.transform(top, lambda x: F.format_string("%s +%.3f", x["name"], -x["rank"])))
    return scored.select(id_col, "p", F.when(text != "", text).otherwise("several inputs").alias("reasons"))


def consistent(p24: Column, p48: Column, p72: Column) -> tuple[Column, Column, Column]:
    """Probabilities that don't fall with a longer horizon."""
    return p24, F.greatest(p24, p48), F.greatest(p24, p48, p72)


def select_model(candidates: DataFrame, metric: str = "average_precision") -> DataFrame:
    return candidates.agg(F.max_by("model", F.struct(F.col(metric), F.col("model"))).alias("model"), F.max(metric).alias(metric))
