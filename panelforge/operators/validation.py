"""External validation: a model's scores at new places, from another source, raw and recalibrated, against climatology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import metrics, models, series


def with_labels(scored: DataFrame, until: str, days: int = 3, x: str = "rain", key: str = "site_id", date: str = "date") -> DataFrame:
    """``y``: whether one of the next days is extreme by the place's own values up to ``until``."""
    limits = series.extreme_threshold(scored, F.lit(until).cast("date"), x, key=key, date=date)
    flagged = series.fill_days(series.extreme_flags(scored, limits, x, key).withColumn("__there", F.lit(True)), key, date)
    return series.horizon_labels(flagged, [days], key, date, complete=False).where("__there").drop("__there").withColumnRenamed(f"y_{24 * days}h", "y")


def compare(
    scored: DataFrame, climate_until: str, test_from: str, test_until: str, alert_rate: float, days: int = 3, p: str = "p", x: str = "rain", key: str = "site_id", date: str = "date"
) -> DataFrame:
    """roc_auc, average_precision, brier, mean score, rate and n of the raw, recalibrated and climatology forecasts.

    One row for each place and one for all (null place). Recalibration is fitted before ``test_from``, on days whose
    labels are known by then; the monthly climatology up to ``climate_until``.
    """
    rows = with_labels(scored, climate_until, days, x, key, date)
    history = rows.where(F.col(date) < F.date_sub(F.lit(test_from).cast("date"), days))
    fits = models.recalibrate(history, p=p, source=key, date=date, alert_rate=alert_rate)
    usual = rows.where(F.col(date) <= climate_until).groupBy(key, F.month(date).alias("__month")).agg(F.avg("y").alias("climatology"))
    test = rows.where((F.col(date) >= test_from) & (F.col(date) <= test_until) & F.col("y").isNotNull() & F.col(p).isNotNull())
    test = models.recalibrated(test, fits, p, key).withColumn("__month", F.month(date)).join(usual, [key, "__month"], "left")
    names = {"raw": p, "recalibrated": "p_adapted", "climatology": "climatology"}
    forecasts = F.explode(F.array(*(F.struct(F.lit(n).alias("forecast"), F.col(c).cast("double").alias("score")) for n, c in names.items()))).alias("x")
    places = F.explode(F.array(F.col(key).cast("string"), F.lit(""))).alias("__place")
    long = test.select("y", places, forecasts).select("y", "__place", "x.*").where("score is not null")
    ranked = metrics.binary_scores(long, keys=["__place", "forecast"])
    means = long.groupBy("__place", "forecast").agg(F.avg("score").alias("mean_score"), F.avg("y").alias("observed"), F.count(F.lit(1)).alias("n"))
    return ranked.join(means, ["__place", "forecast"]).select(F.when(F.col("__place") != "", F.col("__place")).alias(key), "forecast", "roc_auc", "average_precision", "brier", "mean_score", "observed", "n")
