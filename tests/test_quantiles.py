"""Radix selection and windows of few values against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import metrics
from panelforge.operators import quantiles as q

POINTS = [0.0, 0.01, 0.25, 0.5, 0.333, 0.99, 1.0]


def cases():
    rng = np.random.default_rng(2)
    return {
        "normal": rng.normal(size=1000),
        "ties": np.round(rng.normal(size=400), 1),
        "signs": np.r_[-rng.lognormal(3, 40, 300), rng.lognormal(-3, 40, 301)],
        "zeros": np.array([0.0, -0.0, 0.0, 1.0, -1.0]),
        "tiny": np.array([5e-324, -5e-324, 0.0, 1e-310, 2e-310]),
        "huge": np.array([1.7e308, -1.7e308, 1.0, 2.0]),
        "infinite": np.array([-math.inf, 1.0, 2.0, 3.0, math.inf]),
        "near": 1e9 + np.arange(300) * 1e-7,
        "one": np.array([7.25]),
        None: rng.integers(0, 5, 99).astype(float),
    }


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, float(v)) for k, x in cases().items() for v in x] + [("normal", None), ("ties", math.nan), ("none", None)]
    return spark.createDataFrame(data, "g string, x double").repartition(6)


@pytest.mark.parametrize("few", [0, 10**6])
def test_both_ways_equal_numpy_in_every_group(rows, few):
    found = {r.g: r.q for r in q.quantiles(rows, "x", POINTS, ["g"], few=few).collect()}
    assert set(found) == set(cases())
    for k, x in cases().items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(x, POINTS)
        for a, b in zip(found[k], want, strict=True):
            assert a == pytest.approx(b, rel=1e-12) or (math.isnan(b) or abs(b) > 1e308)


@pytest.mark.parametrize("few", [0, 10**6])
def test_without_keys_and_without_values(spark, rows, few):
    x = np.concatenate([v for k, v in cases().items() if k in ("normal", "ties")])
    found = q.quantiles(rows.where("g in ('normal', 'ties')"), "x", [0.1, 0.9], few=few).collect()
    assert found[0].q == pytest.approx(np.quantile(x, [0.1, 0.9]).tolist()) and len(found) == 1
    assert q.quantiles(rows.where("g = 'none'"), "x", [0.5], ["g"], few=few).count() == 0
    assert q.quantiles(spark.createDataFrame([], "g string, x double"), "x", [0.5], few=few).count() == 0


def test_bits_keep_the_order(spark):
    x = np.sort(np.concatenate([v for v in cases().values()]))
    found = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", q.ordered_bits("x").alias("b")).collect()
    ordered = sorted(found, key=lambda r: r.b)
    assert [r.x for r in ordered] == sorted(r.x for r in found)
    assert len({r.b for r in found}) == len({r.x for r in found})


def test_integers_and_odd_names(spark):
    df = spark.range(101).select(F.col("id").cast("int").alias("a.b"), (F.col("id") % 2).alias("k"), F.lit(1).alias("v"), F.lit(2).alias("c"))
    df = df.withColumnRenamed("a.b", "n")
    assert {r.k: r.q for r in q.quantiles(df, "n", [0.5], ["k"], few=0).collect()} == {0: [50.0], 1: [50.0]}


@pytest.mark.parametrize("rows_a_range", [3, 10**6])
def test_percentiles_of_peaks_in_their_own_history(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(metrics, "RANGE_ROWS", rows_a_range)
    rng = np.random.default_rng(5)
    rows = [(k, None if rng.random() < 0.1 else float(v)) for k in "ab" for v in np.round(rng.random(80), 1)]
    peaks = [("a", 0.5), ("a", 0.05), ("a", 2.0), ("b", 0.3), ("c", 0.3)]
    found = metrics.history_percentile(spark.createDataFrame(rows, "site_id string, score double"), spark.createDataFrame(peaks, "site_id string, peak double")).collect()
    own = lambda k: [v for s, v in rows if s == k and v is not None]
    want = {(k, p): 100 * sum(v < p for v in own(k)) / len(own(k)) if own(k) else None for k, p in peaks}
    assert {(r.site_id, r.peak): r.percentile for r in found} == pytest.approx(want)
