"""Windows in blocks of days against whole keys, and many fits in one scan against single ones."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.operators import models, series
from tests.test_learning import newton

START = datetime.date(1969, 11, 3)


def daily(spark, n=400, keys=("long", "short"), gaps=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for key in keys:
        for i in range(n if key == "long" else 9):
            if rng.random() >= gaps:
                rows.append((key, START + datetime.timedelta(i), None if rng.random() < 0.1 else float(rng.integers(0, 50)), int(rng.random() < 0.2)))
    return spark.createDataFrame([*rows, (None, START, 3.0, 1), ("short", None, 1.0, 0)], "site_id string, date date, rain double, extreme int")


def table(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("days", [30, 37, 64, 1024])
def test_rolling_sums_in_blocks_equal_whole_keys(spark, days):
    df = daily(spark).where("date is not null")
    over = Window.partitionBy("site_id").orderBy("date")
    whole = df.select("*", *(series.rolling_sum(F.col("rain"), n, over, 2).alias(f"rain_{n}d") for n in (3, 30)))
    assert table(series.rolling_sums(df, "rain", (3, 30), 2, block_days=days)) == table(whole)


@pytest.mark.parametrize("days", [20, 33])
def test_antecedent_sums_in_blocks_equal_whole_keys_with_gaps(spark, days):
    df = daily(spark, gaps=0.4).where("date is not null")
    over = Window.partitionBy("site_id").orderBy(F.unix_date("date"))
    whole = df.select("*", *(F.sum("rain").over(over.rangeBetween(1 - n, 0)).alias(f"rain_{n}d") for n in (10, 20)))
    assert table(series.antecedent_sums(df, block_days=days)) == table(whole)


@pytest.mark.parametrize("complete", [True, False])
def test_labels_in_blocks_equal_whole_keys(spark, complete):
    df = daily(spark).where("date is not null").withColumn("extreme", F.when(F.col("rain").isNotNull(), F.col("extreme")))
    over = Window.partitionBy("site_id").orderBy("date")
    whole = df.withColumns({f"y_{24 * h}h": series.any_ahead(F.col("extreme"), h, over, complete) for h in (1, 3)})
    assert table(series.horizon_labels(df, (1, 3), complete=complete, block_days=5)) == table(whole)


def test_blocks_spread_a_key_and_keep_odd_rows(spark):
    df = daily(spark).withColumn("a.b", F.lit(1))
    made = series.in_blocks(df, lambda over: {"n": F.count(F.lit(1)).over(over.rangeBetween(-1, 0))}, 1, 0, days=16)
    assert made.count() == df.count() and made.columns == [*df.columns, "n"]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(site_id" in plan and "__block" in plan
    with pytest.raises(ValueError, match="don't fit"):
        series.in_blocks(df, lambda over: {}, 40, 0, days=16)
    assert series.rolling_sums(df.where("false")).count() == 0


# Many fits in one scan.


@pytest.fixture(scope="module")
def sites(spark):
    rng = np.random.default_rng(6)
    x = rng.normal([3, -200], [2, 30], size=(500, 2))
    g = rng.integers(0, 6, 500)
    y = ((x[:, 0] - 3) / 2 + 0.3 * g - 1 + rng.normal(size=500) > 0).astype(int)
    rows = [(i, f"s{g[i]}", float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(500)]
    return spark.createDataFrame([*rows, (900, "s1", None, 1.0, 1), (901, "s2", 1.0, 1.0, None)], "id int, site string, a double, b double, y int"), x, g, y


def test_leave_one_out_equals_single_fits(spark, sites):
    df, x, g, y = sites
    fits = models.leave_one_out(df, ["a", "b"], "site")
    assert fits.count() == 6
    for r in models.score_groups(df.where("a is not null and id < 60"), fits, ["a", "b"], "site").collect():
        out = g != int(r.site[1])
        assert r.p == pytest.approx(newton(x[out], y[out])(x[[r.id]])[0], abs=1e-7)


def test_cross_validation_equals_single_fits(spark, sites):
    df, x, g, y = sites
    found = models.cross_validate(df.where("id < 500"), ["a", "b"], "y", "id", k=4)
    fold = np.empty(500, dtype=int)
    rows = found.collect()
    for r in rows:
        fold[r.id] = r.fold
    for r in rows[::25]:
        assert r.p == pytest.approx(newton(x[fold != r.fold], y[fold != r.fold])(x[[r.id]])[0], abs=1e-7)


def test_bootstrap_equals_single_fits(spark, sites):
    df, x, g, y = sites
    small = df.where("id < 40")
    drawn = {r.id: r.w for r in small.select("id", models.poisson_draws("id", 12).alias("w")).collect()}
    w = np.array([drawn[i] for i in range(40)])
    assert 0.8 < w.mean() < 1.2 and set(np.unique(w)) <= set(range(9))
    p = []
    for k in range(12):
        on = w[:, k] > 0
        own, mean, scale = x[:40][on], x[:40][on].mean(0), x[:40][on].std(0)
        fit = newton((own - mean) / scale, y[:40][on], standardise=False, weight=w[on, k])
        p.append(fit((x[:40] - mean) / scale))
    p = np.array(p)
    for r in models.bootstrap_intervals(small, ["a", "b"], "y", "id", replicates=12).collect():
        assert [r.p10, r.p90, r.deviation] == pytest.approx([*np.quantile(p[:, r.id], [0.1, 0.9]), p[:, r.id].std()], abs=1e-6)


def test_fits_without_both_labels_or_rows(spark, sites):
    df = sites[0]
    assert models.leave_one_out(df.where("false"), ["a", "b"], "site").count() == 0
    one = df.withColumn("y", (F.col("site") == "s0").cast("int"))  # without s0 there is one label only
    assert "s0" not in {r.site for r in models.leave_one_out(one, ["a", "b"], "site").collect()}
    flat = models.leave_one_out(df.withColumn("b", F.lit(7.0)), ["a", "b"], "site").first()
    assert flat.scale[1] == 1.0 and abs(flat.coefficients[1]) < 1e-9
    with pytest.raises(ValueError, match="more than 3"):
        models.without_each(df, "site", most=3)


def test_training_on_one_part_and_testing_on_the_other(spark, sites):
    df, x, g, y = sites
    parts = df.where("id < 500").withColumn("terrain", F.when(F.col("site") < "s3", "hill").otherwise("coastal"))
    for r in models.across(parts, ["a", "b"], "terrain").where("id < 30").collect():
        out = (g >= 3) if r.terrain == "hill" else (g < 3)
        assert r.p == pytest.approx(newton(x[out], y[out])(x[[r.id]])[0], abs=1e-7)


def test_no_nested_loops_and_no_copies(spark, sites):
    names, weights = models.without_each(sites[0], "site")
    plan = sites[0].select(weights)._jdf.queryExecution().executedPlan().toString()
    assert len(names) == 6 and "NestedLoop" not in plan and "Generate" not in plan
