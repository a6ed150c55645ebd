"""What the review of the fourth round found."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import catalog_models
from panelforge.functions import scalars
from panelforge.operators import machines, models, scoring

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def read_times(spark, monkeypatch):
    """How often the machines are made anew by what is run, as a function without arguments."""
    made, seen = catalog_models._machines, spark.sparkContext.accumulator(0)
    rows = made(spark, DATA)
    n = rows.count()

    def watched(spark, sf_dir):
        def through(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return made(spark, sf_dir).mapInArrow(through, rows.schema)

    monkeypatch.setattr(catalog_models, "_machines", watched)
    return lambda: seen.value / n


def test_numbers_in_reasons_are_rounded_as_printf_does(spark):
    values = [1334.5, 1335.5, 0.25, 0.35, 0.15, 8.05, 8.25, 8.75, 12.95, 0.05, 0.5, 1.5, 2.5, 1e-12, 0.9999999, 99.95, 123456.25, 1e15 + 0.5, math.nextafter(0.25, 1), math.nextafter(0.25, 0), 0.0]
    values += [-v for v in values if v] + [None, float("nan"), float("inf")]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 3):
        found = rows.select("x", scalars.half_even(F.col("x"), digits).alias("r")).collect()
        assert [None if r.r is None else f"{r.r:.{digits}f}" for r in found] == [None if r.x is None else f"{r.x:.{digits}f}" for r in found]
    row = spark.createDataFrame([(8.25, 1334.5)], "temp_diff double, rpm double").withColumns({"power": F.lit(5000.0), "strain_ratio": F.lit(0.1), "wear": F.lit(5)})
    text = row.select(machines.reason(F.array(F.lit("HDF")), F.create_map(F.lit("HDF"), F.lit(0.5)))).first()[0]
    assert text == "heat is not carried off: 8.2 K between process and air at 1334 rpm"


def test_forest_and_trees_make_their_rows_once(spark, read_times):
    found = {r.model: r for r in catalog_models.forest_and_trees(spark, DATA).collect()}
    assert set(found) == {"forest", "trees"} and all(r.roc_auc > 0.8 for r in found.values())
    assert read_times() <= 2  # the counts of the split and the split


def test_training_makes_its_table_once_and_predictions_copy_no_row(spark, read_times):
    assert catalog_models.training_report(spark, DATA).count() > 30 and read_times() <= 1
    found = catalog_models.table_predictions(spark, DATA)
    assert read_times() <= 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "__reset" not in plan


@pytest.mark.parametrize("kind", ["logistic", "classes", "ridge", "trees", "values"])
def test_models_in_numpy_score_as_spark_does(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), k, float(a + (k == "p") + rng.normal() / 3)) for a, b, k in zip(rng.normal(size=300), rng.normal(size=300), rng.choice(list("pqr"), 300), strict=True)]
    y = {"ridge": F.col("v"), "values": F.col("v"), "classes": F.when(F.col("v") > 1, 2.0).when(F.col("v") > 0, 1.0).otherwise(0.0)}.get(kind, (F.col("v") > 0.5).cast("double"))
    df = spark.createDataFrame(rows, "a double, b double, k string, v double").withColumn("y", y)
    estimator = {"logistic": models.logistic(300), "classes": models.logistic(300), "ridge": models.ridge(300, 1.0), "trees": models.boosted(rounds=5), "values": models.boosted(True, rounds=5)}[kind]
    _, ready = models.prepared(df, df, ["a", "b"], ["k"], ["y"])
    model = estimator.fit(ready)
    theirs = model.transform(ready).collect()
    out, predicted = scoring.outputs(model)(np.array([r.features.toArray() for r in theirs]))
    assert predicted.tolist() == pytest.approx([r.prediction for r in theirs])
    if kind not in ("ridge", "values"):
        assert np.allclose(out, [r.probability.toArray() for r in theirs], atol=1e-12)


def test_permuted_rows_are_read_once_and_dealt_in_one_pass(spark, read_times):
    found = {r.feature: r.importance for r in catalog_models.permutation_drop(spark, DATA).collect()}
    assert set(found) == {"torque", "wear", "rpm"} and found["rpm"] == 0 and read_times() <= 1
    assert [r.feature for r in catalog_models.top_drivers(spark, DATA).collect()] == sorted(found, key=lambda f: -found[f])[:2]


def test_models_of_modes_make_their_rows_once_and_equal_fits_by_group(spark, read_times):
    found = {(r.machine_id, r.mode): (r.y, r.p) for r in catalog_models.failure_mode_models(spark, DATA).collect()}
    assert read_times() <= 1
    rows = catalog_models._machines(spark, DATA).where("wear > 50")
    rows = rows.withColumn("PWF", F.when(F.col("type") != "H", F.col("PWF"))).select("machine_id", *catalog_models._SENSORS, "OSF", "PWF", F.lit(0).alias("none")).persist()
    ours = {r["mode"]: r for r in models.fit_logistic_labels(rows, catalog_models._SENSORS, ["OSF", "PWF", "none"]).collect()}
    assert set(ours) == {"OSF", "PWF"} and len(found) == 3 * catalog_models._machines(spark, DATA).count()
    for name in ours:
        one = models.fit_logistic_groups(rows.withColumn("mode", F.lit(name)), catalog_models._SENSORS, name, "mode").first()
        assert np.allclose([*ours[name].coefficients, ours[name].intercept], [*one.coefficients, one.intercept], rtol=1e-5, atol=1e-5)


def test_folds_are_dealt_once(spark, read_times):
    found = catalog_models.out_of_fold(spark, DATA)
    assert read_times() <= 2  # the counts of the split and the split
    assert found.count() > 5000 and {r.fold for r in found.select("fold").distinct().collect()} == set(range(5)) and read_times() <= 2
