"""Registered queries of models: fits, resampling, recalibration, whole reports. Those that iterate have no SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.catalog import MACHINE_SQL, SCORED_SQL, TRAIN_END, filled, labelled, machine_rows, panel, query, rounded, scored, table
from panelforge.functions import scalars
from panelforge.operators import autolearn, boosting, machines, metrics, models, scopes, series, validation
from panelforge.sources import sinks


@query(
    """WITH x AS (SELECT l_returnflag, l_quantity / 10 AS a, l_discount * 10 AS b, l_extendedprice / 10000 AS y FROM lineitem WHERE l_returnflag = 'R'),
s AS (SELECT regr_sxx(a, a) + 1 AS aa, regr_sxy(a, b) AS ab, regr_sxx(b, b) + 1 AS bb, regr_sxy(a, y) AS ay, regr_sxy(b, y) AS bz, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM x),
c AS (SELECT *, (bb * ay - ab * bz) / (aa * bb - ab * ab) AS ca, (aa * bz - ab * ay) / (aa * bb - ab * ab) AS cb FROM s)
SELECT round(ca, 4) AS a, round(cb, 4) AS b, round(my - ca * ma - cb * mb, 4) AS intercept FROM c"""
)
def ridge_fit(spark, sf_dir):
    """A ridge regression of two columns, against its closed form."""
    from pyspark.ml.feature import VectorAssembler

    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_extendedprice") / 10000).alias("y"))
    n, spread = rows.agg(F.count(F.lit(1)), F.stddev_samp("y")).first()
    model = models.ridge(n, spread).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows))
    return spark.createDataFrame([(*(round(float(c), 4) for c in model.coefficients), round(model.intercept, 4))], "a double, b double, intercept double")


def _machines(spark, sf_dir):
    """One row for each reading, with failures of three kinds and some that none explains.

    Machines have several readings, so a row's id is made of all its values; equal rows are told apart by a number.
    """
    rows = machine_rows(spark, sf_dir)
    same = Window.partitionBy(*rows.columns).orderBy(F.lit(0))
    keyed = rows.withColumn("machine_id", F.xxhash64(*rows.columns, F.row_number().over(same)))
    f = machines.features(keyed)
    odd = F.pmod(F.xxhash64("machine_id"), F.lit(50)) == 0
    return f.withColumns({"PWF": (F.col("power") > 9000).cast("int"), "OSF": (F.col("strain_ratio") >= 0.9).cast("int"), "TWF": (F.col("wear") >= 230).cast("int")}).withColumn(
        "failure", ((F.col("PWF") + F.col("OSF") + F.col("TWF") > 0) | odd).cast("int")
    )


_SENSORS = ["torque", "rpm", "wear", "temp_diff"]
_MODES = ["OSF", "PWF", "TWF"]


@query()
def failure_mode_models(spark, sf_dir):
    """One logistic model for each kind of failure, all fitted at once: the probability of each for every machine."""
    rows = sinks.written(_machines(spark, sf_dir).select("machine_id", *_SENSORS, *_MODES), "modes")
    fits = models.fit_logistic_labels(rows, _SENSORS, _MODES)
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("y")) for m in _MODES))).alias("x")
    long = rows.select("machine_id", *_SENSORS, modes).select("machine_id", *_SENSORS, "x.*")
    return rounded(models.score_groups(long, fits, _SENSORS, "mode").select("machine_id", "mode", "y", "p"), 6)


@query()
def horizon_models(spark, sf_dir):
    """Models for 24, 48 and 72 hours, whose probabilities don't fall with the horizon."""
    rows = labelled(spark, sf_dir).where(F.col("rain").isNotNull() & F.col("t2m").isNotNull())
    horizons = F.explode(F.array(*(F.struct(F.lit(h).alias("hours"), F.col(f"y_{h}h").alias("y")) for h in (24, 48, 72)))).alias("x")
    long = rows.select("site_id", "date", "rain", "t2m", horizons).select("site_id", "date", "rain", "t2m", "x.*")
    fits = models.fit_logistic_groups(long.where(F.col("date") <= TRAIN_END), ["rain", "t2m"], group="hours")
    wide = models.score_groups(long, fits, ["rain", "t2m"], "hours").groupBy("site_id", "date").pivot("hours", [24, 48, 72]).agg(F.first("p"))
    ahead = models.consistent(F.col("24"), F.col("48"), F.col("72"))
    return rounded(wide.select("site_id", "date", *(p.alias(n) for p, n in zip(ahead, ("p24", "p48", "p72"), strict=True))), 6)


@query()
def out_of_fold(spark, sf_dir):
    """Every machine's probability by a model that has not seen it, and the threshold found on these."""
    rows = _machines(spark, sf_dir).select("machine_id", *_SENSORS, F.col("failure").alias("y"))
    found = models.cross_validate(rows, _SENSORS, "y", "machine_id", k=5)
    best = metrics.best_f1(found, score="p")
    return rounded(found.crossJoin(F.broadcast(best.select("threshold"))).select("machine_id", "fold", "y", "p", (F.col("p") >= F.col("threshold")).alias("alert")), 6)


@query()
def site_intervals(spark, sf_dir):
    """How far each nation's probability moves when the nations are drawn anew: p10, p90 and deviation."""
    means = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"), F.count(F.lit(1)).cast("double").alias("n"))
    hit = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.max("s_acctbal").alias("most"))
    rows = means.join(hit, F.col("c_nationkey") == F.col("s_nationkey")).select("c_nationkey", "balance", "n", (F.col("most") > 9000).cast("int").alias("y"))
    return rounded(models.bootstrap_intervals(rows, ["balance", "n"], "y", "c_nationkey", replicates=50), 6)


@query()
def permutation_drop(spark, sf_dir):
    """What average precision loses when a sensor's values are dealt out anew."""
    rows = _machines(spark, sf_dir).select("machine_id", *_SENSORS, F.col("failure").alias("y"))
    score = lambda x: scalars.sigmoid(x["torque"] * 0.1 + x["wear"] * 0.03 + x["rpm"] * 0.0 - 10)
    return rounded(metrics.permutation_importance(rows, ["torque", "wear", "rpm"], score, id_col="machine_id"), 6)


@query()
def top_drivers(spark, sf_dir):
    """The two sensors that matter most."""
    return scopes.ranked(permutation_drop(spark, sf_dir), "importance", "feature", n=2)


def _sources(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("p", F.least(F.lit(1.0), F.col("rain") / 400))
    return rows.select("site_id", "date", "rain", "p")


@query()
def recalibration(spark, sf_dir):
    """Platt scaling of each site's scores by its own labels, where it has years and extremes enough."""
    rows = validation.with_labels(_sources(spark, sf_dir), TRAIN_END)
    return rounded(models.recalibrate(rows.where(F.col("date") <= TRAIN_END), source="site_id", least_years=3.0, alert_rate=0.05), 6)


@query()
def external_validation(spark, sf_dir):
    """Scores at every site after the training years: raw, recalibrated and climatology, pooled and by site."""
    return rounded(validation.compare(_sources(spark, sf_dir), "1998-12-31", "2000-01-01", "2001-12-31", 0.05), 6)


@query()
def monotone_forecast(spark, sf_dir):
    """A probability that never falls with the rain: its value at each amount."""
    rows = labelled(spark, sf_dir).select("rain", "t2m", F.col("y_72h").alias("y")).dropna()
    model, coded = models.monotone_model(rows, ["rain"], ["t2m"])
    grid = rows.select("rain").distinct().withColumn("t2m", F.lit(30.0))
    return rounded(models.probability(model, coded(grid)).select("rain", "p"), 6)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY md5(o_orderkey || '/7'), o_orderkey LIMIT 3000")
def seeded_sample(spark, sf_dir):
    """3,000 orders that are the same on every run."""
    return models.seeded_sample(table(spark, sf_dir, "orders"), "o_orderkey", 3000).select("o_orderkey", "o_orderstatus")


def _forecast_rows(spark, sf_dir):
    """The trailing features of every day, and whether an extreme day comes within 72 hours."""
    days = filled(spark, sf_dir).withColumns({"ws2m": F.col("rh2m") / 10, "t2mdew": F.col("t2m") - F.col("rh2m") / 5})
    labels = labelled(spark, sf_dir).select("site_id", "date", F.col("y_72h").alias("y"))
    return series.weather_features(days).join(labels, ["site_id", "date"])


_RISING = ["rain_1d", "rain_3d", "rain_7d", "rain_14d", "rain_30d", "wet_days_7d", "rain_accel", "rh2m"]
_FALLING = ["dew_spread", "ps_anom", "ps_chg_1d", "ps_chg_3d"]


@query()
def monotone_boosted_forecast(spark, sf_dir):
    """Every day's probability by boosted trees that never fall with rain and moisture nor rise with dew spread and pressure."""
    rows = _forecast_rows(spark, sf_dir)
    names = [*_RISING, *_FALLING, "t2m", "doy_sin", "doy_cos"]
    model = boosting.fit(rows.where(F.col("date") <= TRAIN_END), names, rising=_RISING, falling=_FALLING, rounds=12, depth=3)
    return rounded(model.score(rows).select("site_id", "date", "y", "p"), 6)


@query()
def failure_kind_boosting(spark, sf_dir):
    """Boosted trees of the kind of failure, a tree a kind and round: the probability of each for every machine."""
    rows = _machines(spark, sf_dir)
    kind = F.when(F.col("PWF") == 1, 1).when(F.col("OSF") == 1, 2).when(F.col("TWF") == 1, 3).otherwise(0)
    rows = rows.select("machine_id", *_SENSORS, kind.alias("y"))
    model = boosting.fit(rows, _SENSORS, kind="multiclass", rounds=6, depth=3, classes=4)
    names = ("healthy", "PWF", "OSF", "TWF")
    scored = model.score(rows)
    return rounded(scored.select("machine_id", "y", *(F.col("p")[k].alias(n) for k, n in enumerate(names))), 6)


@query()
def forest_and_trees(spark, sf_dir):
    """A balanced forest and boosted trees on the same split: their scores on the rows held out."""
    rows = models.stratified_split(_machines(spark, sf_dir).select("machine_id", F.col("failure").cast("double").alias("y"), *_SENSORS, "type"), "y", "machine_id")
    rows = sinks.written(rows, "split")
    _, ready = models.prepared(rows.where("part < 2"), rows, _SENSORS, ["type"], ["y", "part"])
    train, test = ready.where("part < 2"), ready.where("part = 2")
    fits = {"forest": models.forest(30, "weight").fit(models.balanced_weights(train)), "trees": models.boosted(rounds=20).fit(train)}
    out = None
    for name, model in fits.items():
        part = metrics.binary_scores(models.probability(model, test), score="p").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 6)


@query()
def training_report(spark, sf_dir):
    """Learning from a table of machines as a whole: the comparison of the candidates on validation and test rows."""
    rows = _machines(spark, sf_dir).select("machine_id", "type", "air_temp", "process_temp", "rpm", "torque", "wear", "PWF", "OSF", "failure")
    return rounded(autolearn.report(autolearn.train(rows, "failure", "machine_id", rounds=10), spark), 4)


@query()
def table_predictions(spark, sf_dir):
    """Training, then every row scored with its main reason."""
    rows = _machines(spark, sf_dir).select("machine_id", "type", "air_temp", "process_temp", "rpm", "torque", "wear", "failure")
    return autolearn.predict(autolearn.train(rows, "failure", "machine_id", rounds=5), rows.drop("failure"), "machine_id")


_PLAN = f"""WITH {MACHINE_SQL}, f AS (SELECT wear, power > 9000 AS pwf, strain_ratio >= 0.9 AS osf, wear >= 230 AS twf FROM feature)
SELECT 'PWF' AS name, 'leakage' AS reason FROM f HAVING count(*) FILTER (pwf) >= 5
UNION ALL SELECT 'OSF', 'leakage' FROM f HAVING count(*) FILTER (osf) >= 5
UNION ALL SELECT 'TWF', 'leakage' FROM f HAVING count(*) FILTER (twf) >= 5
UNION ALL SELECT 'machine_id', 'id' FROM f HAVING count(*) > 20
UNION ALL SELECT 'one', 'constant' FROM f HAVING count(*) > 0
UNION ALL SELECT 'rare', 'over 60 % missing' FROM f HAVING avg(CASE WHEN wear % 50 = 0 THEN 0.0 ELSE 1.0 END) > 0.6"""


@query(_PLAN)
def training_plan(spark, sf_dir):
    """The columns that training would leave out, and why."""
    rows = _machines(spark, sf_dir).select(F.concat(F.lit("m"), F.col("machine_id")).alias("machine_id"), "type", "rpm", "torque", "wear", "PWF", "OSF", "TWF", F.lit("x").alias("one"), F.when(F.col("wear") % 50 == 0, F.col("rpm")).alias("rare"), "failure")
    found = autolearn.plan(rows, "failure")
    return spark.createDataFrame(sorted(found.excluded.items()), "name string, reason string")


@query(
    f"""WITH {SCORED_SQL}, s AS (SELECT toxic AS y, least(p, 1) AS p FROM scored), c AS (SELECT count(*) AS n, sum(y) AS failures, count(*) FILTER (WHERE y = 1 AND p >= 0.05) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.05) AS fp,
  count(*) FILTER (WHERE y = 1 AND p < 0.05) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.05) AS tn FROM s)
SELECT n, CAST(failures AS BIGINT) AS failures, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c"""
)
def self_score(spark, sf_dir):
    """A scored table that holds its labels is scored itself."""
    rows = scored(spark, sf_dir).select(F.col("toxic").alias("y"), F.least("p", F.lit(1.0)).alias("p"))
    return rounded(metrics.self_score(rows, 0.05).select("n", "failures", "tp", "fp", "fn", "tn", "precision", "recall"))


@query(
    f"""WITH {MACHINE_SQL}, k AS (SELECT type, count(*) AS n FROM machine GROUP BY type)
SELECT type, round(n / (SELECT count(*) FROM machine), 6) AS share, round((SELECT count(*) FROM machine) / (3.0 * n), 6) AS weight FROM k"""
)
def balanced_shares(spark, sf_dir):
    """The share and the balancing weight of each type."""
    rows = machine_rows(spark, sf_dir)
    weighted = models.balanced_weights(rows.select("type"), "type", classes=3)
    return weighted.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight")).crossJoin(rows.agg(F.count(F.lit(1)).alias("all"))).select("type", F.round(F.col("n") / F.col("all"), 6).alias("share"), "weight")
