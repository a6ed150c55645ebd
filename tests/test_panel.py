"""The registered queries against DuckDB, and operators that SQL can't check against plain Python."""

import datetime
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge import catalog, catalog_models, catalog_sources, catalog_values  # noqa: F401 - registered on import
from panelforge.functions import scalars
from panelforge.operators import geo, machines, metrics, models, profile, series
from panelforge.sources import readers, sinks
from panelforge.streaming import alerts

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(relation.columns) == columns
    ours = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    theirs = sorted(str(tuple(plain(x) for x in r)) for r in relation.select(*(f'"{c}"' for c in columns)).fetchall())
    assert ours == theirs


def test_haversine_and_compass(spark):
    row = spark.range(1).select(
        scalars.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km"),
        scalars.compass(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("ne"),
        scalars.compass(F.lit(0.0), F.lit(179.0), F.lit(0.0), F.lit(-179.0)).alias("e"),
        scalars.vulnerability(F.lit(0.25), F.lit(0.5), F.lit(0.1), F.lit(0.0), F.lit(0.2)).alias("v"),
        scalars.date_range(F.lit("2023-01-02 to 2023-01-08")).alias("d"),
        scalars.dew_point(F.lit(20.0), F.lit(100.0)).alias("dew"),
        scalars.name_tokens(F.lit("Wind Speed_10m")).alias("t"),
    ).first()
    assert row.km == pytest.approx(math.pi / 2 * scalars.EARTH_KM) and (row.ne, row.e) == ("NE", "E")
    assert row.v == pytest.approx(50) and row.d.end == datetime.date(2023, 1, 8) and row.dew == pytest.approx(20)
    assert row.t == ["wind", "speed", "10m", "windspeed", "speed10m"]


def test_nearby_is_the_cross_join(spark):
    rng = random.Random(1)
    place = lambda i: (i, rng.uniform(-90, 90), rng.uniform(-180, 180))
    sites = [*map(place, range(40)), (100, 89.9, 10.0), (101, 0.0, 179.9)]
    events = [*map(place, range(300)), (900, 89.9, -170.0), (901, 0.0, -179.9)]
    a = spark.createDataFrame(sites, "site_id long, lat double, lon double")
    b = spark.createDataFrame(events, "event_id long, lat double, lon double")
    far = a.select("site_id", F.col("lat").alias("a"), F.col("lon").alias("o")).crossJoin(b)
    km = scalars.haversine_km(F.col("a"), F.col("o"), F.col("lat"), F.col("lon"))
    expected = {(r.site_id, r.event_id) for r in far.where(km <= 2000).collect()}
    found = [(r.site_id, r.event_id) for r in geo.nearby(a, b, 2000.0).collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert (100, 900) in expected and (101, 901) in expected


def test_slope_of_a_plane(spark):
    grid = spark.createDataFrame([("a", i, j, 10.0 * i) for i in range(5) for j in range(5)], "site_id string, i int, j int, elev double")
    assert geo.mean_slope(grid, 10.0).first().mean_slope == pytest.approx(45)


def test_value_curve_identities(spark):
    rows = [(int(i % 4 == 3),) for i in range(100)]
    df = spark.createDataFrame(rows, "y int").withColumn("score", F.col("y").cast("double"))
    assert all(r.value == pytest.approx(1) for r in metrics.value_curve(df, (0.1, 0.5)).collect())
    constant = metrics.value_curve(df.withColumn("score", F.lit(0.25)), (0.1, 0.5))
    assert all(r.value == pytest.approx(0) for r in constant.collect())


def test_auc_with_ties_and_one_label(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.3), ("a", None, 0.2), ("a", 1, None)]
    df = spark.createDataFrame(rows, "k string, y int, score double")
    found = {r.k: r.roc_auc for r in metrics.roc_auc(df, keys=["k"]).collect()}
    assert found == {"a": pytest.approx(0.875), "b": None}


def test_machine_rules(spark):
    df = spark.createDataFrame(
        [(1, "L", 300.0, 310.0, 1500.0, 40.0, 0), (2, "L", 300.0, 308.0, 1300.0, 40.0, 0), (3, "H", 300.0, 310.0, 2800.0, 60.0, 10), (4, "L", 300.0, 310.0, 1500.0, 50.0, 210)],
        "machine_id int, type string, air_temp double, process_temp double, rpm double, torque double, wear int",
    )
    found = {r.machine_id: r.modes for r in machines.mechanisms(machines.features(df)).collect()}
    assert found == {1: [], 2: ["HDF"], 3: ["PWF"], 4: ["OSF", "TWF"]}
    path = machines.project(df, lambda x: x.withColumn("p", F.col("strain_ratio") - F.col("k") % 2), 0.9).where("machine_id = 1").orderBy("k").collect()
    assert all(a.p <= b.p for a, b in zip(path, path[1:], strict=False)) and len(path) == 131
    assert spark.range(1).select(machines.runs_to_window(F.lit(60), F.lit(2))).first()[0] == 70


def test_grouped_logistic_is_newton(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(size=(400, 2)), rng.integers(0, 2, 400)
    y = (x[:, 0] + 0.5 * x[:, 1] * (g + 1) + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, int(g[i]), float(x[i, 0]), float(x[i, 1]), int(y[i])) for i in range(400)], "id int, fold int, a double, b double, y int")
    for fit in models.fit_logistic_groups(df, ["a", "b"]).collect():
        own = x[g == fit.fold]
        z = np.c_[(own - own.mean(0)) / own.std(0), np.ones(len(own))]
        beta = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-z @ beta))
            grad = z.T @ (y[g == fit.fold] - p) - np.r_[beta[:2], 0]
            beta = beta + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1, 1, 0]), grad)
        assert np.allclose([*fit.coefficients, fit.intercept], beta, atol=1e-6)
    scored = models.cross_validate(df.drop("fold"), ["a", "b"], "y", "id")
    assert scored.count() == 400 and metrics.roc_auc(scored, score="p").first().roc_auc > 0.8


def test_splits_are_disjoint(spark):
    df = spark.range(300).select("id", (F.col("id") % 5 == 0).cast("int").alias("y"))
    parts = models.stratified_split(df, "y", "id").groupBy("part", "y").count().collect()
    assert {(r.part, r.y): r["count"] for r in parts}[0, 1] in (36, 37) and sum(r["count"] for r in parts) == 300
    assert models.stratified_sample(df, "y", "id").where("y = 1").count() >= 8


def test_profile_roles(spark):
    rows = [(i, "x", i % 2, float(i * i % 17) / 3, f"2020-01-{i % 28 + 1:02d}", ["a", "b", "c"][i % 3], None if i % 10 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "n long, one string, flag int, x double, day string, kind string, rare double")
    found = {r["name"]: r.kind for r in profile.profile(df).collect()}
    assert found == {"n": "id", "one": "constant", "flag": "binary", "x": "numeric", "day": "datetime", "kind": "categorical", "rare": "constant"}
    assert {r["name"]: r.reason for r in profile.exclusions(df, "flag").collect()} == {"n": "id", "one": "constant", "rare": "constant"}
    assert profile.suggest_target(profile.profile(df), df.columns).first().target == "flag"
    assert profile.task_of(df, "flag").first().asDict() == {"classes": 2, "task": "binary", "positive": "1"}


def test_readers_agree_on_encodings(spark, tmp_path):
    days = [datetime.date(2021, 1, 1) + datetime.timedelta(i) for i in range(40)]
    files = {
        "plain.csv": "date,rain\n" + "".join(f"{d},{i}.5\n" for i, d in enumerate(days)),
        "preamble.csv": "latitude,30\nunits,mm\n\ntime;rain\n" + "".join(f"{d}T00:00;{i}.5\n" for i, d in enumerate(days)),
        "power.csv": "-BEGIN HEADER-\nsome text\n-END HEADER-\nYEAR,DOY,RAIN\n" + "".join(f"2021,{d.timetuple().tm_yday},{i}.5\n" for i, d in enumerate(days)),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    cells = readers.read_with_preamble(spark, f"{tmp_path}/*.csv")
    rows = cells.select("file", readers.date_of(F.col("cells")).alias("date"), readers.quantity(F.col("cells"), "rain", "mm", "mm").alias("rain"))
    groups = rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("date", "rain"))).alias("x")).collect()
    assert len(groups) == 3 and all([(r.date, r.rain) for r in g.x] == [(d, i + 0.5) for i, d in enumerate(days)] for g in groups)
    assert readers.sniff_delimiter(spark, f"{tmp_path}/plain.csv") == ","


def test_json_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"properties": {"parameter": {"T2M": {"20200101": 3.5, "20200102": -999}, "PS": {"20200101": 90.0}}}}')
    (tmp_path / "o.json").write_text('{"daily": {"time": ["2020-01-01", "2020-01-02"], "precipitation_sum": [1.5, null]}}')
    power = {r.date.day: (r.t2m, r.ps) for r in readers.read_power_json(spark, f"{tmp_path}/p.json").collect()}
    assert power == {1: (3.5, 90.0), 2: (None, None)}
    assert [r.rain for r in readers.read_parallel_json(spark, f"{tmp_path}/o.json").orderBy("date").collect()] == [1.5, 0.0]


def test_runs_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "id int, p double")
    sinks.append_run(df, f"{tmp_path}/runs", "r1", "2024-01-01")
    sinks.append_run(df.where("id = 2"), f"{tmp_path}/runs", "r2", "2024-02-01")
    assert [r.id for r in sinks.current_run(spark, f"{tmp_path}/runs").collect()] == [2]
    assert sinks.report(df).first().report == '{"id":1,"p":null}'


def test_streams_match_batches(spark, tmp_path):
    path = f"{tmp_path}/events"
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    totals = alerts.daily_totals(stream)
    q = totals.writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.read.parquet(path).groupBy(F.to_date("ts").alias("date"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    ours = {(r.date, r.event_type): r.n for r in spark.table("daily").collect()}
    assert ours == {(r.date, r.event_type): r.n for r in batch.collect()}


def test_series_guards(spark):
    day = datetime.date(2020, 1, 1)
    rows = [("a", day, 1.0), ("a", day + datetime.timedelta(3), 2.0), ("a", day + datetime.timedelta(4), None)]
    df = series.fill_days(spark.createDataFrame(rows, "site_id string, date date, rain double"))
    found = df.select("site_id", "date", series.rolling_sum(F.col("rain"), 2, series.by_date()).alias("s"), "rain").orderBy("date")
    found = series.antecedent_sums(found, "rain", [4]).withColumnRenamed("rain_4d", "a").orderBy("date").collect()
    assert [r.s for r in found] == [None] * 5 and [r.a for r in found] == [1.0, 1.0, 1.0, 3.0, 2.0]


def test_leave_one_site_out(spark):
    rows = catalog.labelled(spark, DATA).select("site_id", "date", "rain", "t2m", F.col("y_72h").alias("y")).toPandas()
    found = catalog.QUERIES["leave_one_site_out"](spark, DATA).toPandas()
    known = rows.dropna(subset=["rain", "t2m"])
    assert len(found) == len(known) > 0
    site = found.site_id.iloc[0]
    train = known[(known.site_id != site) & (known.date.astype(str) <= catalog.TRAIN_END)].dropna(subset=["y"])
    x, y = train[["rain", "t2m"]].to_numpy(float), train.y.to_numpy(float)
    mean, std = x.mean(0), x.std(0)
    z, beta = np.c_[(x - mean) / std, np.ones(len(x))], np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta = beta + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1, 1, 1e-12]), z.T @ (y - p) - np.r_[beta[:2], 0])
    own = found[found.site_id == site].merge(known, on=["site_id", "date"])
    wanted = 1 / (1 + np.exp(-np.c_[(own[["rain", "t2m"]].to_numpy(float) - mean) / std, np.ones(len(own))] @ beta))
    assert np.allclose(own.p, wanted, atol=2e-6)


def test_monotone_model_never_falls(spark):
    rng = np.random.default_rng(5)
    x = rng.random((500, 2))
    y = (x[:, 0] + 0.4 * rng.normal(size=500) > 0.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    model, coded = models.monotone_model(df, ["a"], ["b"])
    grid = spark.range(51).select((F.col("id") / 50).alias("a"), F.lit(0.5).alias("b"))
    p = [r.p for r in models.probability(model, coded(grid)).orderBy("a").collect()]
    assert all(u <= v + 1e-12 for u, v in zip(p, p[1:], strict=False)) and p[-1] > p[0] + 0.2
