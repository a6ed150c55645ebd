"""Quad-tree leaves against all pairs, and sketched profiles against exact ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import geo, profile


def km(a, b):
    (p, q), (r, s) = (map(math.radians, x) for x in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))


def places(seed):
    """A city, its surroundings, the date line, the poles, repeated spots and rows without a place."""
    rng = random.Random(seed)
    city = [(28.6 + rng.gauss(0, 0.05), 77.2 + rng.gauss(0, 0.05)) for _ in range(300)]
    wide = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    line = [(rng.uniform(-20, 20), rng.choice([179.9, -179.9, 180.0, -180.0])) for _ in range(30)]
    pole = [(rng.choice([89.9, -89.9, 90.0]), rng.uniform(-180, 180)) for _ in range(20)]
    return [*city, *[(28.6, 77.2)] * 40, *wide, *line, *pole]


@pytest.mark.parametrize(("radius", "most"), [(500.0, 7), (30.0, 7), (2000.0, 25), (500.0, 10**6)])
def test_nearby_and_nearest_equal_all_pairs(spark, radius, most):
    events, sites = places(1), [(28.55, 77.25), (28.0, 75.0), (33.0, 77.0), (0.0, 179.95), (0.0, -180.0), (90.0, 0.0), (-89.95, 10.0), (10.0, 10.0)]
    e = spark.createDataFrame([*((i, *x) for i, x in enumerate(events)), (998, None, 1.0)], "event_id int, lat double, lon double")
    s = spark.createDataFrame([*((i, *x) for i, x in enumerate(sites)), (99, None, None)], "site_id int, lat double, lon double")
    want = {(i, j): km(a, b) for i, a in enumerate(sites) for j, b in enumerate(events) if km(a, b) <= radius}
    found = {(r.site_id, r.event_id): r.distance_km for r in geo.nearby(s, e, radius, most=most).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 for k in want)
    best = {}
    for (i, j), d in sorted(want.items(), key=lambda x: (x[0][0], round(x[1], 9), x[0][1])):
        best.setdefault(i, d)
    near = {r.site_id: r.distance_km for r in geo.nearest(s, e, radius, most=most).collect()}
    assert near.keys() == best.keys() and all(abs(near[k] - best[k]) < 1e-6 for k in best)


def test_leaves_are_bounded_and_whole(spark):
    events = places(2)
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(events)], "event_id int, lat double, lon double")
    placed = geo.in_leaves(e, 4.5, most=10)
    assert placed.count() == len(events)
    spots = placed.groupBy("__leaf").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lat", "lon").alias("spots")).collect()
    assert max(r.n for r in spots if r.spots > 1) <= 10 + 40 and sum(r.n > 10 for r in spots) <= 2
    assert geo.in_leaves(e.where("false"), 4.5).count() == 0
    assert geo.nearest(e.where("false").withColumnRenamed("event_id", "site_id"), e).count() == 0


def test_a_site_meets_few_events_of_a_city(spark):
    rng = random.Random(3)
    city = [(i, 28.6 + rng.gauss(0, 0.2), 77.2 + rng.gauss(0, 0.2)) for i in range(3000)]
    e = spark.createDataFrame(city, "event_id int, lat double, lon double")
    s = spark.createDataFrame([(1, 28.6, 77.2), (2, 29.9, 78.0)], "site_id int, lat double, lon double")
    found = {r.site_id: r.event_id for r in geo.nearest(s, e, most=20).collect()}
    assert found == {i: min(city, key=lambda x: km(x[1:], at))[0] for i, at in ((1, (28.6, 77.2)), (2, (29.9, 78.0)))}


# Profiles.


def test_sketched_profiles_give_the_same_roles(spark):
    n = 3000
    df = spark.range(n).select(
        F.col("id").alias("counter"), (F.col("id") * 7).alias("sparse"), F.concat(F.lit("m"), "id").alias("name"), F.concat(F.lit("m"), F.col("id") % (n - 1)).alias("almost"),
        F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"), (F.col("id") % 2).alias("flag"), (F.col("id") % 20).alias("twenty"), (F.col("id") % 21).cast("string").alias("texts"),
        (F.col("id") % 997 / 3).alias("number"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("day"), F.when(F.col("id") % 3 == 0, "x").otherwise(" ").alias("blank"), F.lit(2).alias("a.b"),
    )
    exact, sketched = ({r["name"]: r for r in profile.profile(df, exact=x).collect()} for x in (True, False))
    assert {k: r.kind for k, r in exact.items()} == {k: r.kind for k, r in sketched.items()}
    for k in ("counter", "name", "almost", "one", "none", "flag", "twenty", "texts", "blank", "a.b"):
        assert exact[k] == sketched[k]
    assert abs(sketched["number"].unique - 997) < 100 and exact["number"].unique == 997
    assert {r["name"]: r.kind for r in profile.profile(df.where("false"), exact=False).collect()} == {r["name"]: r.kind for r in profile.profile(df.where("false")).collect()}
