"""Streams of two batches or more: late rows, alerts that enter and clear, enrichment, repeats, snapshots, a saved model."""

import datetime
import random

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from panelforge.operators import geo, models
from panelforge.sources import sinks
from panelforge.streaming import alerts

SCHEMA = "event_id long, ts timestamp, event_type string, value double"


def at(day, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=day)


class Feed:
    """A folder of files that arrive one after the other; each one is a batch of the stream."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, rows, schema=SCHEMA):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        self.n += 1

    def stream(self, schema=SCHEMA):
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, df, mode="append"):
        """All that has arrived since the last run, with the state kept from it."""
        out = f"{self.path}/out"
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{self.path}/state").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(180)
        self.state = [op.numRowsTotal for op in query.lastProgress.stateOperators] if query.lastProgress else []
        return self.spark.read.parquet(out)


@pytest.fixture
def feed(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return Feed(spark, tmp_path)


def test_late_rows_are_dropped_and_closed_days_are_whole(feed):
    feed.add([(1, at(0, 1), "a", 1.0), (2, at(0, 5), "a", 2.0), (3, at(3, 1), "a", 4.0)])
    totals = alerts.daily_totals(feed.stream())
    feed.run(totals)
    feed.add([(4, at(0, 2), "a", 100.0), (5, at(3, 2), "a", 8.0), (6, at(9), "a", 1.0)])  # day 0 has closed
    found = {(r.date, r.event_type): (r.total, r.n) for r in feed.run(alerts.daily_totals(feed.stream())).collect()}
    assert found == {(at(0).date(), "a"): (3.0, 2), (at(3).date(), "a"): (12.0, 2)}


def test_antecedent_sums_as_days_close(feed):
    feed.add([(i, at(i, 6), "a", float(i + 1)) for i in range(6)])
    feed.run(alerts.antecedent_totals(feed.stream(), 3))
    feed.add([(9, at(20), "a", 1.0)])
    found = {r.date: r.total for r in feed.run(alerts.antecedent_totals(feed.stream(), 3)).collect()}
    assert [found[at(d).date()] for d in range(6)] == [1, 3, 6, 9, 12, 15] and found[at(7).date()] == 6


def test_antecedent_sums_of_a_shuffled_feed_equal_the_batch(spark, feed):
    rng = random.Random(4)
    rows = [(i, at(rng.randrange(40), rng.randrange(24)), rng.choice("ab"), float(rng.randrange(9))) for i in range(150)]
    for low in range(0, 40, 10):  # within a batch in any order
        part = [r for r in rows if low <= (r[1] - at(0)).days < low + 10]
        rng.shuffle(part)
        feed.add(part)
        feed.run(alerts.antecedent_totals(feed.stream(), 10))
        assert feed.state[-1] <= 4 * 2 * 21, "one pane a key and day, and timers"
    feed.add([(999, at(80), "z", 0.0)])
    found = {(r.event_type, r.date): r.total for r in feed.run(alerts.antecedent_totals(feed.stream(), 10)).collect()}
    for key in "ab":
        for d in range(50):
            day = at(d).date()
            own = [r[3] for r in rows if r[2] == key and 0 <= (day - r[1].date()).days < 10]
            assert found.get((key, day)) == (sum(own) if own else None)


def test_alerts_enter_and_clear_over_batches(feed):
    feed.add([(1, at(0), "a", 5.0), (2, at(1), "a", 50.0), (3, at(2), "a", 60.0), (4, at(0), "b", 1.0)])
    feed.run(alerts.alert_changes(feed.stream(), 40.0))
    feed.add([(5, at(3), "a", 55.0), (6, at(4), "a", 3.0), (7, at(5), "b", 41.0)])  # a is still above, then clears
    feed.run(alerts.alert_changes(feed.stream(), 40.0))
    feed.add([(8, at(9), "c", 0.0)])
    found = sorted((r.event_type, r.ts, r.change, r.value) for r in feed.run(alerts.alert_changes(feed.stream(), 40.0)).collect())
    assert found == [("a", at(1), "enter", 50.0), ("a", at(4), "clear", 3.0), ("b", at(5), "enter", 41.0)]


def test_alerts_of_late_rows_equal_the_ordered_feed(feed):
    rng = random.Random(6)
    rows = [(i, at(i // 4, rng.randrange(24)), rng.choice("abc"), float(rng.randrange(100))) for i in range(240)]
    want = []
    for key in "abc":
        above = False
        for _, ts, _, value in sorted((r for r in rows if r[2] == key), key=lambda r: (r[1], r[3])):
            if (value >= 60) != above:
                above = not above
                want.append((key, ts, "enter" if above else "clear", value))
    arrival = sorted(rows, key=lambda r: r[1] + datetime.timedelta(hours=rng.randrange(40)))  # up to two days late
    for k in range(0, 240, 60):
        feed.add([*arrival[k : k + 60], *arrival[k : k + 2]])
    feed.add([(900, at(75), "z", 0.0)])
    out = feed.run(alerts.alert_changes(feed.stream(), 60.0, late="3 days", idle_days=30))
    assert sorted((r.event_type, r.ts, r.change, r.value) for r in out.collect()) == sorted(want)


def test_state_of_silent_keys_is_removed(feed):
    feed.add([(1, at(0), "a", 50.0), (2, at(0), "b", 1.0), (3, at(1), "b", None)])
    feed.run(alerts.alert_changes(feed.stream(), 40.0, idle_days=5))
    feed.add([(4, at(20), "z", 1.0)])
    feed.run(alerts.alert_changes(feed.stream(), 40.0, idle_days=5))
    feed.add([(5, at(40), "z", 1.0)])
    found = sorted((r.event_type, r.ts, r.change, r.value) for r in feed.run(alerts.alert_changes(feed.stream(), 40.0, idle_days=5)).collect())
    assert found == [("a", at(0), "enter", 50.0), ("a", at(5), "clear", None)]
    assert feed.state[0] <= 6, "only z is left, with its reading and timers"


def test_enrichment_keeps_unknown_keys(spark, feed):
    feed.add([(1, at(0), "a", 5.0), (2, at(0), "?", 6.0)])
    sites = spark.createDataFrame([("a", 4.0)], "event_type string, threshold double")
    found = feed.run(alerts.enriched(feed.stream(), sites, "event_type"))
    assert {(r.event_id, r.threshold) for r in found.collect()} == {(1, 4.0), (2, None)}


def test_repeats_within_and_across_batches(feed):
    feed.add([(1, at(0), "a", 5.0), (1, at(0), "a", 5.0), (2, at(0), "a", 6.0)])
    feed.run(alerts.without_repeats(feed.stream(), "event_id"))
    feed.add([(2, at(0, 3), "a", 6.0), (3, at(0, 4), "a", 7.0)])
    found = feed.run(alerts.without_repeats(feed.stream(), "event_id"))
    assert sorted(r.event_id for r in found.collect()) == [1, 2, 3]
    assert {(r.event_type, r.event_id) for r in alerts.latest(found, "event_type").collect()} == {("a", 3)}


def test_proximity_snapshots_by_batch(spark, feed, tmp_path):
    schema = "event_id long, lat double, lon double"
    sites = spark.createDataFrame([(1, 10.0, 10.0), (2, -40.0, 100.0)], "site_id long, lat double, lon double")
    batches = [[(7, 10.5, 10.0), (8, 12.0, 10.0)], [(9, -40.0, 100.2)]]
    for rows in batches:
        feed.add(rows, schema)
    alerts.proximity_snapshots(feed.stream(schema), sites, f"{tmp_path}/near", f"{tmp_path}/near-state").awaitTermination(180)
    found = {(r.batch_id, r.site_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/near").collect()}
    expected = {(b, r.site_id, r.event_id) for b, rows in enumerate(batches) for r in geo.nearest(sites, spark.createDataFrame(rows, schema)).collect()}
    assert {x[1:] for x in found} == {x[1:] for x in expected} == {(1, 7), (2, 9)}


def test_a_saved_model_scores_a_stream(spark, feed, tmp_path):
    from pyspark.ml import Pipeline

    rows = spark.createDataFrame([(float(i), float(i > 20)) for i in range(40)], "value double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["value"], outputCol="features"), LogisticRegression(labelCol="y", regParam=0.01)]).fit(rows)
    sinks.save_model(model, f"{tmp_path}/bundle", ["value"], 0.5, ["wear"])
    loaded, about = sinks.load_model(spark, f"{tmp_path}/bundle")
    assert (about.features, about.threshold, about.modes) == (["value"], 0.5, ["wear"])
    feed.add([(1, at(0), "a", 2.0), (2, at(0), "a", 39.0)])
    scored = alerts.scored(feed.stream(), lambda df: models.probability(loaded, df), about.threshold).select("event_id", "p", "alert")
    found = {r.event_id: r for r in feed.run(scored).collect()}
    batch = {r.event_id: r.p for r in models.probability(loaded, spark.read.parquet(f"{feed.path}/in")).collect()}
    assert {k: r.p for k, r in found.items()} == pytest.approx(batch) and not found[1].alert and found[2].alert
