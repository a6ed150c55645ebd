"""Streams of readings (key, ts, value): windows, alerts, enrichment, snapshots and scoring.

Late data: rows older than the watermark are dropped. State is kept by key and, for windows, panes and alerts, as
long as the watermark says; nothing here keeps all of a key's history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelforge.operators import geo

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def timed(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """With ``ts`` as a timestamp that watermarks take."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def daily_totals(stream: DataFrame, key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Tumbling totals of each key and day."""
    days = timed(stream, ts).groupBy(F.window(ts, "1 day"), key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    return days.select(F.to_date("window.start").alias("date"), key, "total", "n")


class PaneSums(StatefulProcessor):
    """Sums of a key's last ``days`` daily totals, for each day as it closes; a total goes when no later day needs it."""

    def __init__(self, days: int, key: str):
        self.days, self.key = days, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.panes = handle.getMapState("panes", "day int", "total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for frame in rows:
            for day, total in zip(frame["day"], frame["total"], strict=True):
                self.panes.updateValue((int(day),), (float(total),))
                timers |= {(int(day) + 1 + i) * DAY_MS for i in range(self.days)}
        for at in timers:  # a day's sum is due at its end; equal timers are one
            self.handle.registerTimer(at)
        yield self._table([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        kept = [(d, self.panes.getValue((d,))[0]) for d in range(day - self.days + 1, day + 1) if self.panes.containsKey((d,))]
        if self.panes.containsKey((day - self.days + 1,)):
            self.panes.removeKey((day - self.days + 1,))
        yield self._table([(day, key[0], sum(v for _, v in kept))] if kept else [])

    def _table(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["day", self.key, "total"]).astype({"day": "int32", "total": "float64"})

    def close(self) -> None:
        pass


def antecedent_totals(stream: DataFrame, days: int, key: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Sums of the last ``days`` days, for each day as it closes that has a reading among them.

    Readings are added up to daily panes, and a second operator on the stream sums the panes, so the state has one row a
    key and day, whatever ``days`` is. Days are those of UTC. Needs the RocksDB state store.
    """
    kind = stream.schema[key].dataType.simpleString()
    panes = timed(stream, ts).where(F.col(value).isNotNull()).groupBy(F.window(ts, "1 day"), key).agg(F.sum(F.col(value).cast("double")).alias("total"))
    panes = panes.select(F.window_time("window").alias("at"), key, F.floor(F.unix_seconds("window.start") / 86_400).cast("int").alias("day"), "total")
    sums = panes.groupBy(key).transformWithStateInPandas(PaneSums(days, key), f"day int, `{key}` {kind}, total double", "Append", "EventTime")
    return sums.select(F.date_from_unix_date("day").alias("date"), key, "total")


class Alerts(StatefulProcessor):
    """Says when a key's value enters or leaves the zone above its threshold, in the order of event time.

    Readings wait until the watermark has passed them, so those that come late but in time take their place. A timer is
    set for the end of the hour of a reading. A key that is silent for ``idle_ms`` is forgotten; an alert that stands is
    then cleared without a value.
    """

    def __init__(self, threshold: float, key: str, ts: str, value: str, idle_ms: int):
        self.threshold, self.key, self.ts, self.value, self.idle_ms = threshold, key, ts, value, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.zone = handle.getValueState("zone", "above boolean, last long")
        self.waiting = handle.getMapState("waiting", "at long, value double", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for frame in rows:
            for at, value in zip(pd.to_datetime(frame[self.ts]).astype("datetime64[us]").astype("int64"), frame[self.value], strict=True):
                self.waiting.updateValue((int(at), float(value)), (1,))
                timers.add((int(at) // 1000 // HOUR_MS + 1) * HOUR_MS)
        for at in timers:
            self.handle.registerTimer(at)
        yield self._table([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        above, last = self.zone.get() if self.zone.exists() else (False, None)
        found = []
        for at, value in sorted((k[0], k[1]) for k in self.waiting.keys() if k[0] <= passed):
            now = value >= self.threshold
            if now != above:
                found.append((key[0], pd.Timestamp(at, unit="us"), "enter" if now else "clear", value))
            above, last = now, at
            self.waiting.removeKey((at, value))
        if last is not None:
            end = last // 1000 + self.idle_ms
            if expiredTimerInfo.getExpiryTimeInMs() >= end and not any(True for _ in self.waiting.keys()):
                if above:
                    found.append((key[0], pd.Timestamp(end, unit="ms"), "clear", None))
                self.zone.clear()
            else:
                self.zone.update((bool(above), int(last)))
                self.handle.registerTimer(end)
        yield self._table(found)

    def _table(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, self.ts, "change", self.value]).astype({self.ts: "datetime64[us]", self.value: "float64"})

    def close(self) -> None:
        pass


def alert_changes(stream: DataFrame, threshold: float, key: str = "event_type", ts: str = "ts", value: str = "value", late: str = "1 day", idle_days: float = 30) -> DataFrame:
    """key, ts, change (enter or clear) and value, once no earlier reading can come any more; needs the RocksDB state store.

    Readings older than the watermark are dropped, and so are those without a value or time. Of equal times the smaller
    value comes first.
    """
    kind = stream.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{ts}` timestamp, change string, `{value}` double"
    rows = stream.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    processor = Alerts(threshold, key, ts, value, int(idle_days * DAY_MS))
    return rows.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def enriched(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Readings with the attributes of their key; keys that the table lacks keep nulls."""
    return stream.join(static, key, "left")


def without_repeats(stream: DataFrame, id_col: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each id once, as long as its repeats come within the watermark."""
    return timed(stream, ts, late).dropDuplicatesWithinWatermark([id_col])


def latest(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The newest row of each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), ts).alias("x")).select(key, "x.*")


def proximity_snapshots(events: DataFrame, sites: DataFrame, path: str, checkpoint: str, radius_km: float = 500.0):
    """Append, for each batch of events, the nearest one of each site."""

    def snapshot(batch: DataFrame, batch_id: int) -> None:
        found = geo.nearest(sites, batch, radius_km).withColumn("batch_id", F.lit(batch_id))
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(snapshot).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Readings with ``p`` by a saved model and whether it alerts."""
    return score(stream).withColumn("alert", F.col("p") >= threshold)
