"""Places: nearest events, storm tracks, and pixel and terrain summaries."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars
from panelforge.sources import sinks

KM_PER_DEGREE = 2 * math.pi * scalars.EARTH_KM / 360


def _cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    """Row and column of a grid; columns wrap around at 180 degrees."""
    across = math.floor(360 / degrees)
    return F.floor((lat + 90) / degrees), F.pmod(F.floor((lon + 180) / 360 * across), F.lit(across))


#: Events of a leaf at most, and how often a cell is cut in four for it; events at one spot may be more.
LEAF_EVENTS, LEAF_LEVELS = 1000, 14


def _reached(sites: DataFrame, radius_km: float, site: str) -> tuple[DataFrame, float]:
    """Sites with each cell (``__r``, ``__c``) that their radius reaches: fewer columns near the equator, all at the poles."""
    degrees = max(radius_km / KM_PER_DEGREE * 1.0001, 0.05)
    across = math.floor(360 / degrees)
    lat, lon = F.col("lat"), F.col("lon")
    row, column = _cell(lat, lon, degrees)
    # The widest column difference at the highest latitude the radius reaches.
    top = F.least(F.abs(lat) + degrees, F.lit(90.0))
    wide = F.least(F.ceil(F.lit(degrees) / F.greatest(F.cos(F.radians(top)), F.lit(1e-9)) / (360 / across)) + 1, F.lit(across // 2 + 1))
    cells = sites.select(F.col(site), lat.alias("__lat"), lon.alias("__lon"), row.alias("__row"), column.alias("__column"), wide.cast("int").alias("__wide"))
    cells = cells.withColumn("__r", F.explode(F.sequence(F.col("__row") - 1, F.col("__row") + 1)))
    steps = F.array_distinct(F.transform(F.sequence(-F.col("__wide"), F.col("__wide")), lambda i: F.pmod(F.col("__column") + i, F.lit(across))))
    return cells.withColumn("__c", F.explode(steps)), degrees


def in_leaves(events: DataFrame, degrees: float, most: int = LEAF_EVENTS, levels: int = LEAF_LEVELS) -> DataFrame:
    """Events with their cell (``__r``, ``__c``) and the ``__leaf`` of its quad-tree: cells of over ``most`` events are cut in four.

    Each level counts the events of crowded cells only. Crowded cells are at most a ``most``-th of the events in number.
    """
    lat, lon = F.col("lat"), F.col("lon")
    r, c = _cell(lat, lon, degrees)
    across = math.floor(360 / degrees)
    placed = events.where(lat.isNotNull() & lon.isNotNull()).withColumns({"__r": r, "__c": c})

    def path(level: int) -> Column:
        """The cell, and the quarter within it at each level down to ``level``."""
        n = 1 << level
        inner = [F.floor(F.pmod((lat + 90) / degrees, F.lit(1.0)) * n), F.floor(F.pmod((lon + 180) / 360 * across, F.lit(1.0)) * n)]
        return F.concat_ws("/", "__r", "__c", F.lit(level), *inner)

    leaf, crowded = path(0), placed.withColumn("__leaf", path(0))
    for level in range(1, levels + 1):
        full = sinks.written(crowded.groupBy("__leaf").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select("__leaf"), "crowded-cells")
        if full.isEmpty():
            break
        marked = full.select(F.col("__leaf").alias("__full"))
        placed = placed.join(marked, path(level - 1) == F.col("__full"), "left").withColumn(f"__in{level}", F.col("__full").isNotNull()).drop("__full")
        leaf = F.when(F.col(f"__in{level}"), path(level)).otherwise(leaf)
        crowded = placed.where(F.col(f"__in{level}")).withColumn("__leaf", path(level))
    return placed.withColumn("__leaf", leaf).select(*events.columns, "__r", "__c", "__leaf")


def _least_km(lat: Column, lon: Column, box: Column) -> Column:
    """A distance that no point of a box of latitudes and longitudes is nearer than."""
    apart = F.greatest(box["south"] - lat, lat - box["north"], F.lit(0.0)) * KM_PER_DEGREE
    east, west = F.pmod(box["west"] - lon, F.lit(360.0)), F.pmod(lon - box["east"], F.lit(360.0))
    turn = F.when((lon >= box["west"]) & (lon <= box["east"]), 0.0).otherwise(F.least(east, west, F.lit(180.0)))
    high = F.greatest(F.abs(lat), F.abs(box["south"]), F.abs(box["north"]))
    around = 2 * scalars.EARTH_KM * F.asin(F.least(F.lit(1.0), F.cos(F.radians(high)) * F.sin(F.radians(turn / 2))))
    return F.greatest(apart, around) * (1 - 1e-9) - 1e-6


def _leaves(placed: DataFrame, event: str) -> DataFrame:
    """One row for each leaf: its cell, its box, and one of its events."""
    box = F.struct(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east")).alias("__box")
    return placed.groupBy("__r", "__c", "__leaf").agg(box, F.min(F.struct(event, "lat", "lon")).alias("__some"))


def _pairs(near: DataFrame, placed: DataFrame, radius_km: float, site: str, event: str) -> DataFrame:
    """Sites that meet leaves, with the events of these within the radius."""
    lat, lon = F.col("lat"), F.col("lon")
    km = scalars.haversine_km(F.col("__lat"), F.col("__lon"), lat, lon)
    found = near.select(site, "__lat", "__lon", "__leaf").join(placed, "__leaf").withColumn("distance_km", km).where(F.col("distance_km") <= radius_km)
    return found.withColumn("bearing", scalars.compass(F.col("__lat"), F.col("__lon"), lat, lon)).select(site, event, "distance_km", "bearing")


def nearby(sites: DataFrame, events: DataFrame, radius_km: float = 500.0, site: str = "site_id", event: str = "event_id", most: int = LEAF_EVENTS) -> DataFrame:
    """Pairs of sites and events (each with lat, lon) at most ``radius_km`` apart, by equality joins.

    A site meets the quad-tree leaves of the grid cells that its radius reaches, then the events of the leaves that
    may lie within it, so a crowded cell is dealt out in leaves of some ``most`` events. Rows without a place have no pairs.
    """
    cells, degrees = _reached(sites, radius_km, site)
    placed = sinks.written(in_leaves(events, degrees, most), "placed-events")
    near = cells.join(_leaves(placed, event), ["__r", "__c"]).where(_least_km(F.col("__lat"), F.col("__lon"), F.col("__box")) <= radius_km)
    return _pairs(near, placed, radius_km, site, event)


def nearest(sites: DataFrame, events: DataFrame, radius_km: float = 500.0, site: str = "site_id", event: str = "event_id", most: int = LEAF_EVENTS) -> DataFrame:
    """The nearest event of each site within the radius; ties by event.

    Of the leaves that a site reaches, only those that may hold something nearer than one event of each are searched.
    """
    cells, degrees = _reached(sites, radius_km, site)
    placed = sinks.written(in_leaves(events, degrees, most), "placed-events")
    lat, lon = F.col("__lat"), F.col("__lon")
    met = cells.join(_leaves(placed, event), ["__r", "__c"]).withColumns({"__least": _least_km(lat, lon, F.col("__box")), "__most": scalars.haversine_km(lat, lon, F.col("__some.lat"), F.col("__some.lon"))})
    met = sinks.written(met.where(F.col("__least") <= radius_km).select(site, "__lat", "__lon", "__leaf", "__least", "__most"), "sites-and-leaves")
    limit = met.groupBy(site, "__lat", "__lon").agg(F.min("__most").alias("__limit"))
    a, b = met.alias("a"), limit.alias("b")
    same = (F.col(f"a.{site}").eqNullSafe(F.col(f"b.{site}"))) & (F.col("a.__lat") == F.col("b.__lat")) & (F.col("a.__lon") == F.col("b.__lon"))
    near = a.join(b, same).where(F.col("__least") <= F.col("__limit")).select(*(F.col(f"a.{c}").alias(c) for c in (site, "__lat", "__lon", "__leaf")))
    pairs = _pairs(near, placed, radius_km, site, event)
    least = F.min(F.struct("distance_km", event, "bearing")).alias("x")
    return pairs.groupBy(site).agg(least).select(site, f"x.{event}", "x.distance_km", "x.bearing")


def closest_track_point(sites: DataFrame, points: DataFrame, since: Column, until: Column, least_kn: float = 48.0, radius_km: float = 500.0, site: str = "site_id", point: str = "point_id") -> DataFrame:
    """The nearest point of a storm track of at least ``least_kn`` in a season."""
    strong = points.where((F.col("wind_kn") >= least_kn) & (F.col("ts") >= since) & (F.col("ts") <= until))
    return nearest(sites, strong, radius_km, site, point)


def normalised_difference(a: str, b: str) -> Callable[[], Column]:
    return lambda: F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b))


ndvi = normalised_difference("B8", "B4")
ndbi = normalised_difference("B11", "B8")


def clear_pixels(pixels: DataFrame, qa: str = "QA60") -> DataFrame:
    """Pixels whose cloud and cirrus bits (10 and 11) are unset."""
    return pixels.where(F.col(qa).bitwiseAND(F.lit((1 << 10) | (1 << 11))) == 0)


def zonal_mean(pixels: DataFrame, index: Callable[[], Column], key: str = "site_id", date: str = "date", scenes: Column | None = None) -> DataFrame:
    """Mean index of the clear pixels of each site and date; ``scenes`` filters region, dates or cloud share first."""
    used = clear_pixels(pixels if scenes is None else pixels.where(scenes))
    return used.groupBy(key, date).agg(F.avg(index()).alias("value"), F.count(index()).alias("n"))


def land_surface_celsius(raw: Column) -> Column:
    return raw * 0.02 - 273.15


def terrain_summary(pixels: DataFrame, key: str = "site_id") -> DataFrame:
    parts = [f(c).alias(f"{c}_{n}") for c in ("elev", "slope") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    return pixels.groupBy(key).agg(*parts)


def area_by_year(polygons: DataFrame, key: str = "site_id", area_m2: str = "area_m2") -> DataFrame:
    return polygons.groupBy(key, "year").agg((F.sum(area_m2) / 10_000).alias("area_ha"))


def mean_slope(grid: DataFrame, spacing_m: float, key: str = "site_id") -> DataFrame:
    """Mean slope in degrees of a grid of elevations (i, j, elev): central differences, one-sided at the edges."""

    def gradient(along: str, across: str) -> Column:
        over = Window.partitionBy(key, across).orderBy(along)
        before, after = F.lag("elev").over(over), F.lead("elev").over(over)
        inner = (after - before) / (2 * spacing_m)
        return F.coalesce(inner, (after - F.col("elev")) / spacing_m, (F.col("elev") - before) / spacing_m)

    steep = grid.select(key, F.degrees(F.atan(F.hypot(gradient("i", "j"), gradient("j", "i")))).alias("slope"))
    return steep.groupBy(key).agg(F.avg("slope").alias("mean_slope"))


def least_cloudy(images: DataFrame, targets: DataFrame, days: int = 45, key: str = "site_id", date: str = "date") -> DataFrame:
    """For each target (key, at, and optionally floor): the image of least cloud within ``days``, then the nearest in time."""
    wanted = targets.select(key, "at", *(["floor"] if "floor" in targets.columns else []))
    wanted = wanted.withColumn(date, F.explode(F.sequence(F.date_sub("at", days), F.date_add("at", days))))
    if "floor" in targets.columns:
        wanted = wanted.where(F.col("floor").isNull() | (F.col(date) >= F.col("floor")))
    joined = wanted.join(images, [key, date])
    best = F.min(F.struct("cloud_pct", F.abs(F.datediff(date, "at")).alias("away"), F.col(date).alias("date"))).alias("x")
    return joined.groupBy(key, "at").agg(best).select(key, "at", "x.date", "x.cloud_pct")
