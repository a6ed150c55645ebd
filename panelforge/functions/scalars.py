"""Column functions: weather, machine, geography, risk and date arithmetic.

Every function takes and returns columns, so it stays inside Spark's generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversions to the units used here (mm, degrees C, %, kPa, m/s), as (scale, offset).
UNITS = {
    ("in", "mm"): (25.4, 0.0),
    ("cm", "mm"): (10.0, 0.0),
    ("degF", "degC"): (5.0 / 9.0, -160.0 / 9.0),
    ("K", "degC"): (1.0, -273.15),
    ("fraction", "%"): (100.0, 0.0),
    ("hPa", "kPa"): (0.1, 0.0),
    ("Pa", "kPa"): (0.001, 0.0),
    ("inHg", "kPa"): (3.38639, 0.0),
    ("km/h", "m/s"): (1.0 / 3.6, 0.0),
    ("mph", "m/s"): (0.44704, 0.0),
    ("kn", "m/s"): (0.514444, 0.0),
    ("kn", "km/h"): (1.852, 0.0),
}
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
EARTH_KM = 6371.0


def missing_to_null(x: Column, sentinel: float = -900.0) -> Column:
    """NaN and sentinel values (at or below ``sentinel``) become null."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (x > sentinel), x)


def half_even(x: Column, digits: int) -> Column:
    """``x`` to so many decimal digits as C's printf prints it: by its exact value, ties to the even digit.

    ``format_string`` alone rounds the shortest decimal that names a double, ties up. The fraction is taken in two
    parts whose products with a power of ten are exact; ``digits`` is 7 at most.
    """
    x = x.cast("double")
    if not digits:
        return F.rint(x)
    scale, part = 10.0**digits, float(2**26)
    whole = F.floor(F.abs(x)).cast("double")
    high = F.floor((F.abs(x) - whole) * part) / part
    low = (F.abs(x) - whole - high) * scale
    k = F.floor(high * scale).cast("double")
    over = (high * scale - k - 0.5) + low
    n = F.when((over > 0) | ((over == 0) & (k % 2 == 1)), k + 1).otherwise(k)
    return F.when(F.abs(x) < 2.0**52, F.signum(x) * (whole + n / scale)).otherwise(x)


def convert(x: Column, unit: str, to: str) -> Column:
    if unit == to:
        return x
    scale, offset = UNITS[unit, to]
    return x * scale + offset


def log_amount(x: Column) -> Column:
    """log(1 + x) of an amount; what is below zero counts as zero."""
    return F.log1p(F.greatest(x, F.lit(0.0)))


def season(date: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of the year."""
    angle = F.dayofyear(date) * (2 * math.pi / 365.25)
    return F.sin(angle), F.cos(angle)


def wind_at_2m(wind_10m: Column) -> Column:
    return wind_10m * (4.87 / math.log(67.8 * 10 - 5.42))


def dew_point(temperature: Column, humidity: Column, a: float = 17.62, b: float = 243.12) -> Column:
    """Magnus formula, humidity in percent of at least 1."""
    gamma = F.log(F.greatest(humidity, F.lit(1.0)) / 100) + temperature * a / (temperature + b)
    return gamma * b / (F.lit(a) - gamma)


def surface_pressure(sea_level: Column, elevation_m: Column) -> Column:
    return sea_level * F.exp(-elevation_m / 8434.0)


def rain_acceleration(rain_3d: Column, rain_7d: Column) -> Column:
    """Rain of three days less three quarters of that of the four days before."""
    return rain_3d - (rain_7d - rain_3d) * 3 / 4


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.exp(-z) + 1)


def logit(p: Column, clip: float = 1e-4) -> Column:
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(p / (F.lit(1.0) - p))


def standardised(features: Column, mean: Sequence[float], scale: Sequence[float]) -> Column:
    """(x - mean) / scale over an array column."""
    centred = F.zip_with(features, F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return F.zip_with(centred, F.array(*map(F.lit, scale)), lambda x, s: x / s)


def contributions(features: Column, mean: Sequence[float], scale: Sequence[float], coefficients: Sequence[float]) -> Column:
    """Coefficient times standardised value, as an array."""
    return F.zip_with(standardised(features, mean, scale), F.array(*map(F.lit, coefficients)), lambda z, c: z * c)


def linear_probability(features: Column, mean: Sequence[float], scale: Sequence[float], coefficients: Sequence[float], intercept: float) -> Column:
    parts = contributions(features, mean, scale, coefficients)
    return sigmoid(F.aggregate(parts, F.lit(float(intercept)), lambda total, x: total + x))


def largest_contributions(names: Sequence[str], parts: Column, n: int = 3) -> Column:
    """The ``n`` largest by absolute value, as structs (name, value); ties by name."""
    pairs = F.zip_with(F.array(*map(F.lit, names)), parts, lambda k, v: F.struct((-F.abs(v)).alias("rank"), k.alias("name"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: F.struct(x["name"], x["value"]))


def positive_factors(names: Sequence[str], parts: Column, n: int = 3) -> Column:
    """Text of the ``n`` largest positive contributions."""
    pairs = F.zip_with(F.array(*map(F.lit, names)), parts, lambda k, v: F.struct((-v).alias("rank"), k.alias("name"), v.alias("value")))
    top = F.slice(F.array_sort(F.filter(pairs, lambda x: x["value"] > 0)), 1, n)
    return F.concat_ws("; ", F.transform(top, lambda x: F.format_string("%s +%.3f", x["name"], x["value"])))


def trend_value(slope_per_year: Column, intercept: Column, days: Column) -> Column:
    """The fitted line at ``days`` after its first observation."""
    return intercept + slope_per_year * days / 365.25


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def vulnerability(ndvi: Column, ndvi_base: Column, ndbi: Column, ndbi_min: Column, ndbi_max: Column) -> Column:
    """Mean of the vegetation lost and the place in the range of built-up land, 0 to 100."""
    lost = clamp01(F.try_divide(ndvi_base - ndvi, ndvi_base))
    built = clamp01(F.try_divide(ndbi - ndbi_min, ndbi_max - ndbi_min))
    return (lost + built) / 2 * 100


def band(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """names[i] below edges[i], the last name from the last edge on; null stays null."""
    out = F.when(x < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:-1], strict=True):
        out = out.when(x < edge, name)
    return out.when(x.isNotNull(), names[-1])


def risk_word(percent: Column) -> Column:
    return band(percent, (40, 60, 80), ("low", "moderate", "high", "very high"))


def vulnerability_word(index: Column) -> Column:
    return band(index, (25, 50, 75), ("low", "moderate", "high", "severe"))


def trend_word(slope: Column, falling: str, rising: str, flat: str | None = None) -> Column:
    out = F.when(slope < 0, falling).when(slope > 0, rising)
    return out.when(slope == 0, flat if flat is not None else rising)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_KM)


def compass(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Eight-point direction from the first place to the second."""
    y = F.sin(F.radians(lon2 - lon1)) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    point = F.pmod(F.floor((F.degrees(F.atan2(y, x)) + 22.5) / 45), F.lit(8)).cast("int")
    return F.element_at(F.array(*map(F.lit, COMPASS)), point + 1)


def storm_grade(wind_kn: Column) -> Column:
    return band(wind_kn, (28, 34, 48, 64, 90, 120), ("D", "DD", "CS", "SCS", "VSCS", "ESCS", "SuCS"))


def threshold_ratio(total: Column, threshold: float, valid: Column | None = None) -> Column:
    """Percent of a threshold, at most 100; null outside the region (``valid``) the threshold was found for."""
    ratio = F.least(F.lit(100.0), total / threshold * 100)
    return ratio if valid is None else F.when(valid, ratio)


def over_threshold(sums: dict[float, Column], valid: Column | None = None) -> Column:
    """Whether any sum reaches its threshold (threshold -> sum); null outside the region or where no sum is known."""
    reached = [s >= t for t, s in sums.items()]
    known = F.greatest(*(r.cast("int") for r in reached)) == 1 if len(reached) > 1 else reached[0]
    return known if valid is None else F.when(valid, known)


def act_rule(p: Column, cost: Column, loss: Column) -> Column:
    """Act when the probability exceeds the cost-loss ratio."""
    return F.coalesce(p > F.try_divide(cost, loss), F.lit(False))


def relative_risk(p: Column, base_rate: Column) -> Column:
    return F.try_divide(p, base_rate)


def date_range(text: Column) -> Column:
    """``YYYY-MM-DD`` or ``YYYY-MM-DD to YYYY-MM-DD`` as a struct of start and end."""
    parts = F.split(F.trim(text), r"\s+to\s+")
    start = F.try_to_date(F.get(parts, F.lit(0)))
    return F.struct(start.alias("start"), F.coalesce(F.try_to_date(F.get(parts, F.lit(1))), start).alias("end"))


def from_day_of_year(year: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day.cast("int") - 1)


def humanised(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def first_part(text: Column) -> Column:
    return F.trim(F.split_part(text, F.lit(","), F.lit(1)))


def example_text(value: Column, length: int = 24) -> Column:
    return F.left(value.cast("string"), F.lit(length))


def name_tokens(name: Column) -> Column:
    """Lower-case words of a name and the pairs of neighbours run together."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def finite(x: Column) -> Column:
    """NaN and infinities as null, for reports."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clock_calendar(date: Column) -> tuple[Column, Column]:
    """Month, and weekday from Monday as 0."""
    return F.month(date), F.weekday(date)
