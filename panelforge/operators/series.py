"""Features of panels: series of dated values for each key.

Keys and column names are parameters. All trailing features of a key come from windows over the same
partitioning and order, so Spark shuffles and sorts a panel once for all of them. ``in_blocks`` cuts a key's days into
blocks with overlapping edges, so the windows of one long key run in as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelforge.functions import scalars
from panelforge.operators.quantiles import quantiles


def fill_days(panel: DataFrame, key: str = "site_id", date: str = "date") -> DataFrame:
    """One row for each key and day between its first and last; new rows are null in all other columns."""
    days = panel.groupBy(key).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    days = days.select(key, F.explode(F.sequence("__a", "__b")).alias(date))
    return days.join(panel, [key, date], "left")


def by_date(key: str = "site_id", date: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(date)


#: Days of a block. A row is copied into a neighbouring block if it lies within that block's windows.
BLOCK_DAYS = 1024


def in_blocks(panel: DataFrame, make: Callable[[WindowSpec], dict[str, Column]], back: int = 0, ahead: int = 0, key: str = "site_id", date: str = "date", days: int = BLOCK_DAYS) -> DataFrame:
    """``panel`` with the columns that ``make`` builds over a window of the key by day, no task holding a whole key.

    The windows may look at most ``back`` days back and ``ahead`` days ahead. Rows go to partitions of (key, block of
    ``days`` days), those near a border to the next block as well; the windows run within blocks and the copies are
    dropped. ``rowsBetween`` frames and lags need one row a day (``fill_days``); the window is ordered by a day number,
    so ``rangeBetween`` frames count days and may meet gaps. A row without a date is a block of its own.
    """
    if back > days or ahead > days:
        raise ValueError(f"windows of {max(back, ahead)} days don't fit blocks of {days}")
    day = F.unix_date(F.col(date).cast("date"))
    block, at = F.floor(day / days), F.pmod(day, F.lit(days))
    here = F.struct(block.alias("block"), F.lit(True).alias("own"))
    edges = F.array(
        here,
        F.when(at >= days - back, F.struct((block + 1).alias("block"), F.lit(False).alias("own"))),
        F.when(at < ahead, F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
    )
    placed = panel.select("*", day.alias("__day"), F.explode(F.array_compact(edges)).alias("__in"))
    placed = placed.select(*(F.col(f"`{c}`") for c in panel.columns), "__day", F.col("__in.block").alias("__block"), F.col("__in.own").alias("__own"))
    columns = make(Window.partitionBy(key, "__block").orderBy("__day"))
    return placed.withColumns(columns).where("__own").drop("__day", "__block", "__own")


def rolling_sum(x: Column, days: int, over: WindowSpec, least: int | None = None) -> Column:
    """Sum of the last ``days`` rows, null unless ``least`` (all by default) are present."""
    frame = over.rowsBetween(1 - days, 0)
    return F.when(F.count(x).over(frame) >= (days if least is None else least), F.sum(x).over(frame))


def rolling_mean(x: Column, days: int, over: WindowSpec, least: int | None = None) -> Column:
    frame = over.rowsBetween(1 - days, 0)
    return F.when(F.count(x).over(frame) >= (days if least is None else least), F.avg(x).over(frame))


def wet_days(x: Column, days: int, over: WindowSpec, amount: float = 1.0) -> Column:
    """Rows above ``amount`` among the last ``days``; a missing value is dry, missing rows make it null."""
    frame = over.rowsBetween(1 - days, 0)
    wet = F.sum(F.when(x > amount, 1).otherwise(0)).over(frame)
    return F.when(F.count(F.lit(1)).over(frame) == days, wet)


def change(x: Column, days: int, over: WindowSpec) -> Column:
    return x - F.lag(x, days).over(over)


def antecedent_sum(x: Column, days: int, over: WindowSpec) -> Column:
    """Sum over the last ``days`` calendar days, of whatever days there are; ``over`` is ordered by a day number."""
    return F.sum(x).over(over.rangeBetween(1 - days, 0))


def antecedent_sums(panel: DataFrame, x: str = "rain", days: Sequence[int] = (10, 20), key: str = "site_id", date: str = "date", block_days: int = BLOCK_DAYS) -> DataFrame:
    """``panel`` with ``{x}_{n}d`` for each n of ``days``."""
    return in_blocks(panel, lambda over: {f"{x}_{n}d": antecedent_sum(F.col(x), n, over) for n in days}, max(days), 0, key, date, block_days)


def rolling_sums(panel: DataFrame, x: str = "rain", days: Sequence[int] = (3, 7, 14, 30), least: int | None = None, key: str = "site_id", date: str = "date", block_days: int = BLOCK_DAYS) -> DataFrame:
    """A gap-free ``panel`` with ``{x}_{n}d`` for each n of ``days``."""
    return in_blocks(panel, lambda over: {f"{x}_{n}d": rolling_sum(F.col(x), n, over, least) for n in days}, max(days), 0, key, date, block_days)


def same_day_climatology(x: Column, key: str = "site_id", date: str = "date") -> Column:
    """Mean on this day of the year in earlier years."""
    over = Window.partitionBy(key, F.dayofyear(date)).orderBy(date)
    return F.avg(x).over(over.rowsBetween(Window.unboundedPreceding, -1))


def any_ahead(flag: Column, days: int, over: WindowSpec, complete: bool = True) -> Column:
    """1 if any of the next ``days`` rows is flagged; ``complete`` demands that all of them are known."""
    ahead = [F.lead(flag, i).over(over) for i in range(1, days + 1)]
    found = ahead[0] if days == 1 else F.greatest(*ahead)
    if not complete:
        return found
    known = ahead[0].isNotNull()
    for x in ahead[1:]:
        known = known & x.isNotNull()
    return F.when(known, found)


def weather_features(panel: DataFrame, key: str = "site_id", date: str = "date", block_days: int = BLOCK_DAYS) -> DataFrame:
    """The trailing features of a gap-free daily panel with rain, t2m, rh2m, ps, ws2m and dew point (t2mdew)."""
    rain, ps = F.col("rain"), F.col("ps")
    sine, cosine = scalars.season(F.col(date))

    def trailing(over: WindowSpec) -> dict[str, Column]:
        return {f"__rain_{d}d": rolling_sum(rain, d, over) for d in (3, 7, 14, 30)} | {
            "__wet": wet_days(rain, 7, over),
            "__ps30": rolling_mean(ps, 30, over, 20),
            "__ps1": change(ps, 1, over),
            "__ps3": change(ps, 3, over),
            "__rh3": change(F.col("rh2m"), 3, over),
        }

    found = in_blocks(panel, trailing, 30, 0, key, date, block_days)
    return found.select(
        key,
        date,
        rain.alias("rain_1d"),
        *(F.col(f"__rain_{d}d").alias(f"rain_{d}d") for d in (3, 7, 14, 30)),
        F.col("__wet").alias("wet_days_7d"),
        scalars.rain_acceleration(F.col("__rain_3d"), F.col("__rain_7d")).alias("rain_accel"),
        "t2m",
        "rh2m",
        "ws2m",
        (F.col("t2m") - F.col("t2mdew")).alias("dew_spread"),
        ps.alias("ps_kpa"),
        (ps - F.col("__ps30")).alias("ps_anom"),
        F.col("__ps1").alias("ps_chg_1d"),
        F.col("__ps3").alias("ps_chg_3d"),
        F.col("__rh3").alias("rh_chg_3d"),
        sine.alias("doy_sin"),
        cosine.alias("doy_cos"),
    )


def extreme_threshold(panel: DataFrame, until: Column, x: str = "rain", q: float = 0.99, key: str = "site_id", date: str = "date") -> DataFrame:
    """Exact quantile of each key's values on dates up to ``until``."""
    early = panel.where(F.col(date) <= until).select(key, x)
    found = quantiles(early, x, [q], [key]).select(key, F.col("q")[0].alias("threshold"))
    # A key without early values has no threshold.
    return panel.select(key).distinct().join(found, key, "left")


def extreme_flags(panel: DataFrame, thresholds: DataFrame, x: str = "rain", key: str = "site_id", null_as_zero: bool = False) -> DataFrame:
    """``extreme``: 1 at or above the key's threshold; a missing value stays null or counts as 0."""
    amount = F.coalesce(F.col(x), F.lit(0.0)) if null_as_zero else F.col(x)
    return panel.join(thresholds, key).withColumn("extreme", (amount >= F.col("threshold")).cast("int"))


def horizon_labels(flagged: DataFrame, horizons: Sequence[int] = (1, 2, 3), key: str = "site_id", date: str = "date", complete: bool = True, block_days: int = BLOCK_DAYS) -> DataFrame:
    """y_24h, y_48h ...: an extreme day within the next 1, 2 ... days of a gap-free panel."""
    labels = lambda over: {f"y_{24 * h}h": any_ahead(F.col("extreme"), h, over, complete) for h in horizons}
    return in_blocks(flagged, labels, 0, max(horizons), key, date, block_days)


def linear_trend(rows: DataFrame, value: str, key: str = "site_id", date: str = "date") -> DataFrame:
    """Least-squares line of each key's values on days since its first: slope a year, intercept, n."""
    used = rows.where(F.col(value).isNotNull() & F.col(date).isNotNull())
    day = F.unix_date(F.col(date).cast("date"))
    found = used.select(key, day.cast("double").alias("__t"), F.col(value).alias("__v")).groupBy(key).agg(
        F.regr_slope("__v", "__t").alias("__b"), F.regr_intercept("__v", "__t").alias("__a"), F.min("__t").alias("__first"), F.count(F.lit(1)).alias("n")
    )
    return found.select(key, (F.col("__b") * 365.25).alias("slope_per_year"), (F.col("__a") + F.col("__b") * F.col("__first")).alias("intercept"), "n")


def series_summary(rows: DataFrame, value: str, key: str = "site_id", date: str = "date", baseline: int = 10) -> DataFrame:
    """First and last date, extremes, count, and the mean of the first ``baseline`` observations."""
    used = rows.where(F.col(value).isNotNull()).select(key, date, value)
    whole = used.groupBy(key).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))
    # Each task hands on its own first rows of a key only.
    earliest = used.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(date, value))).where(F.col("__rn") <= baseline)
    return whole.join(earliest.groupBy(key).agg(F.avg(value).alias("baseline")), key)


def anomaly_percent(
    panel: DataFrame, anchors: DataFrame, x: str = "rain", recent_days: int = 90, years: int = 5, closed: bool = True, key: str = "site_id", date: str = "date"
) -> DataFrame:
    """Recent mean against the mean of the ``years`` before the key's ``anchor``, in percent.

    ``closed``: the recent window takes in the day exactly ``recent_days`` before the anchor. Null with under
    365 baseline days, no recent day or a baseline of zero.
    """
    ago = F.datediff(F.col("anchor"), F.col(date))
    joined = panel.join(anchors, key).where((F.col(date) <= F.col("anchor")) & (F.col(date) >= F.add_months("anchor", -12 * years)))
    recent = F.when(ago <= recent_days if closed else ago < recent_days, F.col(x))
    means = joined.groupBy(key).agg(F.avg(recent).alias("recent"), F.avg(x).alias("usual"), F.count(x).alias("days"))
    percent = F.when(F.col("days") >= 365, F.try_divide(F.col("recent") - F.col("usual"), F.col("usual")) * 100)
    return means.select(key, percent.alias("anomaly_pct"), "days")


def project_trend(trends: DataFrame, horizons: Sequence[int] = (0, 5, 10, 20, 30), key: str = "site_id") -> DataFrame:
    """The line carried on from ``last_date`` for so many years, and frozen at its last value."""
    years = F.explode(F.array(*map(F.lit, horizons))).alias("years")
    last = F.datediff("last_date", "first_date")
    at = trends.select("*", years).withColumn("__t", last + F.col("years") * 365.25)
    return at.select(
        key,
        "years",
        F.date_add("last_date", F.round(F.col("years") * 365.25).cast("int")).alias("date"),
        scalars.trend_value(F.col("slope_per_year"), F.col("intercept"), F.col("__t")).alias("continued"),
        scalars.trend_value(F.col("slope_per_year"), F.col("intercept"), last).alias("frozen"),
    )


def holdout_rows(rows: DataFrame, last: int = 60, key: str = "site_id", date: str = "date") -> DataFrame:
    """``fit``: whether a row is older than the last ``last`` of its key, whose dates differ."""
    newest = Window.partitionBy(key).orderBy(F.col(date).desc())
    held = rows.select(key, date).withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= last)
    since = held.groupBy(key).agg(F.min(date).alias("__since"))
    return rows.join(since, key).withColumn("fit", F.col(date) < F.col("__since")).drop("__since")


def as_of(rows: DataFrame, end: Column, n: int, key: str = "site_id", date: str = "date") -> DataFrame:
    """The last ``n`` rows of each key up to ``end``."""
    newest = Window.partitionBy(key).orderBy(F.col(date).desc())
    return rows.where(F.col(date) <= end).withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= n).drop("__rn")


def month_totals(panel: DataFrame, x: str = "rain", key: str = "site_id", date: str = "date") -> DataFrame:
    return panel.groupBy(key, F.trunc(date, "month").alias("month")).agg(F.sum(x).alias("total"))


def with_month_total(observations: DataFrame, panel: DataFrame, events: DataFrame, x: str = "rain", key: str = "site_id", date: str = "date") -> DataFrame:
    """Irregular observations with their calendar month's total and whether an event fell on the day."""
    totals = month_totals(panel, x, key, date)
    marked = events.select(key, date).distinct().withColumn("event_marker", F.lit(1))
    joined = observations.withColumn("month", F.trunc(date, "month")).join(totals, [key, "month"], "left")
    return joined.drop("month").join(marked, [key, date], "left").fillna(0, ["event_marker"])


def antecedent_at(points: DataFrame, panel: DataFrame, days: int, x: str = "rain", key: str = "site_id", date: str = "date") -> DataFrame:
    """Sum of the ``days`` days up to each point's date; null where no day is known.

    A point meets its days by equality, being exploded to the dates it looks back on.
    """
    wanted = points.select(key, F.col(date).alias("__at")).distinct()
    wanted = wanted.withColumn(date, F.explode(F.sequence(F.date_sub("__at", days - 1), F.col("__at"))))
    sums = wanted.join(panel.select(key, date, x), [key, date]).groupBy(key, "__at").agg(F.sum(x).alias("total"), F.count(x).alias("days"))
    return points.join(sums.withColumnRenamed("__at", date), [key, date], "left")
