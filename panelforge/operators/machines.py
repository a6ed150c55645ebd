"""Machines: engineered sensor features, failure-mode rules, run-ahead projections and actions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars

# Strain limits (min Nm) and minutes of wear a run, by type of machine.
STRAIN_LIMIT = {"L": 11_000.0, "M": 12_000.0, "H": 13_000.0}
WEAR_PER_RUN = {"L": 2, "M": 3, "H": 5}
WINDOW_MIN = 200
LAST_WEAR = 260


def _lookup(table: dict[str, float], key: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.col(key))


def strain_limit() -> Column:
    """The limit of a row's type."""
    return _lookup(STRAIN_LIMIT, "type")


def features(df: DataFrame) -> DataFrame:
    """Power (W), temperature difference (K), strain (min Nm), its share of the limit, worn flag, wear per run."""
    power = F.col("torque") * F.col("rpm") * (2 * math.pi / 60)
    strain = F.col("wear") * F.col("torque")
    return df.withColumns(
        {
            "power": power,
            "temp_diff": F.col("process_temp") - F.col("air_temp"),
            "strain": strain,
            "strain_ratio": strain / _lookup(STRAIN_LIMIT, "type"),
            "worn": (F.col("wear") >= WINDOW_MIN).cast("int"),
            "wear_per_run": _lookup(WEAR_PER_RUN, "type"),
        }
    )


def mechanisms(df: DataFrame) -> DataFrame:
    """``modes``: which failure mechanisms a row's sensors meet, in a fixed order."""
    rules = [
        ("HDF", (F.col("temp_diff") < 8.6) & (F.col("rpm") < 1380)),
        ("PWF", (F.col("power") < 3500) | (F.col("power") > 9000)),
        ("OSF", F.col("strain_ratio") >= 0.9),
        ("TWF", F.col("wear") >= WINDOW_MIN),
    ]
    return df.withColumn("modes", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules))))


# What the mechanisms are called, what is said of each, and from which probability on it is named.
MODE_NAMES = {"TWF": "tool wear", "HDF": "heat dissipation", "PWF": "power", "OSF": "overstrain"}
REASONS = {
    "HDF": "heat is not carried off: %.1f K between process and air at %.0f rpm",
    "PWF": "power of %.0f W is outside 3500 to 9000 W",
    "OSF": "strain is %.0f %% of the limit for this type",
    "TWF": "tool wear of %.0f min is in the replacement window",
}
LEAST_MODE_P = 0.05


def likely_mode(probabilities: Column) -> Column:
    """(p, mode) of the largest probability in a map by mode; ties go to the first in the order of ``MODE_NAMES``."""
    pairs = F.array(*(F.struct(F.coalesce(F.try_element_at(probabilities, F.lit(m)), F.lit(0.0)).alias("p"), F.lit(-i).alias("rank"), F.lit(m).alias("mode")) for i, m in enumerate(MODE_NAMES)))
    return F.array_max(pairs)


def _named(mode: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in MODE_NAMES.items() for x in pair)), mode)


def reason(modes: Column, probabilities: Column) -> Column:
    """Text on the met mechanism of the largest probability (a map by mode).

    Where none is met: the mechanism closest by probability, or that all is normal. Numbers are rounded as printf does.
    """
    ranked = F.array_sort(F.transform(modes, lambda m: F.struct((-F.coalesce(F.try_element_at(probabilities, m), F.lit(0.0))).alias("rank"), m.alias("mode"))))
    top = F.get(ranked, F.lit(0))["mode"]
    texts = {
        "HDF": F.format_string(REASONS["HDF"], scalars.half_even(F.col("temp_diff"), 1), scalars.half_even(F.col("rpm"), 0)),
        "PWF": F.format_string(REASONS["PWF"], scalars.half_even(F.col("power"), 0)),
        "OSF": F.format_string(REASONS["OSF"], scalars.half_even(F.col("strain_ratio") * 100, 0)),
        "TWF": F.format_string(REASONS["TWF"], scalars.half_even(F.col("wear"), 0)),
    }
    likely = likely_mode(probabilities)
    closest = F.format_string("closest to %s (%.0f %%)", _named(likely["mode"]), scalars.half_even(likely["p"] * 100, 0))
    out = F.when(likely["p"] >= LEAST_MODE_P, closest).otherwise("all readings are normal")
    for mode, text in texts.items():
        out = F.when(top == mode, text).otherwise(out)
    return out


def runs_to_window(wear: Column, per_run: Column) -> Column:
    return F.greatest(F.ceil((F.lit(WINDOW_MIN) - wear) / per_run), F.lit(0)).cast("int")


def project(df: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, id_col: str = "machine_id") -> DataFrame:
    """Risk of the runs to come: each machine exploded to its runs until the last wear, all scored at once.

    ``score`` adds ``p`` to a table of features. Risk never falls along a projection. Returns id, k,
    wear, p and ``runs_until_alert``, the first run at or above the threshold (null: none).
    """
    last = F.greatest(F.floor((F.lit(LAST_WEAR) - F.col("wear")) / F.col("wear_per_run")), F.lit(0)).cast("int")
    ahead = features(df).withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    ahead = ahead.withColumn("wear", F.col("wear") + F.col("k") * F.col("wear_per_run"))
    scored = score(features(ahead.select(*df.columns, "k")))
    along = Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rising = scored.withColumn("p", F.max("p").over(along))
    crossing = F.min(F.when(F.col("p") >= threshold, F.col("k"))).over(Window.partitionBy(id_col))
    return rising.select(id_col, "k", "wear", "p", crossing.alias("runs_until_alert"))


def project_summary(df: DataFrame, p_at: Callable[[Column], Column], threshold: float) -> DataFrame:
    """``runs``, ``highest`` and ``runs_until_alert`` of each machine, in its own row, for a score that is a column of the wear.

    The same as ``project`` summed up, without a row for each run and without a shuffle.
    """
    last = F.greatest(F.floor((F.lit(LAST_WEAR) - F.col("wear")) / F.col("wear_per_run")), F.lit(0)).cast("int")
    along = F.transform(F.sequence(F.lit(0), last), lambda k: p_at(F.col("wear") + k * F.col("wear_per_run")))
    first = F.array_position(F.transform("__p", lambda p: p >= threshold), F.lit(True))
    return features(df).withColumn("__p", along).select(
        *df.columns, F.size("__p").alias("runs"), F.array_max("__p").alias("highest"), F.when(first > 0, (first - 1).cast("int")).alias("runs_until_alert")
    )


def action(p: Column, threshold: Column, runs: Column, to_window: Column, probabilities: Column | None = None) -> Column:
    """What to do: alert (naming the likely mechanism from ``LEAST_MODE_P`` on), plan within so many runs, change the tool, or look again."""
    alert = F.lit("alert: stop and inspect")
    if probabilities is not None:
        likely = likely_mode(probabilities)
        alert = F.when(likely["p"] >= LEAST_MODE_P, F.concat(F.lit("alert: stop and see to "), _named(likely["mode"]))).otherwise(alert)
    return (
        F.when(p >= threshold, alert)
        .when(runs <= 20, F.format_string("plan: expected to alert in %d runs", runs))
        .when(to_window == 0, "tool: in the replacement window")
        .otherwise(F.format_string("ok: check again in %d runs", F.least(to_window, F.lit(25))))
    )


def modes_missing(df: DataFrame, y: str, flags: list[str]) -> DataFrame:
    """How often each mode is flagged, and failures without any."""
    total = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return df.agg(*(F.sum(f).alias(f) for f in flags), F.count_if((F.col(y) == 1) & (total == 0)).alias("no_mode"))


def nearest_example(df: DataFrame, target: dict[str, float], weights: dict[str, float], id_col: str = "machine_id") -> DataFrame:
    """The row nearest to ``target`` by weighted absolute difference."""
    away = sum((F.abs(F.col(c) - v) * weights.get(c, 1.0) for c, v in target.items()), F.lit(0.0))
    return df.withColumn("distance", away).orderBy("distance", id_col).limit(1)
