"""Site tables: which rows a claim covers, how incomplete rows are told, and what is served of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a null in any of the columns."""
    return df.dropna(subset=list(columns))


def real_sites(df: DataFrame, status: str = "status", needed: Sequence[str] = ("lat",)) -> DataFrame:
    """Sites whose status begins with REAL and whose needed columns are filled."""
    return complete_rows(df.where(F.col(status).startswith("REAL")), needed)


def scope_state(terrain: Column, status: Column, terrains: Sequence[str]) -> Column:
    """``in`` or ``out`` of the terrains a model was made for; ``pending`` where the site's data are not there yet."""
    real = F.coalesce(status.startswith("REAL"), F.lit(False))
    return F.when(~real, "pending").when(terrain.isin(*terrains), "in").otherwise("out")


def mechanism_scope(df: DataFrame, terrain: str, kinds: Sequence[str], occurred: str = "occurred", kind: str = "kind", terrain_col: str = "terrain") -> DataFrame:
    """Quiet sites of one terrain, and sites of any terrain hit by one of the kinds."""
    return df.where(((F.col(terrain_col) == terrain) & (F.col(occurred) == 0)) | F.col(kind).isin(*kinds))


def dummies(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One 0/1 column for each value but the first; null belongs to none."""
    return df.withColumns({f"{column}_is_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values[1:]})


def with_template(df: DataFrame, template: dict[str, str]) -> DataFrame:
    """Every column of ``template`` (name -> type) in its order; those that ``df`` lacks are null, others go."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in template.items()))


def served(df: DataFrame, keep: Sequence[str], only_if: str, guarded: Sequence[str]) -> DataFrame:
    """The columns that are served; the guarded ones only where ``only_if`` is 1."""
    return df.select(*(F.when(F.col(only_if) == 1, F.col(c)).alias(c) if c in guarded else F.col(c) for c in keep))


def require_known(rows: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """Rows with their site's attributes; a row of an unknown site fails the query when it is read."""
    known = sites.withColumn("__known", F.lit(True))
    joined = rows.join(known, key, "left")
    message = F.concat(F.lit(f"unknown {key}: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    checked = F.when(F.col("__known"), F.col(key)).otherwise(F.raise_error(message).cast(rows.schema[key].dataType))
    return joined.withColumn(key, checked).drop("__known")


def modelled_and_others(modelled: DataFrame, others: DataFrame) -> DataFrame:
    """All sites in one table, with ``has_model``; columns of one side only are null on the other."""
    return modelled.withColumn("has_model", F.lit(True)).unionByName(others.withColumn("has_model", F.lit(False)), allowMissingColumns=True)


def aligned(arrays: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Rows of arrays that belong together by place: ``at`` and one column for each."""
    zipped = F.arrays_zip(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True)))
    return arrays.select(F.posexplode(zipped).alias("at", "x")).select("at", *(F.col(f"x.{n}") for n in names))


def unfamiliar_lately(flagged: DataFrame, last: int = 30, key: str = "site_id", date: str = "date", flag: str = "unfamiliar") -> DataFrame:
    """How many of each key's last days carry ``flag``."""
    newest = Window.partitionBy(key).orderBy(F.col(date).desc())
    recent = flagged.select(key, date, flag).withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= last)
    return recent.groupBy(key).agg(F.count(F.lit(1)).alias("days"), F.count(flag).alias("unfamiliar_days"))


def sort_rows(df: DataFrame, by: str, descending: bool = False, id_col: str = "site_id") -> DataFrame:
    """By a column the user names, words regardless of case, nulls last, ties by id."""
    key = F.lower(by) if dict(df.dtypes)[by] == "string" else F.col(by)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), id_col)


def ranked(df: DataFrame, by: str, id_col: str = "site_id", n: int | None = None) -> DataFrame:
    """The ``n`` rows (all by default) of the largest values, ties by id."""
    ordered = df.orderBy(F.col(by).desc_nulls_last(), id_col)
    return ordered.limit(n) if n else ordered


# Decisions.


def impact(alert: Column, act: Column, fragile: Column, exposed: Column, relative_risk: Column, p: Column, alert_line: Column) -> Column:
    """severe, high, moderate or low. Fragile land and exposure only amplify a trigger of the weather.

    severe: an alert that is worth acting on, with fragile land or exposure; high: an alert, or worth acting on with
    exposure; moderate: worth acting on, or three times the normal risk and half the alert line at least.
    """
    alert, act, fragile, exposed = (F.coalesce(c, F.lit(False)) for c in (alert, act, fragile, exposed))
    return (
        F.when(alert & act & (fragile | exposed), "severe")
        .when(alert | (act & exposed), "high")
        .when(act | ((relative_risk >= 3) & (p >= alert_line / 2)), "moderate")
        .otherwise("low")
    )


def advice(act: Column, alert: Column, relative_risk: Column) -> Column:
    """act now where it pays, prepare where the risk is raised, else monitor."""
    return F.when(act, "act now").when(F.coalesce(alert, F.lit(False)) | (relative_risk >= 3), "prepare").otherwise("monitor")


def expected_loss(p: Column, exposure: Column, value: Column) -> tuple[Column, Column]:
    """Units expected to be disrupted, and the loss expected with them."""
    return exposure * p, value * p


def what_if(rows: DataFrame, scenarios: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row under each scenario: ``scenario`` and, added to the named columns, its amounts (null: nothing)."""
    renamed = scenarios.select("scenario", *(F.col(c).alias(f"__{c}") for c in columns))
    both = rows.crossJoin(F.broadcast(renamed))
    return both.select("scenario", *((F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0.0))).alias(c) if c in columns else F.col(c) for c in rows.columns))


def levers(features: Column, names: Sequence[str], mean: Sequence[float], scale: Sequence[float], coefficients: Sequence[float], intercept: float, controllable: Sequence[str]) -> Column:
    """Of each feature that can be controlled: the points of probability that one standard deviation to the good gains.

    An array of structs (name, gain), largest gain first, ties by name; a gain is never below 0.
    """
    moved = lambda at, step: F.transform(features, lambda x, i: F.when(i == at, x + step).otherwise(x))
    now = scalars.linear_probability(features, mean, scale, coefficients, intercept)
    found = []
    for name in controllable:
        at = list(names).index(name)
        step = -scale[at] if coefficients[at] > 0 else scale[at]
        gain = F.greatest((now - scalars.linear_probability(moved(at, step), mean, scale, coefficients, intercept)) * 100, F.lit(0.0))
        found.append(F.struct((-gain).alias("rank"), F.lit(name).alias("name"), gain.alias("gain")))
    return F.transform(F.array_sort(F.array(*found)), lambda x: F.struct(x["name"], x["gain"]))


def best_lever(ordered: Column, least: float = 0.5) -> Column:
    """The name of the leading lever, null where none gains ``least`` points."""
    return F.when(ordered[0]["gain"] >= least, ordered[0]["name"])
