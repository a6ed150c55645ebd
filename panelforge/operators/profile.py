"""Profiles of any table: column roles, targets, exclusions and leakage, each in one or few aggregate passes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import scalars
from panelforge.operators import metrics

# Names that suggest a target column, and those that do so most.
TARGET_NAMES = r"fail|target|label|class|outcome|default|churn|fraud|disease|diagnos|survived|^y$|result|status|is_|has_"
BEST_TARGET_NAMES = r"fail|target|label"
MAX_CATEGORIES = 20


#: Deviation of a distinct-count sketch, and from how many of them on an estimate leaves no doubt.
SKETCH, SURE = 0.02, 5


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """One row for each column: rows, missing, distinct, share of numbers and dates, integers, least, most, example, kind.

    With ``exact`` false, distinct values are sketched in one pass that copies no row, and counted only for the columns
    whose role hangs on the number: few values, or about as many as rows. The roles are the same; ``unique`` of the other
    columns is an estimate.
    """
    names = list(columns or df.columns)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    dated = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        x = F.col(f"`{name}`")
        plain = isinstance(df.schema[name].dataType, (T.IntegralType, T.DoubleType))  # no need to go by the text
        text = F.trim(x.cast("string"))
        present = x.isNotNull() if plain else x.isNotNull() & (text != "")
        number = x.cast("double") if plain else text.try_cast("double")
        day = F.lit(False) if plain else F.lit(True) if name in dated else F.try_to_timestamp(text).isNotNull() & ~number.isNotNull()
        aggregates += [
            F.count_if(~F.coalesce(present, F.lit(False))).alias(f"missing_{i}"),
            (F.count_distinct(F.when(present, x)) if exact else F.approx_count_distinct(F.when(present, x if plain else x.cast("string")), SKETCH)).alias(f"unique_{i}"),
            F.count_if(present & number.isNotNull()).alias(f"numbers_{i}"),
            F.count_if(present & (number == F.floor(number))).alias(f"integers_{i}"),
            F.count_if(present & day).alias(f"dates_{i}"),
            F.min(number).alias(f"least_{i}"),
            F.max(number).alias(f"most_{i}"),
            F.min(F.when(present, scalars.example_text(x))).alias(f"example_{i}"),
        ]
    fields = ("missing", "unique", "numbers", "integers", "dates", "least", "most", "example")
    one = df.agg(*aggregates)
    if not exact:
        one = _with_exact_counts(df, one, names)
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(n in numeric).alias("numeric"), *(F.col(f"{f}_{i}").alias(f) for f in fields)) for i, n in enumerate(names))))
    return one.select("rows", rows.alias("c")).select("rows", "c.*").withColumn("kind", _kind())


def _with_exact_counts(df: DataFrame, one: DataFrame, names: Sequence[str]) -> DataFrame:
    """The one row of a profile, with distinct values counted where the sketch leaves a role open."""
    row = one.first()
    near = []
    for i, name in enumerate(names):
        present, seen = row["rows"] - row[f"missing_{i}"], row[f"unique_{i}"]
        if seen <= 2 * MAX_CATEGORIES or seen >= present * (1 - SURE * SKETCH):
            near.append((i, name))
    found = df.sparkSession.createDataFrame([row], one.schema)
    if not near:
        return found
    there = lambda x: F.when(x.isNotNull() & (F.trim(x.cast("string")) != ""), x)
    counts = df.agg(*(F.count_distinct(there(F.col(f"`{name}`"))).alias(f"unique_{i}") for i, name in near)).first()
    return found.withColumns({f"unique_{i}": F.lit(counts[f"unique_{i}"]).cast("long") for i, _ in near})


def _kind() -> Column:
    """The role of a column from its profile.

    Rows have no order here, so a counter is told by its values: distinct integers without a gap.
    """
    present = F.col("rows") - F.col("missing")
    all_numbers = F.col("numbers") == present
    counter = all_numbers & (F.col("integers") == present) & (F.col("unique") == present) & (F.col("most") - F.col("least") + 1 == present)
    return (
        F.when(F.col("unique") <= 1, "constant")
        .when(~F.col("numeric") & (F.col("dates") >= present * 0.9), "datetime")
        .when((counter | (~all_numbers & (F.col("unique") == present))) & (present > MAX_CATEGORIES), "id")
        .when(F.col("unique") == 2, "binary")
        .when(all_numbers, "numeric")
        .otherwise("categorical")
    )


def suggest_target(profiled: DataFrame, order: Sequence[str]) -> DataFrame:
    """The column to predict, of those that are binary, categorical or numeric.

    One with a target's name (binary before others, then the best names, then the first in ``order``), else the
    last binary one, else the last.
    """
    used = profiled.where(F.col("kind").isin("binary", "categorical", "numeric"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("name"))
    named, best, binary = F.lower("name").rlike(TARGET_NAMES), F.lower("name").rlike(BEST_TARGET_NAMES), F.col("kind") == "binary"
    rank = F.struct(named.alias("named"), binary.alias("binary"), (named & best).alias("best"), F.when(named, -place).otherwise(place).alias("place"))
    return used.agg(F.max_by("name", rank).alias("target"))


def flag_leakage(df: DataFrame, target: str, flags: Sequence[str], least_rows: int = 5, share: float = 0.95) -> DataFrame:
    """Binary columns that, when on, nearly always come with the target (``implies``); ``leaks`` adds their siblings.

    Siblings are flags in short upper-case names, where two flags or more imply the target and all of these have such names.
    """
    on = lambda c: F.col(c) == 1
    one = df.agg(*(F.struct(F.count_if(on(c)).alias("n"), F.avg(F.when(on(c), F.col(target))).alias("share")).alias(c) for c in flags))
    each = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`.n").alias("n"), F.col(f"`{c}`.share").alias("share")) for c in flags))).alias("x")).select("x.*")
    each = each.withColumn("implies", (F.col("n") >= least_rows) & (F.col("share") >= share))
    short = (F.length("name") <= 6) & (F.upper("name") == F.col("name")) & F.col("name").rlike("[A-Z]")
    total = each.agg((F.count_if("implies") >= 2).alias("__several"), F.count_if(F.col("implies") & ~short).alias("__long"))
    siblings = short & F.col("__several") & (F.col("__long") == 0)
    return each.crossJoin(F.broadcast(total)).withColumn("leaks", F.coalesce("implies", F.lit(False)) | siblings).drop("__several", "__long")


def exclusions(df: DataFrame, target: str, user: Sequence[str] = (), least_auc: float = 0.98, leakage: bool = True, profiled: DataFrame | None = None) -> DataFrame:
    """Columns not to learn from, with the reason: by user, id, constant, over 60 % missing, leakage (of a target of 0 and 1)."""
    profiled = (profile(df) if profiled is None else profiled).where(F.col("name") != target)
    kinds = {r["name"]: r for r in profiled.collect()}  # one row a column
    numeric = [n for n, r in kinds.items() if r.kind == "numeric" and r.numeric]
    binary = [n for n, r in kinds.items() if r.kind == "binary" and r.numeric]
    leaks = set()
    if numeric and leakage:
        leaks |= {r.column for r in metrics.single_column_auc(df, numeric, target).where(F.col("auc") >= least_auc).collect()}
    if binary and leakage:
        leaks |= {r["name"] for r in flag_leakage(df, target, binary).where("leaks").collect()}
    reason = (
        F.when(F.col("name").isin(*user) if user else F.lit(False), "excluded by user")
        .when(F.col("kind") == "id", "id")
        .when(F.col("kind") == "constant", "constant")
        .when(F.col("missing") > F.col("rows") * 0.6, "over 60 % missing")
        .when(F.col("name").isin(*leaks) if leaks else F.lit(False), "leakage")
    )
    return profiled.select("name", reason.alias("reason")).where("reason is not null")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def task_of(df: DataFrame, target: str) -> DataFrame:
    """binary, multiclass or regression, and the positive class of a binary one (1 or true, else the last)."""
    x = F.col(target)
    number = x.cast("string").try_cast("double")
    found = df.where(x.isNotNull()).agg(
        F.count_distinct(x).alias("classes"),
        F.count_if(number.isNull()).alias("words"),
        F.count_if(number != F.floor(number)).alias("fractions"),
        F.max(F.when(F.lower(x.cast("string")).isin("1", "1.0", "true"), x.cast("string"))).alias("one"),
        F.max(x.cast("string")).alias("last"),
    )
    few = (F.col("classes") <= MAX_CATEGORIES) & ((F.col("words") > 0) | (F.col("fractions") == 0))
    task = F.when(F.col("classes") == 2, "binary").when(few | (F.col("words") > 0), "multiclass").otherwise("regression")
    return found.select("classes", task.alias("task"), F.when(F.col("classes") == 2, F.coalesce("one", "last")).alias("positive"))


def _melted(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, name, value) of each number."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def typical_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Median, mean and deviation of numbers, the mode of categories (ties: the least), one row for each column."""
    long = _melted(df, numeric)
    medians = metrics.quantiles(long, "value", [0.5], ["name"]).select("name", F.col("q")[0].cast("string").alias("typical"))
    found = long.groupBy("name").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation")).join(medians, "name", "left")
    found = found.select("name", "typical", "mean", "deviation")
    if categorical:
        pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in categorical))
        counts = df.select(F.explode(pairs).alias("x")).select("x.*").where("value is not null").groupBy("name", "value").count()
        modes = counts.groupBy("name").agg(F.min(F.struct(-F.col("count"), F.col("value").alias("value"))).alias("m")).select("name", F.col("m.value").alias("typical"))
        none = F.lit(None).cast("double")
        found = found.unionByName(modes.select("name", "typical", none.alias("mean"), none.alias("deviation")))
    return found


def five_numbers(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    names = ("least", "q1", "median", "q3", "most")
    found = metrics.quantiles(_melted(df, columns, keys), "value", [0.0, 0.25, 0.5, 0.75, 1.0], [*keys, "name"])
    return found.select(*keys, "name", *(F.col("q")[i].alias(n) for i, n in enumerate(names)))


def ranges(df: DataFrame, columns: Sequence[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Quantile pairs of each column: name, low, high."""
    found = metrics.quantiles(_melted(df, columns), "value", [low, high], ["name"])
    return found.select("name", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def unfamiliar(df: DataFrame, known: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``unfamiliar``: the columns of a row outside their known range, as text; null where none is."""
    pivoted = known.groupBy().pivot("name", list(columns)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    outside = [F.when((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high")), F.lit(c)) for c in columns]
    found = df.crossJoin(F.broadcast(pivoted)).withColumn("unfamiliar", F.concat_ws("; ", F.array_compact(F.array(*outside))))
    return found.withColumn("unfamiliar", F.when(F.col("unfamiliar") != "", F.col("unfamiliar"))).select(*df.columns, "unfamiliar")


def shares(df: DataFrame, column: str, y: str | None = None) -> DataFrame:
    """Rows and share of each value, and the mean of ``y`` there."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), *([F.avg(y).alias("rate")] if y else []))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__all")).drop("__all")


def range_report(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows outside the physical range of each column: name, low, high, n."""
    one = df.agg(*(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.lit(float(lo)).alias("low"), F.lit(float(hi)).alias("high"), F.col(c).alias("n")) for c, (lo, hi) in rules.items()))).alias("x")).select("x.*")


def first_impossible(df: DataFrame, rules: dict[str, tuple[float, float]], key: str = "site_id", date: str = "date") -> DataFrame:
    """The earliest value of each key outside its column's range: date, column, value."""
    bad = F.array_compact(F.array(*(F.when((F.col(c) < lo) | (F.col(c) > hi), F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))) for c, (lo, hi) in rules.items())))
    found = df.select(key, date, bad.alias("bad")).where(F.size("bad") > 0)
    return found.groupBy(key).agg(F.min(F.struct(F.col(date).alias("date"), F.col("bad")[0].alias("bad"))).alias("x")).select(key, "x.date", "x.bad.name", "x.bad.value")


def not_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that are neither blank nor numbers: how many in each column, and an example."""
    bad = {c: F.trim(F.col(c).cast("string")) for c in columns}
    bad = {c: F.when((t != "") & t.try_cast("double").isNull(), t) for c, t in bad.items()}
    parts = F.array(*(F.struct(F.lit(c).alias("name"), F.count(x).alias("n"), F.min(x).alias("example")) for c, x in bad.items()))
    return df.agg(parts.alias("x")).select(F.explode("x").alias("x")).select("x.*")


def readable_date(text: Column) -> tuple[Column, Column]:
    """The day that a date or time names, and whether a text that is not blank names none."""
    day = F.to_date(F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))))
    return day, day.isNull() & (F.trim(text) != "")


def gaps(panel: DataFrame, key: str = "site_id", date: str = "date", least: int = 31) -> DataFrame:
    """Whether each key's days are without gaps and enough: n, missing_days, usable."""
    found = panel.groupBy(key).agg(F.count_distinct(date).alias("n"), (F.datediff(F.max(date), F.min(date)) + 1).alias("__span"))
    return found.select(key, "n", (F.col("__span") - F.col("n")).alias("missing_days"), ((F.col("__span") == F.col("n")) & (F.col("n") >= least)).alias("usable"))


def match_columns(names: Sequence[str], rules: dict[str, tuple[set[str], set[str], set[str]]]) -> dict[str, str]:
    """Which column holds which quantity, by the words of its name.

    ``rules``: quantity -> (words of which one must occur, words that must not, preferred words). A name
    scores its preferred words, and two more for being the quantity's own name; ties go to the first.
    """
    found: dict[str, str] = {}
    for quantity, (needed, avoided, preferred) in rules.items():
        best = None
        for name in names:
            words = set(re.findall("[a-z0-9]+", name.lower()))
            if name in found.values() or not words & needed or words & avoided:
                continue
            rank = len(words & preferred) + 2 * (name.lower() == quantity)
            if best is None or rank > best[0]:
                best = (rank, name)
        if best:
            found[quantity] = best[1]
    return found


def match_patterns(names: Sequence[str], patterns: dict[str, str]) -> dict[str, str]:
    """Quantity -> first unused column whose name matches its pattern."""
    found: dict[str, str] = {}
    for quantity, pattern in patterns.items():
        for name in names:
            if name not in found.values() and re.search(pattern, name, re.IGNORECASE):
                found[quantity] = name
                break
    return found


def check_enum(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """The column trimmed and in upper case, and ``valid``."""
    clean = F.upper(F.trim(column))
    return df.withColumn(column, clean).withColumn("valid", F.coalesce(F.col(column).isin(*allowed), F.lit(False)))


def complete_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Of optional features, those without a missing value."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *(F.count(c).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] == row["__n"] and row["__n"]]


def pull_status(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """REAL with all parts, NOT_PULLED with none, else PARTIAL and the missing parts."""
    absent = F.array_compact(F.array(*(F.when(F.col(p).isNull(), F.lit(p)) for p in parts)))
    return df.withColumn(
        "status", F.when(F.size(absent) == 0, "REAL").when(F.size(absent) == len(parts), "NOT_PULLED").otherwise(F.concat(F.lit("PARTIAL: missing "), F.concat_ws(", ", absent)))
    )
