"""The registered queries over the driver's tables and their SQL.

Line items stand for a daily panel (a series for each pair of flag and status), orders for irregular
observations, labels with documents for scored rows, parts on line items for machines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.functions import scalars
from panelforge.operators import geo, machines, metrics, models, profile, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TRAIN_END, TEST_START = "1998-12-31", "2000-01-01"

PANEL_SQL = """
panel AS (
  SELECT l_returnflag || l_linestatus AS site_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS rain,
    avg(l_extendedprice) / 1000 AS t2m, avg(l_discount) * 1000 AS rh2m, avg(l_tax) * 1000 AS ps
  FROM lineitem GROUP BY 1, 2
), filled AS (
  SELECT site_id, date, rain, t2m, rh2m, ps
  FROM (SELECT site_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM panel GROUP BY site_id)
  LEFT JOIN panel USING (site_id, date)
)"""
EXTREME_SQL = PANEL_SQL + f""", threshold AS (
  SELECT site_id, quantile_cont(rain, 0.99) FILTER (WHERE date <= DATE '{TRAIN_END}') AS threshold FROM filled GROUP BY site_id
), flagged AS (
  SELECT f.*, threshold, CAST(rain >= threshold AS INTEGER) AS extreme FROM filled f JOIN threshold USING (site_id)
), labelled AS (
  SELECT *, lead(extreme, 1) OVER w AS y1, lead(extreme, 2) OVER w AS y2, lead(extreme, 3) OVER w AS y3
  FROM flagged WINDOW w AS (PARTITION BY site_id ORDER BY date)
)"""
SCORED_SQL = """
scored AS (
  SELECT lang, l.doc_id, quality AS y, toxic, CAST(n_chars AS DOUBLE) AS score, n_chars / 40000.0 AS p
  FROM labels l JOIN documents d USING (doc_id)
)"""
#: Cumulative counts by descending score.
ABOVE_SQL = SCORED_SQL + """, counts AS (
  SELECT lang, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY lang, score
), above AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS all_pos, sum(neg) OVER (PARTITION BY lang) AS all_neg
  FROM counts WINDOW w AS (PARTITION BY lang ORDER BY score DESC)
)"""
MACHINE_SQL = """
machine AS (
  SELECT l_orderkey * 10 + l_linenumber AS machine_id, ['L', 'M', 'H'][CAST(p_size % 3 AS INTEGER) + 1] AS type,
    295 + l_tax * 100 AS air_temp, 303 + l_discount * 100 AS process_temp, 1200 + l_extendedprice / 100 AS rpm,
    20 + l_quantity AS torque, CAST(l_quantity * 5 AS INTEGER) AS wear
  FROM lineitem JOIN part ON l_partkey = p_partkey
), feature AS (
  SELECT *, torque * rpm * (2 * pi() / 60) AS power, process_temp - air_temp AS temp_diff, wear * torque AS strain,
    wear * torque / CASE type WHEN 'L' THEN 11000.0 WHEN 'M' THEN 12000.0 ELSE 13000.0 END AS strain_ratio,
    CASE type WHEN 'L' THEN 2 WHEN 'M' THEN 3 ELSE 5 END AS wear_per_run
  FROM machine
)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that does the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.concat("l_returnflag", "l_linestatus").alias("site_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("rain"),
        (F.avg("l_extendedprice") / 1000).alias("t2m"),
        (F.avg("l_discount") * 1000).alias("rh2m"),
        (F.avg("l_tax") * 1000).alias("ps"),
    )


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.fill_days(panel(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = filled(spark, sf_dir)
    limits = series.extreme_threshold(days, F.lit(TRAIN_END).cast("date"))
    return series.horizon_labels(series.extreme_flags(days, limits))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id")
    return rows.select("lang", "doc_id", F.col("quality").alias("y"), "toxic", F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") / 40000.0).alias("p"))


def machine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("machine_id"),
        F.element_at(F.array(*map(F.lit, "LMH")), F.col("p_size") % 3 + 1).alias("type"),
        (F.col("l_tax") * 100 + 295).alias("air_temp"),
        (F.col("l_discount") * 100 + 303).alias("process_temp"),
        (F.col("l_extendedprice") / 100 + 1200).alias("rpm"),
        (F.col("l_quantity") + 20).alias("torque"),
        (F.col("l_quantity") * 5).cast("int").alias("wear"),
    )


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# Series features.


@query(f"WITH {PANEL_SQL} SELECT site_id, date, rain, round(t2m, 10) AS t2m FROM filled")
def fill_days(spark, sf_dir):
    return rounded(filled(spark, sf_dir).select("site_id", "date", "rain", "t2m"), 10)


_SUMS = ", ".join(
    f"CASE WHEN count(rain) OVER (PARTITION BY site_id ORDER BY date ROWS {d - 1} PRECEDING) = {d} THEN sum(rain) OVER (PARTITION BY site_id ORDER BY date ROWS {d - 1} PRECEDING) END AS rain_{d}d"
    for d in (3, 7, 14, 30)
)


@query(f"WITH {PANEL_SQL} SELECT site_id, date, {_SUMS} FROM filled")
def rolling_sum_min_periods(spark, sf_dir):
    days = series.rolling_sums(filled(spark, sf_dir).select("site_id", "date", "rain"))
    return days.select("site_id", "date", *(f"rain_{d}d" for d in (3, 7, 14, 30)))


@query(
    f"""WITH {PANEL_SQL} SELECT site_id, date,
  CASE WHEN count(*) OVER w7 = 7 THEN CAST(sum(CASE WHEN rain > 60 THEN 1 ELSE 0 END) OVER w7 AS BIGINT) END AS wet_days_7d,
  round(CASE WHEN count(ps) OVER w30 >= 20 THEN ps - avg(ps) OVER w30 END, 4) + 0 AS ps_anom,
  round(ps - lag(ps, 1) OVER w, 4) + 0 AS ps_chg_1d, round(ps - lag(ps, 3) OVER w, 4) + 0 AS ps_chg_3d,
  round(sin(dayofyear(date) * (2 * pi() / 365.25)), 4) AS doy_sin, round(cos(dayofyear(date) * (2 * pi() / 365.25)), 4) AS doy_cos
FROM filled WINDOW w AS (PARTITION BY site_id ORDER BY date), w7 AS (PARTITION BY site_id ORDER BY date ROWS 6 PRECEDING),
  w30 AS (PARTITION BY site_id ORDER BY date ROWS 29 PRECEDING)"""
)
def trailing_features(spark, sf_dir):
    ps = F.col("ps")
    sine, cosine = scalars.season(F.col("date"))

    def trailing(over):
        return {
            "wet_days_7d": series.wet_days(F.col("rain"), 7, over, 60),
            "ps_anom": ps - series.rolling_mean(ps, 30, over, 20),
            "ps_chg_1d": series.change(ps, 1, over),
            "ps_chg_3d": series.change(ps, 3, over),
        }

    days = series.in_blocks(filled(spark, sf_dir).select("site_id", "date", "rain", "ps"), trailing, back=30)
    return rounded(days.select("site_id", "date", "wet_days_7d", "ps_anom", "ps_chg_1d", "ps_chg_3d", sine.alias("doy_sin"), cosine.alias("doy_cos")))


@query(f"WITH {EXTREME_SQL} SELECT site_id, date, extreme, y1 AS y_24h, greatest(y1, y2) + 0 * y1 * y2 AS y_48h, greatest(y1, y2, y3) + 0 * y1 * y2 * y3 AS y_72h FROM labelled")
def horizon_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select("site_id", "date", "extreme", "y_24h", "y_48h", "y_72h")


@query(
    f"""WITH {PANEL_SQL} SELECT site_id, date, round(avg(rain) OVER (PARTITION BY site_id, dayofyear(date) ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS climatology FROM filled"""
)
def same_day_climatology(spark, sf_dir):
    return rounded(filled(spark, sf_dir).select("site_id", "date", series.same_day_climatology(F.col("rain")).alias("climatology")))


@query(
    f"""WITH {PANEL_SQL} SELECT site_id, date, sum(rain) OVER (PARTITION BY site_id ORDER BY date RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW) AS rain_10d,
  sum(rain) OVER (PARTITION BY site_id ORDER BY date RANGE BETWEEN INTERVAL 19 DAYS PRECEDING AND CURRENT ROW) AS rain_20d FROM panel"""
)
def antecedent_sum(spark, sf_dir):
    return series.antecedent_sums(panel(spark, sf_dir).select("site_id", "date", "rain"), "rain", (10, 20)).select("site_id", "date", "rain_10d", "rain_20d")


@query(f"WITH {PANEL_SQL} SELECT site_id, date, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) > 60 AS fit FROM filled")
def trailing_holdout(spark, sf_dir):
    return series.holdout_rows(filled(spark, sf_dir)).select("site_id", "date", "fit")


@query(
    f"""WITH {PANEL_SQL} SELECT site_id, date, rain FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS rn FROM panel WHERE date <= DATE '{TRAIN_END}') WHERE rn <= 31"""
)
def as_of_slice(spark, sf_dir):
    return series.as_of(panel(spark, sf_dir), F.lit(TRAIN_END).cast("date"), 31).select("site_id", "date", "rain")


_ORDERS = "o AS (SELECT o_orderpriority AS site_id, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderkey FROM orders)"


def observations(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site_id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"))


@query(
    f"""WITH {_ORDERS}, t AS (SELECT *, CAST(date_diff('day', min(date) OVER (PARTITION BY site_id), date) AS DOUBLE) AS t FROM o)
SELECT site_id, round(regr_slope(value, t) * 365.25, 3) AS slope_per_year, round(regr_intercept(value, t), 3) AS intercept, count(*) AS n FROM t GROUP BY site_id"""
)
def linear_trend(spark, sf_dir):
    return rounded(series.linear_trend(observations(spark, sf_dir), "value"), 3)


@query(
    f"""WITH {_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date, value) AS rn FROM o)
SELECT site_id, min(date) AS first_date, max(date) AS last_date, min(value) AS least, max(value) AS most, count(*) AS n,
  round(avg(value) FILTER (WHERE rn <= 10), 4) AS baseline FROM r GROUP BY site_id"""
)
def series_summary(spark, sf_dir):
    return rounded(series.series_summary(observations(spark, sf_dir), "value"))


@query(
    f"""WITH {PANEL_SQL}, a AS (SELECT site_id, max(date) AS anchor FROM panel GROUP BY site_id), j AS (
  SELECT site_id, rain, date_diff('day', date, anchor) AS ago FROM panel JOIN a USING (site_id) WHERE date <= anchor AND date >= anchor - INTERVAL 60 MONTH
), m AS (SELECT site_id, avg(rain) FILTER (WHERE ago <= 90) AS recent, avg(rain) AS usual, count(rain) AS days FROM j GROUP BY site_id)
SELECT site_id, round(CASE WHEN days >= 365 THEN (recent - usual) / usual * 100 END, 4) AS anomaly_pct, days FROM m"""
)
def anomaly_percent(spark, sf_dir):
    rows = panel(spark, sf_dir)
    anchors = rows.groupBy("site_id").agg(F.max("date").alias("anchor"))
    return rounded(series.anomaly_percent(rows, anchors))


_VISITS = "visits AS (SELECT DISTINCT ['AF', 'AO', 'NF', 'NO', 'RF', 'RO', 'XX'][CAST(o_custkey % 7 AS INTEGER) + 1] AS site_id, CAST(o_orderdate AS DATE) AS date FROM orders)"


def visits(spark, sf_dir):
    """Orders as irregular visits of the panel's sites (and of one that is not in it)."""
    names = F.array(*map(F.lit, ("AF", "AO", "NF", "NO", "RF", "RO", "XX")))
    return table(spark, sf_dir, "orders").select(F.element_at(names, (F.col("o_custkey") % 7 + 1).cast("int")).alias("site_id"), F.to_date("o_orderdate").alias("date")).distinct()


@query(
    f"""WITH {PANEL_SQL}, {_VISITS}, m AS (SELECT site_id, date_trunc('month', date) AS month, sum(rain) AS total FROM panel GROUP BY 1, 2),
e AS (SELECT DISTINCT site_id, date FROM panel WHERE rain > 200)
SELECT v.site_id, v.date, total, CAST(e.date IS NOT NULL AS INTEGER) AS event_marker FROM visits v
LEFT JOIN m ON m.site_id = v.site_id AND date_trunc('month', v.date) = month LEFT JOIN e ON e.site_id = v.site_id AND e.date = v.date"""
)
def month_total_join(spark, sf_dir):
    rows = panel(spark, sf_dir)
    return series.with_month_total(visits(spark, sf_dir), rows, rows.where("rain > 200")).select("site_id", "date", "total", "event_marker")


@query(
    f"""WITH {PANEL_SQL}, {_VISITS} SELECT v.site_id, v.date, sum(rain) AS total, nullif(count(f.date), 0) AS days FROM visits v LEFT JOIN panel f
ON f.site_id = v.site_id AND f.date > v.date - INTERVAL 10 DAY AND f.date <= v.date GROUP BY v.site_id, v.date"""
)
def antecedent_at_points(spark, sf_dir):
    return series.antecedent_at(visits(spark, sf_dir), panel(spark, sf_dir), 10).select("site_id", "date", "total", "days")


@query(
    f"""WITH {_ORDERS}, t AS (SELECT *, date_diff('day', min(date) OVER (PARTITION BY site_id), date) AS t FROM o), l AS (
  SELECT site_id, regr_slope(value, t) * 365.25 AS slope, regr_intercept(value, t) AS intercept, max(t) AS last, max(date) AS last_date FROM t GROUP BY site_id)
SELECT site_id, years, last_date + CAST(round(years * 365.25) AS INTEGER) AS date, round(intercept + slope * (last + years * 365.25) / 365.25, 3) AS continued, round(intercept + slope * last / 365.25, 3) AS frozen
FROM l, (SELECT unnest([0, 5, 10, 20, 30]) AS years)"""
)
def project_trend(spark, sf_dir):
    rows = observations(spark, sf_dir)
    trends = series.linear_trend(rows, "value").join(series.series_summary(rows, "value").drop("n"), "site_id")
    return rounded(series.project_trend(trends), 3)


# Thresholds, base rates, summaries.


@query(f"WITH {EXTREME_SQL} SELECT site_id, round(threshold, 4) AS threshold FROM threshold")
def extreme_threshold(spark, sf_dir):
    return rounded(series.extreme_threshold(filled(spark, sf_dir), F.lit(TRAIN_END).cast("date")))


@query(
    f"""WITH {EXTREME_SQL} SELECT site_id, month(date) AS month, round(avg(greatest(y1, y2, y3) + 0 * y1 * y2 * y3), 6) AS rate, count(*) AS n
FROM labelled WHERE date <= DATE '{TRAIN_END}' GROUP BY GROUPING SETS ((site_id, month(date)), (month(date)))"""
)
def base_rates(spark, sf_dir):
    rows = labelled(spark, sf_dir).where(F.col("date") <= TRAIN_END).withColumn("month", F.month("date"))
    grouped = rows.groupingSets([["site_id", "month"], ["month"]], "site_id", "month")
    return rounded(grouped.agg(F.avg("y_72h").alias("rate"), F.count(F.lit(1)).alias("n")), 6)


_FORECAST_SQL = f"""WITH {EXTREME_SQL}, l AS (SELECT site_id, date, extreme, greatest(y1, y2, y3) + 0 * y1 * y2 * y3 AS y FROM labelled),
clim AS (SELECT site_id, month(date) AS month, avg(y) AS c FROM l WHERE date <= DATE '{TRAIN_END}' GROUP BY 1, 2),
overall AS (SELECT avg(y) AS g FROM l WHERE date <= DATE '{TRAIN_END}'),
f AS (SELECT site_id, y, coalesce(c, g) AS climatology, CAST(extreme AS DOUBLE) AS persistence
  FROM l LEFT JOIN clim ON l.site_id = clim.site_id AND month(l.date) = clim.month CROSS JOIN overall
  WHERE date >= DATE '{TEST_START}' AND y IS NOT NULL AND extreme IS NOT NULL),"""
_FORECAST_SQL = _FORECAST_SQL.replace("SELECT site_id, y, coalesce", "SELECT l.site_id, y, coalesce")


def forecasts(spark, sf_dir):
    rows = labelled(spark, sf_dir).withColumn("month", F.month("date"))
    sums = rows.where(F.col("date") <= TRAIN_END).groupBy("site_id", "month").agg(F.sum("y_72h").alias("__s"), F.count("y_72h").alias("__n"))
    climatology = sums.select("site_id", "month", F.try_divide("__s", "__n").alias("c"))
    overall = sums.agg((F.sum("__s") / F.sum("__n")).alias("g"))
    test = rows.where((F.col("date") >= TEST_START) & F.col("y_72h").isNotNull() & F.col("extreme").isNotNull())
    joined = test.join(F.broadcast(climatology), ["site_id", "month"], "left").crossJoin(F.broadcast(overall))
    return joined.select("site_id", F.col("y_72h").alias("y"), F.coalesce("c", "g").alias("climatology"), F.col("extreme").cast("double").alias("persistence"))


@query(
    _FORECAST_SQL
    + """ s AS (SELECT 'climatology' AS model, y, climatology AS score FROM f UNION ALL SELECT 'persistence', y, persistence FROM f),
counts AS (SELECT model, score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY 1, 2),
above AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n
  FROM counts WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
ranked AS (SELECT model, sum(pos * (n - fp + neg / 2)) / max(p * n) AS roc_auc, sum(pos * tp / (tp + fp)) / max(p) AS average_precision FROM above GROUP BY model)
SELECT model, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(brier, 6) AS brier
FROM ranked JOIN (SELECT model, avg(pow(score - y, 2)) AS brier FROM s GROUP BY model) USING (model)"""
)
def baseline_forecast_skill(spark, sf_dir):
    """Flagship: do climatology or persistence foresee an extreme day within 72 hours?"""
    found = forecasts(spark, sf_dir)
    both = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in ("climatology", "persistence")))).alias("x")
    long = found.select("y", both).select("y", "x.*")
    return rounded(metrics.binary_scores(long, keys=["model"]), 6)


@query(f"WITH {PANEL_SQL} SELECT site_id, month(date) AS month, round(median(rain), 4) AS rain, round(median(t2m), 4) AS t2m, round(median(ps), 4) AS ps FROM panel GROUP BY 1, 2")
def monthly_medians(spark, sf_dir):
    names = ["rain", "t2m", "ps"]
    days = panel(spark, sf_dir).select("site_id", F.month("date").alias("month"), *(F.col(c).cast("double").alias(c) for c in names))
    found = metrics.quantiles(days.unpivot(["site_id", "month"], names, "name", "value"), "value", [0.5], ["site_id", "month", "name"])
    return rounded(found.groupBy("site_id", "month").pivot("name", names).agg(F.first(F.col("q")[0])))


@query(
    "WITH r AS (SELECT 'rain' AS name, l_quantity AS x FROM lineitem UNION ALL SELECT 'price', l_extendedprice FROM lineitem) SELECT name, round(quantile_cont(x, 0.001), 4) AS low, round(quantile_cont(x, 0.999), 4) AS high FROM r GROUP BY name"
)
def experience_ranges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("rain"), F.col("l_extendedprice").alias("price"))
    return rounded(profile.ranges(rows, ["rain", "price"]))


@query(
    """WITH r AS (SELECT quantile_cont(l_quantity, 0.001) AS ql, quantile_cont(l_quantity, 0.999) AS qh, quantile_cont(l_extendedprice, 0.001) AS pl, quantile_cont(l_extendedprice, 0.999) AS ph FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_quantity < ql OR l_quantity > qh THEN 'l_quantity' END, CASE WHEN l_extendedprice < pl OR l_extendedprice > ph THEN 'l_extendedprice' END) AS unfamiliar
FROM lineitem, r WHERE l_quantity < ql OR l_quantity > qh OR l_extendedprice < pl OR l_extendedprice > ph"""
)
def unfamiliar_rows(spark, sf_dir):
    rows, columns = table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]
    return profile.unfamiliar(rows, profile.ranges(rows, columns), columns).where("unfamiliar is not null").select("l_orderkey", "l_linenumber", "unfamiliar")


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS rate, round(count(*) / (SELECT count(*) FROM part), 6) AS share FROM part GROUP BY p_brand")
def category_shares(spark, sf_dir):
    found = profile.shares(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")
    return found.select("p_brand", "n", F.round("rate", 4).alias("rate"), F.round("share", 6).alias("share"))


_FIVE = ", ".join(f"round(quantile_cont(p_retailprice, {q}), 4) AS {n}" for q, n in ((0, "least"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "most")))


@query(f"SELECT p_brand, {_FIVE} FROM part GROUP BY p_brand")
def five_numbers(spark, sf_dir):
    return rounded(profile.five_numbers(table(spark, sf_dir, "part"), ["p_retailprice"], ["p_brand"]).drop("name"))


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    """``columns``: name -> its kind, as the roles' rules give it for this table at every size."""
    part = """SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique", count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS numbers,
  count(*) FILTER (WHERE TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) = floor(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE))) AS integers, CAST(0 AS BIGINT) AS dates,
  min(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS least, max(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) AS most, '{k}' AS kind FROM {t}"""
    return " UNION ALL ".join(part.format(c=c, k=k, t=table) for c, k in columns.items())


@query(_profile_sql("customer", {"c_custkey": "id", "c_name": "id", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "categorical"}))
def table_profile(spark, sf_dir):
    return profile.profile(table(spark, sf_dir, "customer")).drop("numeric", "example")


@query("SELECT 'p_size' AS name, 1.0::DOUBLE AS low, 40.0::DOUBLE AS high, count(*) FILTER (WHERE p_size < 1 OR p_size > 40) AS n FROM part UNION ALL SELECT 'p_retailprice', 950.0, 1500.0, count(*) FILTER (WHERE p_retailprice < 950 OR p_retailprice > 1500) FROM part")
def range_report(spark, sf_dir):
    return profile.range_report(table(spark, sf_dir, "part"), {"p_size": (1, 40), "p_retailprice": (950, 1500)})


@query(f"WITH {PANEL_SQL} SELECT site_id, count(DISTINCT date) AS n, date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS missing_days, date_diff('day', min(date), max(date)) + 1 = count(DISTINCT date) AND count(DISTINCT date) >= 31 AS usable FROM panel GROUP BY site_id")
def day_gaps(spark, sf_dir):
    return profile.gaps(panel(spark, sf_dir)).select("site_id", "n", F.col("missing_days").cast("long").alias("missing_days"), "usable")


@query("SELECT 'l_quantity' AS name, round(median(l_quantity), 4) AS typical, round(avg(l_quantity), 4) AS mean, round(stddev_samp(l_quantity), 4) AS deviation FROM lineitem UNION ALL SELECT 'l_discount', round(median(l_discount), 4), round(avg(l_discount), 4), round(stddev_samp(l_discount), 4) FROM lineitem")
def typical_values(spark, sf_dir):
    found = profile.typical_values(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return rounded(found.withColumn("typical", F.col("typical").cast("double")))


@query("SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS duplicates")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_rows(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey"))


# Metrics.


@query(f"WITH {ABOVE_SQL} SELECT lang, round(sum(pos * (all_neg - fp + neg / 2)) / nullif(max(all_pos * all_neg), 0), 6) AS roc_auc FROM above GROUP BY lang")
def roc_auc_exact(spark, sf_dir):
    return rounded(metrics.roc_auc(scored(spark, sf_dir), keys=["lang"]), 6)


@query(f"WITH {ABOVE_SQL} SELECT lang, round(sum(pos * tp / (tp + fp)) / nullif(max(all_pos), 0), 6) AS average_precision FROM above GROUP BY lang")
def average_precision_exact(spark, sf_dir):
    return rounded(metrics.average_precision(scored(spark, sf_dir), keys=["lang"]), 6)


@query(f"WITH {SCORED_SQL} SELECT lang, round(avg(pow(least(greatest(p, 0), 1) - y, 2)), 6) AS brier FROM scored GROUP BY lang")
def brier_score(spark, sf_dir):
    return rounded(metrics.brier(scored(spark, sf_dir), score="p", keys=["lang"]), 6)


_RATE = "coalesce({} / nullif({}, 0), 0)"


@query(
    f"""WITH {SCORED_SQL}, c AS (SELECT lang, count(*) FILTER (WHERE y = 1 AND score > 1500) AS tp, count(*) FILTER (WHERE y = 0 AND score > 1500) AS fp,
  count(*) FILTER (WHERE y = 1 AND score <= 1500) AS fn, count(*) FILTER (WHERE y = 0 AND score <= 1500) AS tn FROM scored GROUP BY lang)
SELECT lang, tp, fp, fn, tn, round({_RATE.format("tp", "tp + fp")}, 6) AS precision, round({_RATE.format("tp", "tp + fn")}, 6) AS recall,
  round({_RATE.format("2 * tp", "2 * tp + fp + fn")}, 6) AS f1, round({_RATE.format("tp + tn", "tp + fp + fn + tn").replace("tp + tn /", "(tp + tn) /")}, 6) AS accuracy,
  round((tp + fp) / (tp + fp + fn + tn), 6) AS alert_rate, round({_RATE.format("tn", "tn + fp")}, 6) AS specificity,
  round(greatest(tp + fn, fp + tn) / (tp + fp + fn + tn), 6) AS naive_accuracy FROM c"""
)
def confusion_rates(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("predicted", (F.col("score") > 1500).cast("int"))
    return rounded(metrics.confusion(rows, keys=["lang"]), 6)


@query(
    f"""WITH {SCORED_SQL}, x AS (SELECT lang AS actual, ['de', 'en', 'es', 'fr'][CAST(doc_id % 4 AS INTEGER) + 1] AS predicted FROM scored),
l AS (SELECT actual AS name FROM x UNION SELECT predicted FROM x)
SELECT a.name AS actual, b.name AS predicted, count(x.actual) AS n FROM l a CROSS JOIN l b LEFT JOIN x ON x.actual = a.name AND x.predicted = b.name GROUP BY 1, 2"""
)
def confusion_matrix(spark, sf_dir):
    guess = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return metrics.confusion_matrix(scored(spark, sf_dir).select(F.col("lang").alias("actual"), guess.alias("predicted")))


@query(
    f"""WITH {SCORED_SQL}, x AS (SELECT lang AS actual, ['de', 'en', 'es', 'fr'][CAST(doc_id % 4 AS INTEGER) + 1] AS predicted FROM scored),
l AS (SELECT actual AS name FROM x UNION SELECT predicted FROM x),
c AS (SELECT name, (SELECT count(*) FROM x WHERE actual = name AND predicted = name) AS tp, (SELECT count(*) FROM x WHERE actual = name) AS a, (SELECT count(*) FROM x WHERE predicted = name) AS p FROM l)
SELECT round(avg(2 * tp / (a + p)), 6) AS macro_f1, round(sum(tp) / sum(a), 6) AS accuracy FROM c"""
)
def macro_f1(spark, sf_dir):
    guess = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return rounded(metrics.macro_scores(scored(spark, sf_dir).select(F.col("lang").alias("actual"), guess.alias("predicted"))), 6)


@query(
    """SELECT l_returnflag, round(1 - sum(pow(l_extendedprice - 1500 * l_quantity, 2)) / (sum(l_extendedprice * l_extendedprice) - sum(l_extendedprice) * sum(l_extendedprice) / count(*)), 6) AS r2,
  round(avg(abs(l_extendedprice - 1500 * l_quantity)), 3) AS mae, round(sqrt(avg(pow(l_extendedprice - 1500 * l_quantity, 2))), 3) AS rmse FROM lineitem GROUP BY l_returnflag"""
)
def regression_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("predicted"))
    found = metrics.regression_scores(rows, keys=["l_returnflag"])
    return found.select("l_returnflag", F.round("r2", 6).alias("r2"), F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))


@query(
    f"""WITH {SCORED_SQL}, b AS (SELECT *, CASE WHEN p < 0.02 THEN 0 WHEN p < 0.05 THEN 1 WHEN p < 0.1 THEN 2 WHEN p <= 1 THEN 3 END AS bin FROM scored WHERE p >= 0 AND p <= 1)
SELECT lang, bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS observed FROM b GROUP BY lang, bin"""
)
def reliability_table(spark, sf_dir):
    return rounded(metrics.reliability(scored(spark, sf_dir), (0, 0.02, 0.05, 0.1, 1), score="p", keys=["lang"]), 6)


@query(
    f"""WITH {SCORED_SQL}, e AS (SELECT lang, quantile_cont(score, [1 / 6, 2 / 6, 3 / 6, 4 / 6, 5 / 6]) AS edges FROM scored GROUP BY lang)
SELECT s.lang, CAST(len(list_filter(edges, lambda x: x < score)) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(y), 4) AS observed
FROM scored s JOIN e ON s.lang = e.lang GROUP BY 1, 2"""
)
def quantile_calibration(spark, sf_dir):
    return rounded(metrics.quantile_calibration(scored(spark, sf_dir), keys=["lang"]))


@query(
    """WITH b AS (SELECT CAST(ceil((l_quantity - 1) / 5) AS INTEGER) AS bin, CAST(l_returnflag = 'R' AS INTEGER) AS y FROM lineitem)
SELECT bin, count(*) AS n, round(avg(y), 6) AS rate, 1 + (bin - 0.5::DOUBLE) * 5 AS middle FROM b WHERE bin BETWEEN 1 AND 10 GROUP BY bin HAVING count(*) >= 15"""
)
def rate_curve(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(metrics.rate_curve(rows, "l_quantity", 1.0, 5.0, 10), 6)


@query(f"WITH {SCORED_SQL} SELECT lang, round(quantile_cont(score, 0.9), 4) AS threshold FROM scored GROUP BY lang")
def alert_threshold(spark, sf_dir):
    return rounded(metrics.alert_threshold(scored(spark, sf_dir), 0.1, keys=["lang"]))


@query(
    f"""WITH {SCORED_SQL}, g AS (SELECT lang, unnest(list_distinct(quantile_cont(score, list_transform(range(120), lambda i: i / 119)))) AS threshold FROM scored GROUP BY lang),
f AS (SELECT lang, threshold, 2 * count(*) FILTER (WHERE y = 1 AND score >= threshold) / (count(*) FILTER (WHERE score >= threshold) + count(*) FILTER (WHERE y = 1)) AS f1
  FROM g JOIN scored USING (lang) GROUP BY lang, threshold)
SELECT lang, round(arg_max(threshold, round(f1, 12) * 1000000 - threshold / 1000000), 4) AS threshold, round(max(f1), 4) AS f1 FROM f GROUP BY lang"""
)
def best_f1_threshold(spark, sf_dir):
    return rounded(metrics.best_f1(scored(spark, sf_dir), keys=["lang"]))


@query(
    f"""WITH {SCORED_SQL}, r AS (SELECT 0.005 * pow(160, i / 39) AS ratio FROM (SELECT unnest(range(40)) AS i)),
e AS (SELECT lang, ratio, avg(CASE WHEN p >= ratio THEN ratio ELSE y END) AS expense, avg(y) AS rate FROM scored CROSS JOIN r GROUP BY lang, ratio)
SELECT lang, round(ratio, 6) AS ratio, round(expense, 6) AS expense, round(least(ratio, rate), 6) AS expense_fixed, round(rate * ratio, 6) AS expense_perfect,
  round(CASE WHEN least(ratio, rate) > rate * ratio THEN (least(ratio, rate) - expense) / (least(ratio, rate) - rate * ratio) ELSE 0 END, 4) AS value FROM e"""
)
def value_curve(spark, sf_dir):
    found = metrics.value_curve(scored(spark, sf_dir), score="p", keys=["lang"])
    return rounded(found.withColumn("value", F.round("value", 4)), 6)


@query(
    f"""WITH v AS ({ORACLE_SQL['value_curve']}) SELECT lang, max(value) AS value, arg_max(ratio, value * 1000000 - ratio) AS ratio FROM v GROUP BY lang"""
)
def peak_value(spark, sf_dir):
    return metrics.peak_value(value_curve(spark, sf_dir), keys=["lang"])


@query(
    f"""WITH {SCORED_SQL} SELECT lang, round(count(*) FILTER (WHERE y = 0 AND score > 1500) * 365.25 / nullif(count(*) FILTER (WHERE y = 0), 0), 4) AS false_alerts_per_year FROM scored GROUP BY lang"""
)
def false_alerts_per_year(spark, sf_dir):
    return rounded(metrics.false_alerts_per_year(scored(spark, sf_dir).withColumn("alert", F.col("score") > 1500), keys=["lang"]))


_EVENTS_SQL = f"ev AS (SELECT site_id, max_by(date, rain * 100000 - date_diff('day', DATE '1990-01-01', date)) AS event_date FROM panel WHERE date >= DATE '{TEST_START}' GROUP BY site_id)"


def wettest_days(spark, sf_dir):
    late = panel(spark, sf_dir).where(F.col("date") >= TEST_START)
    return late.groupBy("site_id").agg(F.max_by("date", F.col("rain") * 100000 - F.datediff("date", F.lit("1990-01-01").cast("date"))).alias("event_date"))


@query(
    f"""WITH {PANEL_SQL}, {_EVENTS_SQL}, th AS (SELECT site_id, quantile_cont(ps, 0.75) AS threshold FROM filled GROUP BY site_id),
w AS (SELECT e.site_id, event_date, f.ps, threshold, date_diff('day', f.date, event_date) AS lead FROM ev e JOIN filled f ON f.site_id = e.site_id AND f.date >= event_date - INTERVAL 3 DAY AND f.date < event_date JOIN th ON th.site_id = e.site_id),
pk AS (SELECT site_id, event_date, max(ps) AS peak, coalesce(bool_or(ps >= threshold), false) AS alerted, max(lead) FILTER (WHERE ps >= threshold) AS lead_days FROM w GROUP BY 1, 2)
SELECT pk.site_id, event_date, round(peak, 4) AS peak, alerted, lead_days, round(avg(CAST(f.ps < peak AS INTEGER)) * 100, 4) AS percentile
FROM pk LEFT JOIN filled f USING (site_id) GROUP BY pk.site_id, event_date, peak, alerted, lead_days"""
)
def event_backtest(spark, sf_dir):
    days = filled(spark, sf_dir)
    limits = metrics.quantiles(days, "ps", [0.75], ["site_id"]).select("site_id", F.col("q")[0].alias("threshold"))
    found = metrics.event_backtest(days.join(limits, "site_id"), wettest_days(spark, sf_dir), score="ps")
    return rounded(found.withColumn("lead_days", F.col("lead_days").cast("long")))


@query(
    f"""WITH {PANEL_SQL}, {_EVENTS_SQL} SELECT f.site_id, f.date, CASE WHEN date_diff('day', f.date, event_date) BETWEEN 1 AND 7 THEN date_diff('day', f.date, event_date) END AS days_to_event,
  CAST(date_diff('day', f.date, event_date) BETWEEN 1 AND 7 AS INTEGER) AS y FROM filled f JOIN ev USING (site_id)"""
)
def lead_time_labels(spark, sf_dir):
    found = metrics.lead_labels(filled(spark, sf_dir), wettest_days(spark, sf_dir))
    return found.select("site_id", "date", F.col("days_to_event").cast("long").alias("days_to_event"), "y")


@query(
    """WITH m AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, unnest([{'c': 'l_quantity', 's': l_quantity}, {'c': 'l_extendedprice', 's': l_extendedprice}], recursive := true) FROM lineitem),
n AS (SELECT c, s, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY c, s),
a AS (SELECT *, sum(neg) OVER (PARTITION BY c ORDER BY s) - neg AS below, sum(pos) OVER (PARTITION BY c) AS p, sum(neg) OVER (PARTITION BY c) AS q FROM n),
r AS (SELECT c, sum(pos * (below + neg / 2)) / max(p * q) AS auc FROM a GROUP BY c)
SELECT c AS "column", round(greatest(auc, 1 - auc), 6) AS auc FROM r"""
)
def single_column_auc(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(metrics.single_column_auc(rows, ["l_quantity", "l_extendedprice"]), 6)


@query(
    f"""WITH {MACHINE_SQL}, f AS (SELECT CAST(power > 9000 OR power < 3500 AS INTEGER) AS y, CAST(power > 9000 AS INTEGER) AS high, CAST(torque > 60 AS INTEGER) AS heavy FROM feature)
SELECT *, implies AS leaks FROM (
SELECT 'high' AS name, sum(high) AS n, round(avg(y) FILTER (WHERE high = 1), 6) AS share, sum(high) >= 5 AND avg(y) FILTER (WHERE high = 1) >= 0.95 AS implies FROM f
UNION ALL SELECT 'heavy', sum(heavy), round(avg(y) FILTER (WHERE heavy = 1), 6), sum(heavy) >= 5 AND avg(y) FILTER (WHERE heavy = 1) >= 0.95 FROM f)"""
)
def flag_leakage(spark, sf_dir):
    f = machines.features(machine_rows(spark, sf_dir))
    rows = f.select(((F.col("power") > 9000) | (F.col("power") < 3500)).cast("int").alias("y"), (F.col("power") > 9000).cast("int").alias("high"), (F.col("torque") > 60).cast("int").alias("heavy"))
    return rounded(profile.flag_leakage(rows, "y", ["high", "heavy"]), 6)


# Places.

_PLACE = "CAST(n_nationkey * 7 - 80 AS DOUBLE) AS lat, CAST((n_nationkey * 37) % 360 - 180 AS DOUBLE) AS lon"
_SPOT = "CAST(s_suppkey * 13 % 170 - 85 AS DOUBLE) AS lat, CAST(s_suppkey * 29 % 360 - 180 AS DOUBLE) AS lon"


@query(
    f"""WITH s AS (SELECT n_nationkey AS site_id, {_PLACE} FROM nation), e AS (SELECT s_suppkey AS event_id, {_SPOT} FROM supplier),
d AS (SELECT site_id, event_id, 2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(e.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - s.lon) / 2), 2)))) AS km FROM s CROSS JOIN e),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY km, event_id) AS rn FROM d WHERE km <= 1500)
SELECT r.site_id, r.event_id, round(km, 4) AS distance_km, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][1 + CAST(floor((degrees(atan2(sin(radians(e.lon - s.lon)) * cos(radians(e.lat)),
  cos(radians(s.lat)) * sin(radians(e.lat)) - sin(radians(s.lat)) * cos(radians(e.lat)) * cos(radians(e.lon - s.lon)))) + 22.5 + 360) / 45) AS INTEGER) % 8] AS bearing
FROM r JOIN s ON s.site_id = r.site_id JOIN e ON e.event_id = r.event_id WHERE rn = 1"""
)
def nearest_event(spark, sf_dir):
    sites = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site_id"), (F.col("n_nationkey") * 7 - 80).cast("double").alias("lat"), (F.col("n_nationkey") * 37 % 360 - 180).cast("double").alias("lon"))
    events = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("event_id"), (F.col("s_suppkey") * 13 % 170 - 85).cast("double").alias("lat"), (F.col("s_suppkey") * 29 % 360 - 180).cast("double").alias("lon"))
    return rounded(geo.nearest(sites, events, 1500.0))


@query(
    """WITH px AS (SELECT l_returnflag AS site_id, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS b8, l_quantity * 1000 AS b4, CAST(l_partkey * 1024 % 4096 AS BIGINT) AS qa FROM lineitem)
SELECT site_id, date, round(avg((b8 - b4) / nullif(b8 + b4, 0)), 6) AS value, count(*) AS n FROM px WHERE (qa & 3072) = 0 GROUP BY site_id, date"""
)
def zonal_mean_index(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("site_id"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("B8"), (F.col("l_quantity") * 1000).alias("B4"), (F.col("l_partkey") * 1024 % 4096).alias("QA60")
    )
    return rounded(geo.zonal_mean(rows, geo.ndvi), 6)


# Machines.


@query(f"WITH {MACHINE_SQL} SELECT machine_id, round(power, 4) AS power, round(temp_diff, 4) AS temp_diff, round(strain, 4) AS strain, round(strain_ratio, 6) AS strain_ratio, CAST(greatest(ceil((200 - wear) / wear_per_run), 0) AS INTEGER) AS runs FROM feature")
def machine_features(spark, sf_dir):
    found = machines.features(machine_rows(spark, sf_dir))
    runs = machines.runs_to_window(F.col("wear"), F.col("wear_per_run"))
    return found.select("machine_id", *(F.round(c, 4).alias(c) for c in ("power", "temp_diff", "strain")), F.round("strain_ratio", 6).alias("strain_ratio"), runs.alias("runs"))


@query(
    f"""WITH {MACHINE_SQL} SELECT machine_id, concat_ws(',', CASE WHEN temp_diff < 8.6 AND rpm < 1380 THEN 'HDF' END, CASE WHEN power < 3500 OR power > 9000 THEN 'PWF' END,
  CASE WHEN strain_ratio >= 0.9 THEN 'OSF' END, CASE WHEN wear >= 200 THEN 'TWF' END) AS modes FROM feature"""
)
def failure_mechanisms(spark, sf_dir):
    found = machines.mechanisms(machines.features(machine_rows(spark, sf_dir)))
    return found.select("machine_id", F.concat_ws(",", "modes").alias("modes"))


@query(
    f"""WITH {MACHINE_SQL}, k AS (SELECT machine_id, list_transform(range(CAST(greatest(floor((260 - wear) / wear_per_run), 0) AS INTEGER) + 1),
  lambda k: (wear + k * wear_per_run) * torque / CASE type WHEN 'L' THEN 11000.0 WHEN 'M' THEN 12000.0 ELSE 13000.0 END) AS p FROM feature)
SELECT machine_id, len(p) AS runs, round(list_max(p), 6) AS highest, CAST(nullif(list_position(list_transform(p, lambda x: x >= 0.9), true), 0) - 1 AS INTEGER) AS runs_until_alert FROM k"""
)
def run_ahead_projection(spark, sf_dir):
    limit = machines.strain_limit()
    found = machines.project_summary(machine_rows(spark, sf_dir), lambda wear: wear * F.col("torque") / limit, 0.9)
    return rounded(found.select("machine_id", F.col("runs").cast("long").alias("runs"), "highest", "runs_until_alert"), 6)


# Scalars, nested values, ranking, sets.


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, month(ts) AS month, isodow(ts) - 1 AS weekday FROM events")
def json_and_calendar(spark, sf_dir):
    month, weekday = scalars.clock_calendar(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), month.cast("long").alias("month"), weekday.cast("long").alias("weekday"))


@query(
    """SELECT event_id, round((value - 32) * 5 / 9, 4) AS celsius, round(value * 25.4, 4) AS mm, round(value / 3.6, 4) AS ms, round(ln(1 + greatest(value, 0)), 6) AS log_amount,
  round(1 / (1 + exp(-value / 100)), 6) AS probability, CASE WHEN value < 40 THEN 'low' WHEN value < 60 THEN 'moderate' WHEN value < 80 THEN 'high' WHEN value IS NOT NULL THEN 'very high' END AS word FROM events"""
)
def unit_conversions(spark, sf_dir):
    x = F.col("value")
    return rounded(
        table(spark, sf_dir, "events").select(
            "event_id",
            F.round(scalars.convert(x, "degF", "degC"), 4).alias("celsius"),
            F.round(scalars.convert(x, "in", "mm"), 4).alias("mm"),
            F.round(scalars.convert(x, "km/h", "m/s"), 4).alias("ms"),
            scalars.log_amount(x).alias("log_amount"),
            scalars.sigmoid(x / 100).alias("probability"),
            scalars.risk_word(x).alias("word"),
        ),
        6,
    )


_W = ", ".join(str(float((i * 7) % 5 - 2)) for i in range(64))


@query(f"SELECT vec_id, round(1 / (1 + exp(-(0.5 + list_sum(list_transform(list_zip(embedding, [{_W}]), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))))), 4) AS probability FROM embeddings")
def linear_score(spark, sf_dir):
    weights = [float((i * 7) % 5 - 2) for i in range(64)]
    features = F.col("embedding").cast("array<double>")
    p = scalars.linear_probability(features, [0.0] * 64, [1.0] * 64, weights, 0.5)
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", p.alias("probability")))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def top_of_group(spark, sf_dir):
    over = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(over)).where("rn <= 3").select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT c_nationkey AS nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def unmatched_keys(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey"))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey")).join(rich, "nationkey", "left_anti").distinct()


@query("SELECT c_custkey, c_acctbal, round(c_acctbal / nullif(m, 0), 6) AS relative FROM customer LEFT JOIN (SELECT n_nationkey, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) ON c_nationkey = n_nationkey")
def relative_risk(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    means = rows.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return rounded(rows.join(means, "c_nationkey", "left").select("c_custkey", "c_acctbal", scalars.relative_risk(F.col("c_acctbal"), F.col("m")).alias("relative")), 6)


# Models.


@query(
    """SELECT CASE WHEN CAST(l_shipdate AS DATE) <= DATE '1998-12-31' THEN 0 WHEN CAST(l_shipdate AS DATE) >= DATE '2000-01-01' THEN 2 ELSE 1 END AS part,
  count(*) AS n, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1"""
)
def time_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", F.to_date("l_shipdate").alias("date"))
    parts = models.time_split(rows, "date", TRAIN_END, TEST_START)
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity"))


@query("SELECT model, average_precision FROM (" + ORACLE_SQL["baseline_forecast_skill"] + ") ORDER BY average_precision DESC, model DESC LIMIT 1")
def best_baseline(spark, sf_dir):
    return models.select_model(baseline_forecast_skill(spark, sf_dir))


@query()
def leave_one_site_out(spark, sf_dir):
    """Probability of an extreme day within 72 hours, by a logistic model fitted on the other sites."""
    rows = labelled(spark, sf_dir).select("site_id", "date", "rain", "t2m", F.col("y_72h").alias("y"))
    fits = models.leave_one_out(rows.where(F.col("date") <= TRAIN_END), ["rain", "t2m"], "site_id")
    return rounded(models.score_groups(rows.dropna(subset=["rain", "t2m"]), fits, ["rain", "t2m"], "site_id").select("site_id", "date", "y", "p"), 6)


@query()
def cross_flag_forecast(spark, sf_dir):
    """Days of each return flag scored by the model of the other flags' days, as one terrain is by the other."""
    rows = labelled(spark, sf_dir).select("site_id", "date", "rain", "t2m", F.left("site_id", F.lit(1)).alias("terrain"), F.col("y_72h").alias("y"))
    return rounded(models.across(rows, ["rain", "t2m"], "terrain").select("site_id", "date", "terrain", "y", "p"), 6)


def overload(rows: DataFrame) -> DataFrame:
    """A fixed logistic score of a machine's run."""
    return rows.withColumn("p", scalars.sigmoid(F.col("torque") * 0.02 + F.col("wear") * 0.01 - F.col("temp_diff") * 0.3 - 0.5))


@query(
    f"""WITH {MACHINE_SQL}, f AS (SELECT machine_id, CAST(max(torque) AS DOUBLE) AS torque, CAST(max(wear) AS DOUBLE) AS wear, round(max(temp_diff), 6) AS temp_diff FROM feature GROUP BY 1),
t AS (SELECT median(torque) AS tq, median(wear) AS w, median(temp_diff) AS td FROM f),
reset AS (SELECT machine_id, '' AS name, torque, wear, temp_diff FROM f UNION ALL SELECT machine_id, 'torque', tq, wear, temp_diff FROM f, t
  UNION ALL SELECT machine_id, 'wear', torque, w, temp_diff FROM f, t UNION ALL SELECT machine_id, 'temp_diff', torque, wear, td FROM f, t),
s AS (SELECT machine_id, name, 1 / (1 + exp(-(torque * 0.02 + wear * 0.01 - temp_diff * 0.3 - 0.5))) AS p FROM reset),
fall AS (SELECT a.machine_id, a.p, b.name, a.p - b.p AS fall FROM s a JOIN s b USING (machine_id) WHERE a.name = '' AND b.name <> '')
SELECT machine_id, round(max(p), 6) AS p,
  coalesce(string_agg(printf('%s +%.3f', name, fall), '; ' ORDER BY fall DESC, name) FILTER (WHERE fall > 0), 'several inputs') AS reasons
FROM fall GROUP BY machine_id"""
)
def overload_reasons(spark, sf_dir):
    """What each machine's highest readings owe their score to."""
    names = ["torque", "wear", "temp_diff"]
    highest = machines.features(machine_rows(spark, sf_dir)).groupBy("machine_id").agg(*(F.max(F.col(f).cast("double")).alias(f) for f in names))
    rows = highest.withColumn("temp_diff", F.round("temp_diff", 6))
    typical = metrics.quantiles(rows.select(names).unpivot([], names, "name", "value"), "value", [0.5], ["name"]).select("name", F.col("q")[0].alias("typical"))
    return models.reset_one_feature(rows, names, typical, overload, "machine_id").withColumn("p", F.round("p", 6))
