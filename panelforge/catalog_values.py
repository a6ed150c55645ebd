"""More registered queries: column functions, site tables, checks, joins by meaning, rankings and sets.

Customers stand for sites (with a place, a terrain and a status made of their columns), line items for machines and
pixels, orders for events.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import (
    EXTREME_SQL,
    MACHINE_SQL,
    PANEL_SQL,
    SCORED_SQL,
    TRAIN_END,
    _ORDERS,
    filled,
    labelled,
    machine_rows,
    observations,
    overload,
    panel,
    query,
    rounded,
    scored,
    table,
)
from panelforge.functions import scalars
from panelforge.operators import geo, machines, models, profile, scopes, series

SITES_SQL = """
sites AS (
  SELECT c_custkey AS site_id, c_name AS name, ['hill', 'coastal', 'desert'][CAST(c_custkey % 3 AS INTEGER) + 1] AS terrain,
    CASE c_custkey % 5 WHEN 0 THEN 'NOT_PULLED' WHEN 1 THEN 'PARTIAL: no rain' WHEN 2 THEN 'REAL' WHEN 3 THEN 'REAL (no heat)' END AS status,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_nationkey * 7 - 80 AS DOUBLE) END AS lat, CAST(c_custkey % 4 = 0 AS INTEGER) AS occurred, c_mktsegment AS kind, c_acctbal AS balance
  FROM customer
)"""


def sites(spark, sf_dir):
    key = F.col("c_custkey")
    status = F.when(key % 5 == 0, "NOT_PULLED").when(key % 5 == 1, "PARTIAL: no rain").when(key % 5 == 2, "REAL").when(key % 5 == 3, "REAL (no heat)")
    return table(spark, sf_dir, "customer").select(
        key.alias("site_id"),
        F.col("c_name").alias("name"),
        F.element_at(F.array(*map(F.lit, ("hill", "coastal", "desert"))), (key % 3 + 1).cast("int")).alias("terrain"),
        status.alias("status"),
        F.when(key % 11 != 0, (F.col("c_nationkey") * 7 - 80).cast("double")).alias("lat"),
        (key % 4 == 0).cast("int").alias("occurred"),
        F.col("c_mktsegment").alias("kind"),
        F.col("c_acctbal").alias("balance"),
    )


# Column functions.

_UNITS_SQL = ", ".join(
    f"round({x}, 8) AS {name}"
    for name, x in {
        "in_mm": "value * 25.4", "cm_mm": "value * 10", "degf_degc": "(value - 32) * 5 / 9", "k_degc": "value - 273.15", "fraction_percent": "value * 100", "hpa_kpa": "value / 10",
        "pa_kpa": "value / 1000", "inhg_kpa": "value * 3.38639", "kmh_ms": "value / 3.6", "mph_ms": "value * 0.44704", "kn_ms": "value * 0.514444", "kn_kmh": "value * 1.852",
    }.items()
)


@query(f"SELECT event_id, {_UNITS_SQL} FROM events")
def every_unit(spark, sf_dir):
    named = {"%": "percent", "m/s": "ms", "km/h": "kmh"}
    clean = lambda unit: named.get(unit, unit.lower())
    return rounded(table(spark, sf_dir, "events").select("event_id", *(scalars.convert(F.col("value"), a, b).alias(f"{clean(a)}_{clean(b)}") for a, b in scalars.UNITS)), 8)


@query(
    """WITH e AS (SELECT event_id, value, (event_id * 7) % 101 AS rh FROM events), g AS (SELECT *, ln(greatest(rh, 1) / 100.0) + 17.62 * (value / 3) / (243.12 + value / 3) AS g FROM e)
SELECT event_id, round(value * 4.87 / ln(67.8 * 10 - 5.42), 6) AS wind_2m, round(243.12 * g / (17.62 - g), 6) AS dew_point, round(101.3 * exp(-value * 10 / 8434.0), 6) AS pressure,
  CASE WHEN value < 28 THEN 'D' WHEN value < 34 THEN 'DD' WHEN value < 48 THEN 'CS' WHEN value < 64 THEN 'SCS' WHEN value < 90 THEN 'VSCS' WHEN value < 120 THEN 'ESCS' WHEN value IS NOT NULL THEN 'SuCS' END AS grade FROM g"""
)
def weather_conversions(spark, sf_dir):
    x = F.col("value")
    humidity = (F.col("event_id") * 7 % 101).cast("double")
    return rounded(
        table(spark, sf_dir, "events").select(
            "event_id",
            scalars.wind_at_2m(x).alias("wind_2m"),
            scalars.dew_point(x / 3, humidity).alias("dew_point"),
            scalars.surface_pressure(F.lit(101.3), x * 10).alias("pressure"),
            scalars.storm_grade(x).alias("grade"),
        ),
        6,
    )


@query("SELECT p_partkey, replace(lower(p_type) || '_' || p_size, '_', ' ') AS human, trim(split_part(p_name || ', ' || p_brand, ',', 1)) AS first, left(p_name || p_brand || p_type, 12) AS example FROM part")
def text_cleanup(spark, sf_dir):
    name = F.concat_ws("_", F.lower("p_type"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.humanised(name).alias("human"), scalars.first_part(F.concat("p_name", F.lit(", "), "p_brand")).alias("first"), scalars.example_text(F.concat("p_name", "p_brand", "p_type"), 12).alias("example")
    )


@query(
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 = 0 AS one FROM orders)
SELECT o_orderkey, date_diff('day', DATE '1990-01-01', d) AS days, CAST(d - INTERVAL 5 YEAR AS DATE) AS years_before, dayofyear(d) AS doy, d AS assembled, d AS start, CASE WHEN one THEN d ELSE d + 9 END AS "end" FROM o"""
)
def date_math(spark, sf_dir):
    d = F.to_date("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, d.cast("string")).otherwise(F.concat_ws(" to ", d.cast("string"), F.date_add(d, 9).cast("string")))
    span = scalars.date_range(text)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.datediff(d, F.lit("1990-01-01").cast("date")).cast("long").alias("days"),
        F.add_months(d, -60).alias("years_before"),
        F.dayofyear(d).cast("long").alias("doy"),
        scalars.from_day_of_year(F.year(d), F.dayofyear(d)).alias("assembled"),
        span["start"].alias("start"),
        span["end"].alias("end"),
    )


@query(
    f"""WITH {PANEL_SQL}, s AS (SELECT site_id, date, sum(rain) OVER (PARTITION BY site_id ORDER BY date RANGE BETWEEN INTERVAL 9 DAYS PRECEDING AND CURRENT ROW) AS d10,
  sum(rain) OVER (PARTITION BY site_id ORDER BY date RANGE BETWEEN INTERVAL 19 DAYS PRECEDING AND CURRENT ROW) AS d20 FROM panel)
SELECT site_id, date, round(CASE WHEN site_id IN ('AF', 'NO') THEN least(100, d10 / 550 * 100) END, 6) AS percent_10d, round(CASE WHEN site_id IN ('AF', 'NO') THEN least(100, d20 / 1850 * 100) END, 6) AS percent_20d,
  CASE WHEN site_id IN ('AF', 'NO') THEN d10 >= 550 OR d20 >= 1850 END AS over FROM s"""
)
def threshold_ratios(spark, sf_dir):
    """Antecedent rain against thresholds that hold for two sites only."""
    valid = F.col("site_id").isin("AF", "NO")
    rows = series.antecedent_sums(panel(spark, sf_dir).select("site_id", "date", "rain"), "rain", (10, 20)).withColumnsRenamed({"rain_10d": "d10", "rain_20d": "d20"})
    return rounded(
        rows.select(
            "site_id",
            "date",
            scalars.threshold_ratio(F.col("d10"), 550.0, valid).alias("percent_10d"),
            scalars.threshold_ratio(F.col("d20"), 1850.0, valid).alias("percent_20d"),
            scalars.over_threshold({550.0: F.col("d10"), 1850.0: F.col("d20")}, valid).alias("over"),
        ),
        6,
    )


@query(
    """WITH v AS (SELECT l_orderkey, l_linenumber, (least(greatest((0.08 - l_discount) / 0.08, 0), 1) + least(greatest((l_tax - 0.02) / 0.04, 0), 1)) / 2 * 100 AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, round(v, 6) AS index, CASE WHEN round(v, 9) < 25 THEN 'low' WHEN round(v, 9) < 50 THEN 'moderate' WHEN round(v, 9) < 75 THEN 'high' ELSE 'severe' END AS word FROM v"""
)
def vulnerability_index(spark, sf_dir):
    index = F.round(scalars.vulnerability(F.col("l_discount"), F.lit(0.08), F.col("l_tax"), F.lit(0.02), F.lit(0.06)), 9)
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", index.alias("index"), scalars.vulnerability_word(index).alias("word")), 6)


@query(
    f"""WITH {_ORDERS}, t AS (SELECT *, CAST(date_diff('day', min(date) OVER (PARTITION BY site_id), date) AS DOUBLE) AS t FROM o), l AS (SELECT site_id, regr_slope(value, t) AS b FROM t GROUP BY site_id)
SELECT site_id, CASE WHEN b < 0 THEN 'thinning' WHEN b > 0 THEN 'recovering' ELSE 'recovering' END AS plants, CASE WHEN b < 0 THEN 'shrinking' WHEN b > 0 THEN 'growing' ELSE 'flat' END AS buildings FROM l"""
)
def trend_words(spark, sf_dir):
    slope = F.col("slope_per_year")
    return series.linear_trend(observations(spark, sf_dir), "value").select(
        "site_id", scalars.trend_word(slope, "thinning", "recovering").alias("plants"), scalars.trend_word(slope, "shrinking", "growing", "flat").alias("buildings")
    )


_NAMES = [f"f{i:02d}" for i in range(64)]
_COEFFICIENTS = [float((i * 7) % 5 - 2) for i in range(64)]


@query(
    f"""WITH c AS (SELECT vec_id, list_transform(range(64), lambda i: {{'name': printf('f%02d', i), 'value': (embedding[i + 1]::DOUBLE - 0.1) / 0.5 * {_COEFFICIENTS}[i + 1]::DOUBLE}}) AS parts FROM embeddings),
u AS (SELECT vec_id, unnest(parts, recursive := true) FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(value) DESC, name) AS rn FROM u)
SELECT vec_id, string_agg(name, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS top, round(max(value) FILTER (WHERE rn = 1), 6) AS first, round(sum(value), 5) AS total FROM r GROUP BY vec_id"""
)
def top_contributions(spark, sf_dir):
    parts = scalars.contributions(F.col("embedding").cast("array<double>"), [0.1] * 64, [0.5] * 64, _COEFFICIENTS)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", parts.alias("parts")).withColumn("top3", scalars.largest_contributions(_NAMES, F.col("parts")))
    total = F.aggregate("parts", F.lit(0.0), lambda t, x: t + x)
    return rows.select("vec_id", F.concat_ws(",", F.transform("top3", lambda x: x["name"])).alias("top"), F.round(F.col("top3")[0]["value"], 6).alias("first"), F.round(total, 5).alias("total"))


_MEAN, _SCALE, _BETA = [2.0, 30_000.0, 0.05], [1.5, 20_000.0, 0.03], [-0.8, 0.4, 0.9]


@query(
    """WITH z AS (SELECT l_orderkey, l_linenumber, (l_quantity / 10 - 2) / 1.5 AS a, (l_extendedprice - 30000) / 20000 AS b, (l_discount - 0.05) / 0.03 AS c FROM lineitem),
p AS (SELECT *, 1 / (1 + exp(-(0.2 - 0.8 * a + 0.4 * b + 0.9 * c))) AS p, 1 / (1 + exp(-(0.2 - 0.8 * (a + 1) + 0.4 * b + 0.9 * c))) AS pa, 1 / (1 + exp(-(0.2 - 0.8 * a + 0.4 * b + 0.9 * (c - 1)))) AS pc FROM z),
g AS (SELECT *, greatest((p - pa) * 100, 0) AS ga, greatest((p - pc) * 100, 0) AS gc FROM p)
SELECT l_orderkey, l_linenumber, round(p, 6) AS p, round(ga, 5) AS cover_gain, round(gc, 5) AS building_gain, CASE WHEN greatest(ga, gc) >= 0.5 THEN CASE WHEN gc >= ga THEN 'building' ELSE 'cover' END END AS best FROM g"""
)
def lever_comparison(spark, sf_dir):
    """What one standard deviation in each feature that can be controlled would gain."""
    names = ["cover", "price", "building"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.col("l_quantity") / 10, "l_extendedprice", "l_discount").alias("x"))
    found = scopes.levers(F.col("x"), names, _MEAN, _SCALE, _BETA, 0.2, ["building", "cover"])
    rows = rows.withColumns({"p": scalars.linear_probability(F.col("x"), _MEAN, _SCALE, _BETA, 0.2), "levers": found})
    gain = lambda name: F.round(F.filter("levers", lambda x: x["name"] == name)[0]["gain"], 5)
    return rows.select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"), gain("cover").alias("cover_gain"), gain("building").alias("building_gain"), scopes.best_lever(F.col("levers")).alias("best"))


@query(
    f"""WITH {MACHINE_SQL}, f AS (SELECT machine_id, CAST(max(torque) AS DOUBLE) AS torque, CAST(max(wear) AS DOUBLE) AS wear, round(max(temp_diff), 6) AS temp_diff FROM feature GROUP BY 1),
s AS (SELECT * FROM (VALUES ('as it is', 0.0, 0.0), ('more load', 5.0, 0.0), ('worn and loaded', 5.0, 40.0)) t(scenario, dt, dw))
SELECT scenario, machine_id, round(1 / (1 + exp(-((torque + dt) * 0.02 + (wear + dw) * 0.01 - temp_diff * 0.3 - 0.5))), 6) AS p FROM f CROSS JOIN s"""
)
def what_if(spark, sf_dir):
    rows = machines.features(machine_rows(spark, sf_dir)).groupBy("machine_id").agg(*(F.max(F.col(f).cast("double")).alias(f) for f in ("torque", "wear", "temp_diff")))
    scenarios = spark.createDataFrame([("as it is", None, None), ("more load", 5.0, None), ("worn and loaded", 5.0, 40.0)], "scenario string, torque double, wear double")
    return rounded(overload(scopes.what_if(rows.withColumn("temp_diff", F.round("temp_diff", 6)), scenarios, ["torque", "wear"])).select("scenario", "machine_id", "p"), 6)


@query(
    f"""WITH {SCORED_SQL}, s AS (SELECT doc_id, least(p, 1) AS p, p >= 0.1 AS alert, p > coalesce(try_cast(1000.0 + doc_id % 7 * 300 AS DOUBLE) / nullif(doc_id % 5 * 10000, 0), 1e9) AS act, doc_id % 3 = 0 AS fragile, doc_id % 4 = 0 AS exposed, least(p, 1) / 0.02 AS relative FROM scored)
SELECT doc_id, act, CASE WHEN alert AND act AND (fragile OR exposed) THEN 'severe' WHEN alert OR (act AND exposed) THEN 'high' WHEN act OR (relative >= 3 AND p >= 0.05) THEN 'moderate' ELSE 'low' END AS impact,
  CASE WHEN act THEN 'act now' WHEN alert OR relative >= 3 THEN 'prepare' ELSE 'monitor' END AS advice, round(p * (doc_id % 9), 6) AS units, round(p * (doc_id % 5 * 10000), 4) AS loss FROM s"""
)
def decision_outlook(spark, sf_dir):
    """Whether to act, how severe the impact would be, and the loss to expect."""
    key = F.col("doc_id")
    rows = scored(spark, sf_dir).select("doc_id", F.least("p", F.lit(1.0)).alias("p"), (key % 5 * 10000).cast("double").alias("value"), (1000.0 + key % 7 * 300).alias("cost"), (key % 3 == 0).alias("fragile"), (key % 4 == 0).alias("exposed"))
    p, alert, relative = F.col("p"), F.col("p") >= 0.1, scalars.relative_risk(F.col("p"), F.lit(0.02))
    act = scalars.act_rule(p, F.col("cost"), F.col("value"))
    units, loss = scopes.expected_loss(p, (key % 9).cast("double"), F.col("value"))
    return rows.select(
        "doc_id",
        act.alias("act"),
        scopes.impact(alert, act, F.col("fragile"), F.col("exposed"), relative, p, F.lit(0.1)).alias("impact"),
        scopes.advice(act, alert, relative).alias("advice"),
        F.round(units, 6).alias("units"),
        F.round(loss, 4).alias("loss"),
    )


@query(f"WITH {SCORED_SQL}, s AS (SELECT doc_id, p AS a, p * (doc_id % 3) AS b, p * (doc_id % 2) AS c FROM scored) SELECT doc_id, round(a, 6) AS p24, round(greatest(a, b), 6) AS p48, round(greatest(a, b, c), 6) AS p72 FROM s")
def consistent_horizons(spark, sf_dir):
    p = F.col("p")
    found = models.consistent(p, p * (F.col("doc_id") % 3), p * (F.col("doc_id") % 2))
    return scored(spark, sf_dir).select("doc_id", *(F.round(x, 6).alias(n) for x, n in zip(found, ("p24", "p48", "p72"), strict=True)))


# Machines.

_MODES_SQL = "CASE WHEN temp_diff < 8.6 AND rpm < 1380 THEN 'HDF' END, CASE WHEN power < 3500 OR power > 9000 THEN 'PWF' END, CASE WHEN strain_ratio >= 0.9 THEN 'OSF' END, CASE WHEN wear >= 200 THEN 'TWF' END"


@query(
    f"""WITH {MACHINE_SQL}, f AS (SELECT CAST(torque > 40 AS INTEGER) AS y, CAST(power > 9000 AS INTEGER) AS pwf, CAST(wear >= 200 AS INTEGER) AS twf FROM feature)
SELECT sum(pwf) AS pwf, sum(twf) AS twf, count(*) FILTER (WHERE y = 1 AND pwf + twf = 0) AS no_mode FROM f"""
)
def mode_sums(spark, sf_dir):
    f = machines.features(machine_rows(spark, sf_dir))
    rows = f.select((F.col("torque") > 40).cast("int").alias("y"), (F.col("power") > 9000).cast("int").alias("pwf"), (F.col("wear") >= 200).cast("int").alias("twf"))
    return machines.modes_missing(rows, "y", ["pwf", "twf"])


@query(
    f"""WITH {MACHINE_SQL}, d AS (SELECT machine_id, round(abs(torque - 55.5) * 2 + abs(wear - 120), 6) AS distance FROM feature) SELECT machine_id, distance FROM d ORDER BY distance, machine_id LIMIT 1"""
)
def nearest_machine(spark, sf_dir):
    found = machines.nearest_example(machines.features(machine_rows(spark, sf_dir)), {"torque": 55.5, "wear": 120.0}, {"torque": 2.0})
    return rounded(found.select("machine_id", "distance"), 6)


_ADVICE_SQL = f"""
WITH {MACHINE_SQL}, q AS (SELECT machine_id, rpm, power, strain_ratio, wear, wear_per_run, round(temp_diff, 6) AS temp_diff, CAST(machine_id % 10 AS DOUBLE) / 10 AS hdf, CAST(machine_id % 7 AS DOUBLE) / 100 AS pwf, 0.2 AS osf, CAST(machine_id % 3 AS DOUBLE) / 10 AS twf FROM feature),
m AS (SELECT *, list_filter([{_MODES_SQL}], lambda x: x IS NOT NULL) AS modes,
  list_sort([{{'p': -twf, 'i': 0, 'm': 'tool wear'}}, {{'p': -hdf, 'i': 1, 'm': 'heat dissipation'}}, {{'p': -pwf, 'i': 2, 'm': 'power'}}, {{'p': -osf, 'i': 3, 'm': 'overstrain'}}])[1] AS likely FROM q),
t AS (SELECT *, list_sort(list_transform(modes, lambda x: {{'p': -CASE x WHEN 'HDF' THEN hdf WHEN 'PWF' THEN pwf WHEN 'OSF' THEN osf ELSE twf END, 'm': x}}))[1].m AS top,
  CAST(greatest(ceil((200 - wear) / wear_per_run), 0) AS INTEGER) AS to_window, CASE WHEN machine_id % 5 > 0 THEN CAST(machine_id % 60 AS INTEGER) END AS runs FROM m)"""


@query(
    _ADVICE_SQL
    + """SELECT machine_id, CASE top WHEN 'HDF' THEN printf('heat is not carried off: %.1f K between process and air at %.0f rpm', temp_diff, rpm + 0.0001) WHEN 'PWF' THEN printf('power of %.0f W is outside 3500 to 9000 W', round(power, 3) + 0.0001)
  WHEN 'OSF' THEN printf('strain is %.0f %% of the limit for this type', round(strain_ratio, 8) * 100 + 0.0001) WHEN 'TWF' THEN printf('tool wear of %.0f min is in the replacement window', wear::DOUBLE)
  ELSE printf('closest to %s (%.0f %%)', likely.m, -likely.p * 100) END AS reason,
  CASE WHEN hdf >= 0.8 THEN 'alert: stop and see to ' || likely.m WHEN runs <= 20 THEN printf('plan: expected to alert in %d runs', runs) WHEN to_window = 0 THEN 'tool: in the replacement window'
  ELSE printf('ok: check again in %d runs', least(to_window, 25)) END AS action FROM t"""
)
def machine_advice(spark, sf_dir):
    """The reason given for each row of readings, and what to do."""
    key = F.col("machine_id")
    tenths = lambda n, by: (key % n).cast("double") / by
    chances = F.create_map(F.lit("HDF"), tenths(10, 10), F.lit("PWF"), tenths(7, 100), F.lit("OSF"), F.lit(0.2), F.lit("TWF"), tenths(3, 10))
    rows = machines.mechanisms(machines.features(machine_rows(spark, sf_dir))).withColumns({"chances": chances, "temp_diff": F.round("temp_diff", 6), "power": F.round("power", 3) + 0.0001, "strain_ratio": F.round("strain_ratio", 8) + 0.000001, "rpm": F.col("rpm") + 0.0001})
    runs = F.when(key % 5 > 0, (key % 60).cast("int"))
    return rows.select(
        "machine_id",
        machines.reason(F.col("modes"), F.col("chances")).alias("reason"),
        machines.action(tenths(10, 10), F.lit(0.8), runs, machines.runs_to_window(F.col("wear"), F.col("wear_per_run")), F.col("chances")).alias("action"),
    )


# Places and pixels.


@query(
    """SELECT l_returnflag AS site_id, min(l_quantity) AS elev_min, round(avg(l_quantity), 6) AS elev_mean, max(l_quantity) AS elev_max, min(l_discount) AS slope_min, round(avg(l_discount), 6) AS slope_mean, max(l_discount) AS slope_max FROM lineitem GROUP BY 1"""
)
def terrain_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("site_id"), F.col("l_quantity").alias("elev"), F.col("l_discount").alias("slope"))
    return rounded(geo.terrain_summary(rows), 6)


@query("SELECT o_orderpriority AS site_id, year(o_orderdate) AS year, round(sum(o_totalprice) / 10000, 4) AS area_ha FROM orders GROUP BY 1, 2")
def area_by_year(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site_id"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_totalprice").alias("area_m2"))
    return rounded(geo.area_by_year(rows))


@query(
    """WITH g AS (SELECT p_partkey // 25 AS site_id, p_partkey % 25 // 5 AS i, p_partkey % 5 AS j, p_retailprice AS elev FROM part),
s AS (SELECT site_id, coalesce((lead(elev) OVER a - lag(elev) OVER a) / 60, (lead(elev) OVER a - elev) / 30, (elev - lag(elev) OVER a) / 30) AS di,
  coalesce((lead(elev) OVER b - lag(elev) OVER b) / 60, (lead(elev) OVER b - elev) / 30, (elev - lag(elev) OVER b) / 30) AS dj
  FROM g WINDOW a AS (PARTITION BY site_id, j ORDER BY i), b AS (PARTITION BY site_id, i ORDER BY j))
SELECT site_id, round(avg(degrees(atan(sqrt(di * di + dj * dj)))), 6) AS mean_slope FROM s GROUP BY site_id"""
)
def mean_slope(spark, sf_dir):
    key = F.col("p_partkey")
    grid = table(spark, sf_dir, "part").select(F.floor(key / 25).cast("long").alias("site_id"), F.floor(key % 25 / 5).alias("i"), (key % 5).alias("j"), F.col("p_retailprice").alias("elev"))
    return rounded(geo.mean_slope(grid, 30.0), 6)


_IMAGES_SQL = "images AS (SELECT l_returnflag AS site_id, CAST(l_shipdate AS DATE) AS date, min(l_discount) AS cloud_pct FROM lineitem GROUP BY 1, 2)"


@query(
    f"""WITH {_IMAGES_SQL}, targets AS (SELECT DISTINCT ['A', 'N', 'R'][CAST(o_custkey % 3 AS INTEGER) + 1] AS site_id, CAST(o_orderdate AS DATE) AS "at", CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS floor FROM orders WHERE month(o_orderdate) = 6),
r AS (SELECT t.site_id, t."at", i.date, i.cloud_pct, row_number() OVER (PARTITION BY t.site_id, t."at" ORDER BY cloud_pct, abs(date_diff('day', t."at", i.date)), i.date) AS rn
  FROM targets t JOIN images i ON i.site_id = t.site_id AND abs(date_diff('day', t."at", i.date)) <= 45 AND (floor IS NULL OR i.date >= floor))
SELECT site_id, "at", date, cloud_pct FROM r WHERE rn = 1"""
)
def least_cloudy(spark, sf_dir):
    images = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("site_id"), F.to_date("l_shipdate").alias("date")).agg(F.min("l_discount").alias("cloud_pct"))
    day, key = F.to_date("o_orderdate"), F.col("o_custkey")
    targets = table(spark, sf_dir, "orders").where(F.month("o_orderdate") == 6).select(F.element_at(F.array(*map(F.lit, "ANR")), (key % 3 + 1).cast("int")).alias("site_id"), day.alias("at"), F.when(key % 2 == 0, day).alias("floor"))
    return geo.least_cloudy(images, targets.distinct())


_TRACK_SQL = """s AS (SELECT n_nationkey AS site_id, CAST(n_nationkey * 3 - 30 AS DOUBLE) AS lat, CAST((n_nationkey * 37) % 360 - 180 AS DOUBLE) AS lon FROM nation),
e AS (SELECT o_orderkey AS point_id, CAST(o_orderkey * 13 % 170 - 85 AS DOUBLE) AS lat, CAST(o_orderkey * 29 % 360 - 180 AS DOUBLE) AS lon, o_totalprice / 1500 AS wind_kn, CAST(o_orderdate AS DATE) AS ts FROM orders)"""


@query(
    f"""WITH {_TRACK_SQL}, d AS (SELECT site_id, point_id, 2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians(e.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - s.lon) / 2), 2)))) AS km
  FROM s CROSS JOIN e WHERE wind_kn >= 48 AND ts BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(km, 6), point_id) AS rn FROM d WHERE km <= 2000) SELECT site_id, point_id, round(km, 4) AS distance_km FROM r WHERE rn = 1"""
)
def closest_track_point(spark, sf_dir):
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site_id"), (F.col("n_nationkey") * 3 - 30).cast("double").alias("lat"), (F.col("n_nationkey") * 37 % 360 - 180).cast("double").alias("lon"))
    key = F.col("o_orderkey")
    points = table(spark, sf_dir, "orders").select(key.alias("point_id"), (key * 13 % 170 - 85).cast("double").alias("lat"), (key * 29 % 360 - 180).cast("double").alias("lon"), (F.col("o_totalprice") / 1500).alias("wind_kn"), F.to_date("o_orderdate").alias("ts"))
    found = geo.closest_track_point(places, points, F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"), 48.0, 2000.0)
    return rounded(found.select("site_id", "point_id", "distance_km"))


# Checks of tables.


@query(
    """WITH r AS (SELECT o_orderpriority AS site_id, CAST(o_orderdate AS DATE) AS date, o_totalprice, o_orderkey % 500 AS wind, o_orderkey FROM orders),
b AS (SELECT site_id, date, 'o_totalprice' AS name, CAST(o_totalprice AS DOUBLE) AS value, 0 AS k FROM r WHERE o_totalprice > 240000 UNION ALL SELECT site_id, date, 'wind', wind, 1 FROM r WHERE wind > 480 AND o_totalprice <= 240000)
SELECT site_id, date, name, value FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date, name, value) AS rn FROM b) WHERE rn = 1"""
)
def first_impossible(spark, sf_dir):
    """The earliest value of each site that can't be."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("site_id"), F.to_date("o_orderdate").alias("date"), "o_totalprice", (F.col("o_orderkey") % 500).alias("wind"))
    return profile.first_impossible(rows, {"o_totalprice": (0.0, 240_000.0), "wind": (0.0, 480.0)})


@query(
    """WITH t AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN ' n/a ' WHEN c_custkey % 50 = 0 THEN '  ' ELSE CAST(c_custkey AS VARCHAR) END AS x, c_name AS y FROM customer)
SELECT 'x' AS name, count(*) FILTER (WHERE x = ' n/a ') AS n, min(trim(x)) FILTER (WHERE x = ' n/a ') AS example FROM t UNION ALL SELECT 'y', count(*), min(y) FROM t"""
)
def not_numbers(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.when(key % 97 == 0, " n/a ").when(key % 50 == 0, "  ").otherwise(key.cast("string")).alias("x"), F.col("c_name").alias("y"))
    return profile.not_numbers(rows, ["x", "y"])


@query("SELECT p_partkey, upper(trim(' ' || left(p_type, 2) || ' ')) AS type, upper(left(p_type, 2)) IN ('EC', 'PR', 'ST') AS valid FROM part")
def enum_check(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.lower(F.left("p_type", F.lit(2))), F.lit(" ")).alias("type"))
    return profile.check_enum(rows, "type", ["EC", "PR", "ST"])


@query(
    """SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, o_orderkey % 10 = 0 AS unreadable, o_orderkey FROM orders"""
)
def readable_dates(spark, sf_dir):
    """Dates as texts of two shapes, normalised to days; texts that are none are told."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.when(key % 10 == 0, "soon").when(key % 10 < 5, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "yyyy-MM-dd HH:mm"))
    day, bad = profile.readable_date(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", day.alias("date"), bad.alias("unreadable"))


@query(
    """WITH t AS (SELECT c_custkey AS site_id, CASE WHEN c_custkey % 2 = 0 THEN 1 END AS ndvi, CASE WHEN c_custkey % 3 = 0 THEN 1 END AS ndbi, CASE WHEN c_custkey % 6 < 4 THEN 1 END AS rain FROM customer)
SELECT site_id, CASE WHEN ndvi IS NOT NULL AND ndbi IS NOT NULL AND rain IS NOT NULL THEN 'REAL' WHEN ndvi IS NULL AND ndbi IS NULL AND rain IS NULL THEN 'NOT_PULLED'
  ELSE 'PARTIAL: missing ' || concat_ws(', ', CASE WHEN ndvi IS NULL THEN 'ndvi' END, CASE WHEN ndbi IS NULL THEN 'ndbi' END, CASE WHEN rain IS NULL THEN 'rain' END) END AS status FROM t"""
)
def pull_status(spark, sf_dir):
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("site_id"), F.when(key % 2 == 0, 1).alias("ndvi"), F.when(key % 3 == 0, 1).alias("ndbi"), F.when(key % 6 < 4, 1).alias("rain"))
    return profile.pull_status(rows, ["ndvi", "ndbi", "rain"]).select("site_id", "status")


@query("SELECT unnest(['c_acctbal', 'c_nationkey']) AS name")
def optional_columns(spark, sf_dir):
    """Optional features without a missing value."""
    rows = table(spark, sf_dir, "customer").withColumn("heat", F.when(F.col("c_custkey") > 0, 1.0))
    return spark.createDataFrame([(c,) for c in profile.complete_columns(rows, ["c_acctbal", "heat", "c_nationkey"])], "name string")


@query(
    """WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part),
t AS (SELECT p_partkey, list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]))) AS t FROM w)
SELECT p_partkey, array_to_string(list_sort(t), ' ') AS tokens, len(list_intersect(t, ['small', 'brand1', 'ringbrand'])) > 0 AS matches, len(list_intersect(t, ['small', 'brand1', 'ringbrand'])) AS shared FROM t"""
)
def name_tokens(spark, sf_dir):
    tokens, wanted = scalars.name_tokens(F.concat_ws(" ", "p_name", "p_brand")), F.array(*map(F.lit, ("small", "brand1", "ringbrand")))
    rows = table(spark, sf_dir, "part").select("p_partkey", tokens.alias("t"))
    return rows.select("p_partkey", F.concat_ws(" ", F.sort_array("t")).alias("tokens"), F.arrays_overlap("t", wanted).alias("matches"), F.size(F.array_intersect("t", wanted)).cast("long").alias("shared"))


# Site tables.


@query(f"WITH {SITES_SQL} SELECT site_id, terrain, status FROM sites WHERE status LIKE 'REAL%' AND lat IS NOT NULL AND terrain IN ('hill', 'coastal')")
def real_sites(spark, sf_dir):
    return scopes.real_sites(sites(spark, sf_dir)).where(F.col("terrain").isin("hill", "coastal")).select("site_id", "terrain", "status")


@query(f"WITH {SITES_SQL}, s AS (SELECT *, CASE WHEN status LIKE 'REAL%' THEN CASE WHEN terrain IN ('hill', 'coastal') THEN 'in' ELSE 'out' END ELSE 'pending' END AS state FROM sites) SELECT state, terrain, count(*) AS n FROM s GROUP BY 1, 2")
def scope_states(spark, sf_dir):
    state = scopes.scope_state(F.col("terrain"), F.col("status"), ["hill", "coastal"])
    return sites(spark, sf_dir).groupBy(state.alias("state"), "terrain").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SITES_SQL} SELECT site_id, terrain, kind FROM sites WHERE (terrain = 'hill' AND occurred = 0) OR kind IN ('BUILDING', 'MACHINERY')")
def mechanism_scope(spark, sf_dir):
    return scopes.mechanism_scope(sites(spark, sf_dir), "hill", ["BUILDING", "MACHINERY"]).select("site_id", "terrain", "kind")


@query(f"WITH {SITES_SQL} SELECT site_id, CAST(terrain = 'coastal' AS INTEGER) AS terrain_is_coastal, CAST(terrain = 'desert' AS INTEGER) AS terrain_is_desert, CAST(NULL AS DOUBLE) AS heat, balance FROM sites")
def terrain_dummies(spark, sf_dir):
    """Coded terrains in a table of fixed columns, of which one is not there yet."""
    coded = scopes.dummies(sites(spark, sf_dir), "terrain", ["hill", "coastal", "desert"])
    return scopes.with_template(coded, {"site_id": "long", "terrain_is_coastal": "int", "terrain_is_desert": "int", "heat": "double", "balance": "double"})


@query(f"WITH {SITES_SQL} SELECT site_id, name, lat, CASE WHEN occurred = 1 THEN kind END AS kind FROM sites")
def served_sites(spark, sf_dir):
    return scopes.served(sites(spark, sf_dir), ["site_id", "name", "lat", "kind"], "occurred", ["kind"])


@query(
    f"""WITH {PANEL_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY date DESC) AS rn FROM panel) SELECT site_id, count(*) AS days, count(*) FILTER (WHERE rain > 40) AS unfamiliar_days FROM h WHERE rn <= 30 GROUP BY site_id"""
)
def unfamiliar_lately(spark, sf_dir):
    rows = panel(spark, sf_dir).withColumn("unfamiliar", F.when(F.col("rain") > 40, "rain"))
    return scopes.unfamiliar_lately(rows)


@query(f"WITH {SITES_SQL} SELECT site_id, terrain, has_model FROM (SELECT site_id, terrain, true AS has_model FROM sites WHERE terrain <> 'desert' UNION ALL SELECT site_id, terrain, false FROM sites WHERE terrain = 'desert')")
def modelled_and_others(spark, sf_dir):
    rows = sites(spark, sf_dir)
    return scopes.modelled_and_others(rows.where("terrain <> 'desert'"), rows.where("terrain = 'desert'").drop("balance")).select("site_id", "terrain", "has_model")


@query(f"WITH {SITES_SQL} SELECT o_orderkey, s.site_id, terrain, kind FROM orders JOIN sites s ON o_custkey = s.site_id")
def known_sites(spark, sf_dir):
    """Orders with their site's attributes; an unknown site would be an error."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("site_id"))
    return scopes.require_known(rows, sites(spark, sf_dir)).select("o_orderkey", "site_id", "terrain", "kind")


@query(f"WITH {SITES_SQL} SELECT site_id, terrain, s_acctbal AS wind FROM sites LEFT JOIN supplier ON s_suppkey = site_id")
def sparse_attributes(spark, sf_dir):
    storms = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site_id"), F.col("s_acctbal").alias("wind"))
    return sites(spark, sf_dir).join(storms, "site_id", "left").select("site_id", "terrain", "wind")


@query(
    f"""WITH {EXTREME_SQL}, l AS (SELECT site_id, date, greatest(y1, y2, y3) + 0 * y1 * y2 * y3 AS y FROM labelled), m AS (SELECT month(date) AS month, avg(y) AS c FROM l WHERE date <= DATE '{TRAIN_END}' GROUP BY 1)
SELECT f.site_id, f.date, round(f.rain / 500, 6) AS p, y, round(c, 6) AS climatology FROM filled f LEFT JOIN l USING (site_id, date) LEFT JOIN m ON month(f.date) = m.month"""
)
def predictions_with_labels(spark, sf_dir):
    """Predictions meet their labels by site and date, and a rate by month alone."""
    rows = labelled(spark, sf_dir).select("site_id", "date", F.col("y_72h").alias("y"))
    rates = rows.where(F.col("date") <= TRAIN_END).groupBy(F.month("date").alias("month")).agg(F.avg("y").alias("climatology"))
    predicted = filled(spark, sf_dir).select("site_id", "date", (F.col("rain") / 500).alias("p"))
    joined = predicted.join(rows, ["site_id", "date"], "left").withColumn("month", F.month("date")).join(F.broadcast(rates), "month", "left")
    return rounded(joined.select("site_id", "date", "p", "y", "climatology"), 6)


@query(f"WITH {SITES_SQL} SELECT site_id, balance > 0 AS predicted, occurred AS actual, terrain, row_number() OVER (ORDER BY site_id) - 1 AS at FROM sites WHERE site_id % 10 = 3")
def aligned_arrays(spark, sf_dir):
    """Results kept as parallel arrays, made rows again and joined with their sites."""
    rows = sites(spark, sf_dir).where("site_id % 10 = 3")
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("site_id", (F.col("balance") > 0).alias("p"), "occurred"))).alias("x")).select(F.col("x.site_id").alias("ids"), F.col("x.p").alias("p"), F.col("x.occurred").alias("y"))
    found = scopes.aligned(packed, ["ids", "p", "y"], ["site_id", "predicted", "actual"])
    return found.join(rows.select("site_id", "terrain"), "site_id").select("site_id", "predicted", "actual", "terrain", F.col("at").cast("long").alias("at"))


_RANK_SQL = f"WITH {SITES_SQL} SELECT site_id, balance, value AS second FROM (SELECT * FROM sites ORDER BY balance DESC, site_id LIMIT 8) LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1) ON o_custkey = site_id"


@query(_RANK_SQL)
def top_sites(spark, sf_dir):
    """The eight sites of the largest value, with a second signal where there is one."""
    second = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("site_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("second"))
    return scopes.ranked(sites(spark, sf_dir), "balance", n=8).join(second, "site_id", "left").select("site_id", "balance", "second")


@query(f"WITH {SITES_SQL} SELECT site_id, kind, row_number() OVER (ORDER BY lower(kind) DESC, site_id) AS place FROM sites")
def sorted_sites(spark, sf_dir):
    """All sites in an order of the user's choice, shown by their places."""
    ordered = scopes.sort_rows(sites(spark, sf_dir), "kind", descending=True)
    return _places(ordered)


def _places(ordered):
    """Places in the order of a sorted table: the rows of earlier partitions plus those before in the own one."""
    numbered = ordered.select("site_id", "kind", F.monotonically_increasing_id().alias("__m"))
    parts = numbered.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND((1 << 33) - 1)})
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.alias("a").join(F.broadcast(sizes.alias("b")), F.col("b.__p") < F.col("a.__p"), "left").groupBy("a.__p").agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    return parts.join(F.broadcast(before), "__p").select("site_id", "kind", (F.col("__before") + F.col("__i") + 1).alias("place"))


@query(
    f"""WITH {SCORED_SQL}, r AS (SELECT doc_id, toxic AS y, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) AS rn FROM scored) SELECT doc_id, y FROM r ORDER BY CASE WHEN y = 1 AND rn <= 8 THEN 0 ELSE 1 END, doc_id LIMIT 25"""
)
def demo_sample(spark, sf_dir):
    return models.stratified_sample(scored(spark, sf_dir).select("doc_id", F.col("toxic").alias("y")), "y", "doc_id")


@query(f"WITH {EXTREME_SQL} SELECT site_id, round(min(threshold), 1) AS threshold FROM flagged GROUP BY site_id")
def group_constants(spark, sf_dir):
    """What is the same in all rows of a site, once and rounded."""
    rows = labelled(spark, sf_dir)
    return rows.groupBy("site_id").agg(F.round(F.min("threshold"), 1).alias("threshold"))


@query(
    f"""WITH {PANEL_SQL} SELECT site_id, date, 'train' AS part FROM filled WHERE date <= DATE '{TRAIN_END}' UNION ALL SELECT site_id, date, 'validation' FROM filled WHERE date > DATE '{TRAIN_END}' AND date < DATE '2000-01-01'"""
)
def refit_rows(spark, sf_dir):
    """Train and validation rows together, for the model that is deployed."""
    parts = models.time_split(filled(spark, sf_dir), "date", TRAIN_END, "2000-01-01")
    train, validation = (parts.where(F.col("part") == i).select("site_id", "date", F.lit(n).alias("part")) for i, n in ((0, "train"), (1, "validation")))
    return train.unionByName(validation)


@query("SELECT CAST(0 AS BIGINT) AS shared, (SELECT count(*) - count(DISTINCT o_orderkey) FROM orders) AS lost")
def disjoint_splits(spark, sf_dir):
    """No row is in two parts of a random split, and none is lost."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    parts = models.stratified_split(rows, "y", "id")
    each = parts.groupBy("id").agg(F.count_distinct("part").alias("parts"), F.count(F.lit(1)).alias("n"))
    return each.agg(F.count_if(F.col("parts") > 1).alias("shared"), F.sum("n").alias("n")).crossJoin(rows.agg(F.count(F.lit(1)).alias("all"))).select("shared", (F.col("all") - F.col("n")).alias("lost"))
