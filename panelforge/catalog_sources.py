"""Registered queries of readers and sinks: tables are written in the formats that sources come in and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.catalog import EXTREME_SQL, PANEL_SQL, filled, labelled, panel, query, rounded, table
from panelforge.functions import scalars
from panelforge.operators import series
from panelforge.sources import readers, runs, sinks

_PANEL = f"WITH {PANEL_SQL} SELECT site_id, date, rain, round(t2m, 10) AS t2m FROM panel"


def _panel(spark, sf_dir):
    return panel(spark, sf_dir).select("site_id", "date", "rain", F.round("t2m", 10).alias("t2m"))


def _files(df, key: str, path: str) -> None:
    """One text file for each key, of a column ``value`` that holds it whole."""
    df.select(key, "value").repartition(key).write.partitionBy(key).text(path)


@query(_PANEL)
def csv_round_trip(spark, sf_dir):
    """Semicolons are found by the first line, columns keep their order, blanks are missing."""
    path = sinks.work_folder(spark, "csv")
    sinks.write_csv(_panel(spark, sf_dir), path, ["site_id", "date", "rain", "t2m"], sep=";")
    return readers.read_csv(spark, path, "site_id string, date date, rain double, t2m double").drop("_corrupt_record")


@query(
    f"WITH {PANEL_SQL} SELECT site_id, date, round(rain, 4) AS rain, round(t2m, 10) AS t2m FROM panel"
)
def preamble_round_trip(spark, sf_dir):
    """A file a site: lines of metadata, a header of year and day of the year, inches and kelvins, a sentinel for what is missing."""
    line = F.format_string("%d;%d;%.8f;%.12f", F.year("date"), F.dayofyear("date"), F.col("rain") / 25.4, F.coalesce(F.col("t2m") + 273.15, F.lit(-999.0)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("date", line.alias("line")))), lambda x: x["line"])
    head = F.lit("-BEGIN HEADER-\nsource;station\n\n-END HEADER-\nYEAR;DOY;RAIN_IN;T2M_K\n")
    path = sinks.work_folder(spark, "preamble")
    _files(_panel(spark, sf_dir).groupBy("site_id").agg(F.concat(head, F.concat_ws("\n", lines)).alias("value")), "site_id", path)
    cells = readers.read_with_preamble(spark, f"{path}/*/*.txt")
    found = cells.select(
        F.regexp_extract("file", "site_id=([^/]+)/", 1).alias("site_id"),
        readers.date_of(F.col("cells")).alias("date"),
        readers.quantity(F.col("cells"), "rain_in", "in", "mm").alias("rain"),
        F.round(readers.quantity(F.col("cells"), "t2m_k", "K", "degC"), 10).alias("t2m"),
    )
    return found.withColumn("rain", F.round("rain", 4))


@query(f"WITH {PANEL_SQL} SELECT site_id, date, rain, round(t2m, 10) AS t2m FROM filled")
def power_json_round_trip(spark, sf_dir):
    """Maps of maps by parameter and day; what is missing is a sentinel."""
    days = lambda c: F.map_from_entries(F.collect_list(F.struct(F.date_format("date", "yyyyMMdd").alias("k"), F.coalesce(F.col(c), F.lit(-999.0)).alias("v"))))
    path = sinks.work_folder(spark, "power")
    each = filled(spark, sf_dir).select("site_id", "date", "rain", F.round("t2m", 10).alias("t2m")).groupBy("site_id").agg(days("rain").alias("PRECTOTCORR"), days("t2m").alias("T2M"))
    _files(each.select("site_id", F.to_json(F.struct(F.struct(F.struct("PRECTOTCORR", "T2M").alias("parameter")).alias("properties"))).alias("value")), "site_id", path)
    return readers.read_power_json(spark, f"{path}/*/*.txt").select(F.regexp_extract("file", "site_id=([^/]+)/", 1).alias("site_id"), "date", "rain", "t2m")


@query(f"WITH {PANEL_SQL} SELECT site_id, date, coalesce(rain, 0) AS rain FROM filled")
def parallel_json_round_trip(spark, sf_dir):
    """Arrays that belong together by place; missing rain counts as none."""
    sorted_days = F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("d"), "rain")))
    each = filled(spark, sf_dir).groupBy("site_id").agg(sorted_days.alias("x"))
    daily = F.struct(F.struct(F.col("x.d").alias("time"), F.col("x.rain").alias("precipitation_sum")).alias("daily"))
    path = sinks.work_folder(spark, "parallel")
    _files(each.select("site_id", F.to_json(daily, {"ignoreNullFields": "false"}).alias("value")), "site_id", path)
    return readers.read_parallel_json(spark, f"{path}/*/*.txt").select(F.regexp_extract("file", "site_id=([^/]+)/", 1).alias("site_id"), "date", "rain")


@query(
    f"""WITH {PANEL_SQL}, s AS (SELECT unnest(['AF', 'AO', 'NF', 'NO', 'RF', 'RO', 'XX']) AS site_id), c AS (SELECT site_id, count(*) AS n FROM panel GROUP BY site_id)
SELECT CASE site_id WHEN 'AF' THEN 'first' ELSE site_id END AS site_id, coalesce(n, 0) AS n, coalesce(n, 0) < 5 AS not_pulled FROM s LEFT JOIN c USING (site_id)"""
)
def site_folders(spark, sf_dir):
    """A folder a site, one of them under another name; a site without rows is told, and the rest goes on."""
    path = sinks.work_folder(spark, "sites")
    rows = _panel(spark, sf_dir).withColumns({"system:index": F.lit("0_1"), ".geo": F.lit("{}")})
    rows.write.partitionBy("site_id").option("header", True).csv(path)
    names = ["AF", "AO", "NF", "NO", "RF", "RO", "XX"]
    found = readers.read_sites(spark, f"{path}/*/*.csv", "rain", {f"site_id={n}": "first" if n == "AF" else n for n in names})
    every = spark.createDataFrame([("first" if n == "AF" else n,) for n in names], "site_id string")
    none = readers.sources_without_rows(every, found, 5).select("site_id", F.lit(True).alias("not_pulled"))
    counts = found.groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "site_id", "left").join(none, "site_id", "left").select("site_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("not_pulled", F.lit(False)).alias("not_pulled"))


@query(
    "SELECT l_returnflag AS site_id, min(l_quantity) AS elev_min, round(avg(l_quantity), 6) AS elev_mean, max(l_quantity) AS elev_max, min(l_discount) AS slope_min, round(avg(l_discount), 6) AS slope_mean, max(l_discount) AS slope_max FROM lineitem GROUP BY 1"
)
def terrain_schemas(spark, sf_dir):
    """Two files of the same quantities under different names, in one table."""
    parts = [f(c).alias(f"{n}_{s}") for c, n in (("l_quantity", "elev"), ("l_discount", "slope")) for s, f in (("min", F.min), ("mean", lambda x: F.round(F.avg(x), 6)), ("max", F.max))]
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("site")).agg(*parts)
    path = sinks.work_folder(spark, "terrain")
    plain, prefixed = rows.where("site = 'A'"), rows.where("site <> 'A'")
    prefixed = prefixed.withColumnsRenamed({f"{n}_{s}": f"{n}_{n if n == 'slope' else 'elevation'}_{s}" for n in ("elev", "slope") for s in ("min", "mean", "max")})
    for i, part in enumerate((plain, prefixed)):
        part.write.partitionBy("site").option("header", True).csv(f"{path}/{i}")
    found = readers.read_terrain(spark, [f"{path}/{i}/*/*.csv" for i in (0, 1)])
    return found.withColumn("site_id", F.replace("site_id", F.lit("site="), F.lit("")))


@query(
    """SELECT CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 0 END AS "end", o_orderpriority AS hazard_type,
  CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey / 10 END AS subsidence_cm FROM orders WHERE o_orderkey % 7 > 0"""
)
def event_log(spark, sf_dir):
    """A log of events with blank dates, spans of days and numbers that are none."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate").cast("string")
    text = F.when(key % 7 == 0, " ").when(key % 3 == 0, F.concat_ws(" to ", day, F.date_add("o_orderdate", 4).cast("string"))).otherwise(day)
    rows = table(spark, sf_dir, "orders").select(text.alias("event_date"), F.col("o_orderpriority").alias("hazard_type"), F.when(key % 4 > 0, (key / 10).cast("string")).otherwise("unknown").alias("subsidence_cm"))
    path = sinks.work_folder(spark, "events")
    rows.write.option("header", True).csv(path)
    return readers.read_event_log(spark, path)


@query("SELECT count(*) FILTER (WHERE c_custkey % 9 > 0) AS good, count(*) FILTER (WHERE c_custkey % 9 = 0) AS bad, sum(c_custkey) FILTER (WHERE c_custkey % 9 > 0) AS keys FROM customer")
def quarantined_rows(spark, sf_dir):
    """Rows that don't fit the schema are kept aside with their text."""
    key = F.col("c_custkey")
    path = sinks.work_folder(spark, "quarantine")
    table(spark, sf_dir, "customer").select(F.when(key % 9 == 0, F.lit("number")).otherwise(key.cast("string")).alias("c_custkey"), "c_name").write.option("header", True).csv(path)
    good, bad = readers.read_or_quarantine(spark, path, "c_custkey long, c_name string")
    both = good.withColumn("_corrupt_record", F.lit(None).cast("string")).unionByName(bad)
    fits = F.col("_corrupt_record").isNull()
    return both.agg(F.count_if(fits).alias("good"), F.count_if(~fits).alias("bad"), F.sum(F.when(fits, F.col("c_custkey"))).alias("keys"))


@query(f"WITH {PANEL_SQL} SELECT site_id, date, CASE WHEN site_id IN ('AF', 'NO') THEN rain * 2 ELSE rain END AS rain FROM panel")
def landed_partitions(spark, sf_dir):
    """Two sites are landed again; the others stay as they were, and a third run changes nothing."""
    path = sinks.work_folder(spark, "landed")
    rows = panel(spark, sf_dir).select("site_id", "date", "rain")
    sinks.land(rows, path, "site_id")
    again = rows.where("site_id in ('AF', 'NO')").withColumn("rain", F.col("rain") * 2)
    for _ in range(2):
        sinks.land(again, path, "site_id")
    return spark.read.schema("date date, rain double, site_id string").parquet(path).select("site_id", "date", "rain")


@query("SELECT s_suppkey, s_acctbal / 2 AS p, 'r2' AS run_id FROM supplier")
def versioned_runs(spark, sf_dir):
    """Predictions of two runs side by side; the one that finished last is current."""
    path = sinks.work_folder(spark, "runs")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("p"))
    sinks.append_run(rows, path, "r3", "2024-01-01")
    sinks.append_run(rows.withColumn("p", F.col("p") / 2), path, "r2", "2024-02-01")
    return sinks.current_run(spark, path).select("s_suppkey", "p", "run_id")


@query("SELECT s_suppkey, s_acctbal / 2 AS p, 'r2' AS run_id FROM supplier")
def committed_runs(spark, sf_dir):
    """Runs that are committed by a manifest; one that broke off half-way is not read, whatever it has written."""
    path = sinks.work_folder(spark, "committed")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("p"))
    runs.commit_run(rows, path, "r3", "2024-01-01")
    runs.commit_run(rows.where("p > 0"), path, "r2", "2024-02-01")
    runs.commit_run(rows.withColumn("p", F.col("p") / 2), path, "r2", "2024-02-01")
    rows.write.parquet(f"{path}/data/r4-unfinished")
    return runs.current(spark, path).select("s_suppkey", "p", "run_id")


@query(
    f"WITH {PANEL_SQL} SELECT site_id, date, round(rain, 4) AS rain, round(t2m / 3, 9) AS t2m, round(rh2m / 10, 9) AS rh2m, round(ps, 9) AS ps, round(abs(t2m) / 10 * 4.87 / ln(67.8 * 10 - 5.42), 9) AS ws2m FROM panel"
)
def weather_files(spark, sf_dir):
    """Weather files with a preamble, another source's names and units, in one call; each is read in ranges of bytes."""
    line = F.format_string("%s;%.8f;%.13f;%.13f;%.13f;%.13f", F.date_format("date", "yyyy-MM-dd"), F.col("rain") / 25.4, F.col("t2m") / 3 * 9 / 5 + 32, F.col("rh2m") / 10, F.col("ps") * 10, F.abs("t2m") / 10 * 3.6)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("date", line.alias("line")))), lambda x: x["line"])
    head = F.lit("latitude;longitude\n1;2\n\ntime;precipitation_sum (inch);temperature_2m_mean (°F);relative_humidity_2m_mean (%);surface_pressure_mean (hPa);wind_speed_10m_mean (km/h)\n")
    path = sinks.work_folder(spark, "weather")
    _files(panel(spark, sf_dir).groupBy("site_id").agg(F.concat(head, F.concat_ws("\n", lines)).alias("value")), "site_id", path)
    found, _ = readers.read_weather(spark, f"{path}/*/*.txt", range_bytes=100_000)
    site = F.regexp_extract("file", "site_id=([^/]+)/", 1).alias("site_id")
    return found.select(site, "date", F.round("rain", 4).alias("rain"), *(F.round(c, 9).alias(c) for c in ("t2m", "rh2m", "ps", "ws2m")))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value, CASE WHEN event_id % 3 > 0 THEN value END AS nested, CASE WHEN event_id % 5 > 0 THEN value END AS mapped FROM events")
def json_reports(spark, sf_dir):
    """Reports without NaN and infinities at any depth, read back."""
    key, x = F.col("event_id"), F.col("value")
    bad = F.when(key % 3 == 0, F.lit(float("nan"))).otherwise(x)
    rows = table(spark, sf_dir, "events").select("event_id", bad.alias("value"), F.array(F.struct(bad.alias("v"))).alias("list"), F.create_map(F.lit("a"), F.when(key % 5 == 0, F.lit(float("inf"))).otherwise(x)).alias("map"))
    back = F.from_json("report", "event_id long, value double, list array<struct<v: double>>, map map<string, double>")
    return sinks.report(rows).select(back.alias("r")).select("r.event_id", "r.value", F.col("r.list")[0]["v"].alias("nested"), F.col("r.map")["a"].alias("mapped"))


_SUMMARY = "SELECT '{kind}' AS kind, {key} AS site_id, {month} AS month, name, round({low}, 4) AS low, round({high}, 4) AS high FROM m {where}"


@query(
    f"""WITH {EXTREME_SQL}, m AS (SELECT site_id, CAST(month(date) AS INTEGER) AS month, name, value FROM (SELECT site_id, date, 'rain' AS name, rain AS value FROM flagged UNION ALL SELECT site_id, date, 'ps', ps FROM flagged) WHERE value IS NOT NULL)
{_SUMMARY.format(kind="base", key="site_id", month="month", low="median(value)", high="median(value)", where="GROUP BY site_id, month, name")} UNION ALL
{_SUMMARY.format(kind="range", key="NULL", month="NULL", low="quantile_cont(value, 0.005)", high="quantile_cont(value, 0.995)", where="GROUP BY name")} UNION ALL
{_SUMMARY.format(kind="experience", key="NULL", month="NULL", low="quantile_cont(value, 0.001)", high="quantile_cont(value, 0.999)", where="GROUP BY name")} UNION ALL
{_SUMMARY.format(kind="reference", key="NULL", month="NULL", low="median(value)", high="median(value)", where="GROUP BY name")} UNION ALL
SELECT 'constant', site_id, NULL, 'threshold', round(min(threshold), 1), round(min(threshold), 1) FROM flagged GROUP BY site_id"""
)
def serving_summary(spark, sf_dir):
    return rounded(sinks.serving_summary(labelled(spark, sf_dir), ["rain", "ps"], ["rain", "ps"]))


@query(
    f"""WITH {PANEL_SQL}, w AS (SELECT *, ln(greatest(rh2m / 10, 1) / 100) + 17.62 * t2m / 3 / (243.12 + t2m / 3) AS g FROM panel)
SELECT site_id, date, round(rain, 6) AS rain, round(t2m / 3, 8) AS t2m, round(rh2m / 10, 6) AS rh2m, round((ps + 60) * exp(-500 / 8434.0), 6) AS ps, round(abs(t2m) / 10 * 4.87 / ln(67.8 * 10 - 5.42), 6) AS ws2m, round(243.12 * g / (17.62 - g), 8) AS t2mdew FROM w"""
)
def foreign_weather(spark, sf_dir):
    """A table in another source's names and units (inches, Fahrenheit, shares, sea-level hectopascals, km/h at 10 m)."""
    rows = panel(spark, sf_dir).select(
        "site_id",
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("Time stamp"),
        (F.col("rain") / 25.4).alias("precipitation_sum (inch)"),
        (F.col("t2m") / 3 * 9 / 5 + 32).alias("temperature_2m_mean (°F)"),
        F.lit(0.0).alias("temperature_2m_max (°F)"),
        (F.col("rh2m") / 1000).alias("relative_humidity_2m_mean"),
        ((F.col("ps") + 60) * 10).alias("pressure_msl_mean (hPa)"),
        (F.abs("t2m") / 10 * 3.6).alias("wind_speed_10m_mean (km/h)"),
    )
    found, _ = readers.normalise_weather(rows, 500.0)
    return found.select("site_id", "date", *(F.round(c, 8 if c in ("t2m", "t2mdew") else 6).alias(c) for c in ("rain", "t2m", "rh2m", "ps", "ws2m", "t2mdew")))


_W = "OVER (PARTITION BY site_id ORDER BY date ROWS {} PRECEDING)"
_SUM = "CASE WHEN count(rain) {w} = {d} THEN sum(rain) {w} END"


@query(
    f"""WITH {PANEL_SQL}, s AS (SELECT *, {", ".join(f"{_SUM.format(w=_W.format(d - 1), d=d)} AS rain_{d}d" for d in (3, 7, 14, 30))},
  CASE WHEN count(*) {_W.format(6)} = 7 THEN sum(CASE WHEN rain > 1 THEN 1 ELSE 0 END) {_W.format(6)} END AS wet, CASE WHEN count(ps) {_W.format(29)} >= 20 THEN ps - avg(ps) {_W.format(29)} END AS anom,
  lag(ps, 1) OVER w AS ps1, lag(ps, 3) OVER w AS ps3, lag(rh2m, 3) OVER w AS rh3 FROM filled WINDOW w AS (PARTITION BY site_id ORDER BY date))
SELECT site_id, date, rain AS rain_1d, rain_3d, rain_7d, rain_14d, rain_30d, CAST(wet AS BIGINT) AS wet_days_7d, rain_3d - (rain_7d - rain_3d) * 3 / 4 AS rain_accel, round(t2m, 10) AS t2m, round(rh2m, 10) AS rh2m, round(t2m / 9, 10) AS ws2m,
  round(t2m - t2m / 2, 10) AS dew_spread, round(ps, 10) AS ps_kpa, round(anom, 10) + 0 AS ps_anom, round(ps - ps1, 10) + 0 AS ps_chg_1d, round(ps - ps3, 10) + 0 AS ps_chg_3d, round(rh2m - rh3, 10) + 0 AS rh_chg_3d,
  round(sin(dayofyear(date) * (2 * pi() / 365.25)), 10) AS doy_sin, round(cos(dayofyear(date) * (2 * pi() / 365.25)), 10) AS doy_cos FROM s"""
)
def weather_features(spark, sf_dir):
    """The whole feature table of the forecast, rain acceleration included."""
    rows = filled(spark, sf_dir).withColumns({"ws2m": F.col("t2m") / 9, "t2mdew": F.col("t2m") / 2})
    return rounded(series.weather_features(rows), 10)


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 1")
def held_out_rows(spark, sf_dir):
    """A test part exported with and without its answers; both hold the same rows."""
    path = sinks.work_folder(spark, "held-out")
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 1").select("o_orderkey", "o_totalprice")
    sinks.held_out(rows, path, ["o_totalprice"])
    asked, answers = (spark.read.parquet(f"{path}/{n}") for n in ("without_answers", "with_answers"))
    return asked.join(answers, "o_orderkey")


@query("SELECT o_orderkey, round(o_totalprice, 2) AS p FROM orders")
def flat_predictions(spark, sf_dir):
    """Predictions as CSV, without the nested projection they carry."""
    path = sinks.work_folder(spark, "flat")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("p"), F.array("o_totalprice").alias("projection"))
    sinks.write_csv(rows, path, rows.columns)
    return readers.read_csv(spark, path, "o_orderkey long, p double").drop("_corrupt_record").select("o_orderkey", scalars.finite(F.col("p")).alias("p"))
