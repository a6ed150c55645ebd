"""Tolerant readers: files in, typed tables out; what can't be read goes to a quarantine, not into an error."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import chain, pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import scalars
from panelforge.sources import lines

DELIMITERS = (",", ";", "\t")
#: Lines of a file among which its header is looked for.
PREAMBLE_LINES = 200

# The daily quantities of a weather table and their physical ranges.
WEATHER = {"rain": (0.0, 2000.0), "t2m": (-60.0, 60.0), "rh2m": (0.0, 100.0), "ps": (40.0, 110.0), "ws2m": (0.0, 80.0), "t2mdew": (-80.0, 45.0)}
POWER_NAMES = {"PRECTOTCORR": "rain", "T2M": "t2m", "RH2M": "rh2m", "PS": "ps", "WS2M": "ws2m", "T2MDEW": "t2mdew"}


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon and tab in the first line; comma on a tie."""
    first = spark.read.text(path).limit(1)
    counts = first.select(*(F.length("value") - F.length(F.replace("value", F.lit(d))) for d in DELIMITERS)).first()
    return DELIMITERS[max(range(len(DELIMITERS)), key=lambda i: counts[i])] if counts else ","


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header, of two columns at least; names are trimmed, and a bad row keeps its text in ``_corrupt_record``."""
    reader = spark.read.option("header", True).option("sep", sniff_delimiter(spark, path)).option("mode", "PERMISSIVE")
    if schema and "_corrupt_record" not in schema:
        schema = f"{schema}, _corrupt_record string"
    df = (reader.schema(schema) if schema else reader).csv(path)
    if len([c for c in df.columns if c != "_corrupt_record"]) < 2:
        raise ValueError(f"{path}: a table needs two columns at least")
    return df.toDF(*(c.strip().lstrip("\ufeff") for c in df.columns))


def read_or_quarantine(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose cells fit the schema, and the others: what fits of them, and all their cells in ``_corrupt_record``.

    Columns are found by their trimmed names; one that the file lacks is an error.
    """
    wanted = T.StructType.fromDDL(schema)
    raw = read_csv(spark, path)
    lacking = [f.name for f in wanted if f.name not in raw.columns]
    if lacking:
        raise ValueError(f"{path}: no column {', '.join(lacking)}")
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in wanted}
    bad = F.lit(False)
    for name, x in typed.items():
        bad = bad | (F.col(f"`{name}`").isNotNull() & x.isNull())
    cells = F.when(bad, F.concat_ws(",", *(F.col(f"`{f.name}`") for f in wanted))).alias("_corrupt_record")
    good, rest = quarantine(raw.select(*(x.alias(n) for n, x in typed.items()), cells), F.col("_corrupt_record").isNotNull())
    return good.drop("_corrupt_record"), rest


def quarantine(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that pass and those that don't."""
    flag = F.coalesce(bad, F.lit(False))
    return df.where(~flag), df.where(flag)


def read_with_preamble(spark: SparkSession, path: str, header: str = r"^\s*\"?(date|time|year)\b", range_bytes: int = lines.RANGE_BYTES) -> DataFrame:
    """Lines of tables whose header follows some lines of metadata: file, cells (by name), one row each.

    The header is the first line, of the first ``PREAMBLE_LINES``, that ``header`` finds in its lower case; each file is
    found by its own. Files are read in ranges of bytes, so one of any size is spread over tasks.
    """
    found = lines.lines_below_header(spark, path, header, PREAMBLE_LINES, range_bytes)
    sep = _separator(F.col("header"))
    names = F.transform(_cells(F.col("header"), sep), F.lower)
    return found.select("file", F.map_from_arrays(names, F.slice(_cells(F.col("line"), sep), 1, F.size(names))).alias("cells"))


def _separator(top: Column) -> Column:
    """The most frequent of semicolon, tab and comma in a header."""
    count = lambda d: F.length(top) - F.length(F.replace(top, F.lit(d)))
    return F.when((count(";") > count(",")) & (count(";") >= count("\t")), ";").when(count("\t") > count(","), "\t").otherwise(",")


def _cells(line: Column, sep: Column) -> Column:
    return F.transform(F.split(line, sep), lambda x: F.trim(F.trim(x), F.lit('"')))


def read_weather(spark: SparkSession, path: str, elevation_m: float | None = None, header: str = r"^\s*\"?(date|time|year)\b", range_bytes: int = lines.RANGE_BYTES, most: int = 100) -> tuple[DataFrame, list[str]]:
    """Weather files of any source, preamble, names and units and all: file, date and the quantities, and notes.

    Files of the same header are a table with units of its own; more than ``most`` different headers are an error. Dates
    may be in one column, or in year with day of the year or month and day.
    """
    found = lines.lines_below_header(spark, path, header, PREAMBLE_LINES, range_bytes)
    tops = [r.header for r in found.select("header").distinct().orderBy("header").limit(most + 1).collect()]
    if not tops or len(tops) > most:
        raise ValueError(f"{path}: {'no table with a header' if not tops else f'more than {most} headers'}")
    out, notes = None, []
    for top in tops:
        sep = F.lit(max((";", "\t", ","), key=top.count))
        names = [c.strip().strip('"') for c in top.split(max((";", "\t", ","), key=top.count))]
        cells = found.where(F.col("header") == top).select("file", _cells(F.col("line"), sep).alias("c"))
        table = cells.select("file", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate(names)))
        if "date" not in find_quantities(names):
            by_name = F.map_from_arrays(F.lit([n.lower() for n in names]), F.array(*(F.col(f"`{n}`") for n in names)))
            table = table.withColumn("date", date_of(by_name).cast("string"))
        part, said = normalise_weather(table, elevation_m)
        part = part.select("file", "date", *WANTED)
        out, notes = part if out is None else out.unionByName(part), notes + [n for n in said if n not in notes]
    return out, notes


def date_of(cells: Column) -> Column:
    """The date of a row of cells: a date or time, year and day of the year, or year, month and day."""
    get = lambda name: F.try_element_at(cells, F.lit(name))
    number = lambda name: get(name).try_cast("int")
    return F.coalesce(
        F.try_to_date(F.left(F.coalesce(get("date"), get("time")), F.lit(10))),
        scalars.from_day_of_year(number("year"), number("doy")),
        F.make_date(number("year"), number("mo"), F.coalesce(number("dy"), F.lit(1))),
    )


def quantity(cells: Column, name: str, unit: str, to: str) -> Column:
    """A number from a row of cells, in the wanted unit; sentinels and blanks are null."""
    return scalars.convert(scalars.missing_to_null(F.try_element_at(cells, F.lit(name)).try_cast("double")), unit, to)


def read_power_json(spark: SparkSession, path: str) -> DataFrame:
    """Daily rows of landed files of the shape {properties: {parameter: {name: {yyyymmdd: value}}}}."""
    schema = "properties struct<parameter: map<string, map<string, double>>>"
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("j"))
    each = parsed.select("file", F.explode("j.properties.parameter").alias("name", "days")).select("file", "name", F.explode("days").alias("day", "value"))
    each = each.select("file", "name", F.try_to_date("day", "yyyyMMdd").alias("date"), scalars.missing_to_null(F.col("value")).alias("value"))
    wide = each.groupBy("file", "date").pivot("name", list(POWER_NAMES)).agg(F.first("value", ignorenulls=True))
    return wide.withColumnsRenamed(POWER_NAMES)


def read_parallel_json(spark: SparkSession, path: str) -> DataFrame:
    """Daily rain of landed files of the shape {daily: {time: [...], precipitation_sum: [...]}}; null counts as 0."""
    schema = "daily struct<time: array<string>, precipitation_sum: array<double>>"
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("j"))
    each = parsed.select("file", F.explode(F.arrays_zip("j.daily.time", "j.daily.precipitation_sum")).alias("x"))
    return each.select("file", F.try_to_date("x.time").alias("date"), F.coalesce("x.precipitation_sum", F.lit(0.0)).alias("rain"))


def read_sites(spark: SparkSession, pattern: str, value: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Series of a folder a site (…/<site>/file.csv): site_id from the path, renamed by ``aliases``; transport columns go."""
    df = spark.read.option("header", True).csv(pattern)
    site = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    if aliases:
        site = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in aliases.items() for x in p)), site), site)
    return df.select(site.alias("site_id"), F.try_to_date("date").alias("date"), scalars.missing_to_null(F.col(value).try_cast("double")).alias(value))


def read_terrain(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Terrain summaries of either naming, in one schema."""
    out = None
    for path in paths:
        df = spark.read.option("header", True).csv(path)
        site = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("site_id")
        columns = [F.coalesce(*(F.col(f"`{c}`").try_cast("double") for c in (f"{k}_{s}", f"{p}_{k}_{s}") if c in df.columns)).alias(f"{k}_{s}") for k, p in (("elev", "elev"), ("slope", "slope")) for s in ("min", "mean", "max") if {f"{k}_{s}", f"{p}_{k}_{s}"} & set(df.columns)]
        if "elev_elevation_mean" in df.columns:
            columns += [F.col(f"elev_elevation_{s}").try_cast("double").alias(f"elev_{s}") for s in ("min", "mean", "max")]
        part = df.select(site, *columns)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events with a start and an end; rows without a date are left out."""
    df = spark.read.option("header", True).csv(path).where(F.trim("event_date") != "")
    at = scalars.date_range(F.col("event_date"))
    return df.select(at["start"].alias("start"), at["end"].alias("end"), "hazard_type", F.col("subsidence_cm").try_cast("double").alias("subsidence_cm"))


def sources_without_rows(sites: DataFrame, rows: DataFrame, least: int = 1, key: str = "site_id") -> DataFrame:
    """Sites with under ``least`` rows, and how many: to be reported as not pulled while the rest goes on."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sites.select(key).join(counts, key, "left").fillna(0, ["n"]).where(F.col("n") < least)


def complete_files(spark: SparkSession, path: str, least_bytes: int = 1000) -> DataFrame:
    """Landed files and whether they are large enough not to be fetched again."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.withColumn("complete", F.col("length") >= least_bytes)


# Weather tables of any origin: columns found by the words of their names, units by what the names declare.

# Words that name a quantity, words that rule a column out, words that make it the better one.
NAMED = {
    "date": ({"date", "time", "datetime", "day", "timestamp", "dt"}, set(), set()),
    "rain": ({"rain", "rainfall", "precip", "precipitation", "prcp", "prectotcorr", "ppt", "precipitationcal"}, {"hours", "probability", "prob", "snow", "snowfall", "showers", "intensity", "max", "flag"}, {"sum", "total", "precipitation"}),
    "t2m": ({"t2m", "temp", "temperature", "tavg", "tmean", "tas"}, {"dew", "dewpoint", "max", "min", "apparent", "soil", "feels", "wet", "bulb", "tmax", "tmin"}, {"mean", "avg"}),
    "rh2m": ({"rh", "rh2m", "humidity", "relativehumidity", "hurs"}, {"specific", "max", "min", "soil"}, {"mean", "avg"}),
    "ps": ({"ps", "pressure", "press", "pres", "slp", "msl", "mslp"}, {"vapour", "vapor", "max", "min", "tendency"}, {"surface", "mean"}),
    "ws2m": ({"ws", "ws2m", "ws10m", "wind", "windspeed", "wspd", "sfcwind"}, {"gust", "gusts", "direction", "dir", "max", "min"}, {"mean", "avg", "2m"}),
    "t2mdew": ({"t2mdew", "dew", "dewpoint", "tdew", "td"}, {"max", "min", "depression"}, {"mean", "avg"}),
}
# Words that declare a unit.
UNIT_OF_WORD = {
    "km/h": "km/h", "kmh": "km/h", "kph": "km/h", "kmph": "km/h", "mph": "mph", "kn": "kn", "kt": "kn", "kts": "kn", "knots": "kn", "knot": "kn",
    "f": "degF", "degf": "degF", "fahrenheit": "degF", "k": "K", "kelvin": "K", "in": "in", "inch": "in", "inches": "in", "cm": "cm",
    "hpa": "hPa", "mb": "hPa", "mbar": "hPa", "millibar": "hPa", "pa": "Pa", "kpa": "kPa", "inhg": "inHg",
}
WANTED = {"rain": "mm", "t2m": "degC", "t2mdew": "degC", "rh2m": "%", "ps": "kPa", "ws2m": "m/s"}
# The unit of a quantity whose name declares none, by the median above which it must be that one.
MEDIAN_UNITS = {"t2m": [(200.0, "K"), (60.0, "degF")], "t2mdew": [(200.0, "K"), (60.0, "degF")], "ps": [(20_000.0, "Pa"), (200.0, "hPa")]}


_PART = re.compile(r"[(\[](?P<inside>[^)\]]+)[)\]]|(?P<word>[a-z0-9%]+)")


def name_parts(name: str) -> dict[str, list[str]]:
    """The parts of a column's name in their order: ``word`` outside brackets, ``inside`` what brackets hold, without blanks and degree signs."""
    parts: dict[str, list[str]] = {"word": [], "inside": []}
    for found in _PART.finditer(name.lower()):
        parts[found.lastgroup].append(re.sub(r"[\s\u00b0]", "", found[found.lastgroup]))
    return parts


def name_words(name: str) -> set[str]:
    """Its words, and each two neighbours run together."""
    words = name_parts(name)["word"]
    return set(words).union(map("".join, pairwise(words)))


def declared_unit(name: str) -> str | None:
    """What the brackets say, else the first word, or pair of words, that is a unit."""
    parts = name_parts(name)
    words = parts["word"]
    for candidate in chain(parts["inside"], words, map("".join, pairwise(words))):
        if candidate in UNIT_OF_WORD:
            return UNIT_OF_WORD[candidate]
    return None


def find_quantities(names: Sequence[str]) -> dict[str, str]:
    """Quantity -> column: the one with the most preferred words (two more for the quantity's own name), ties to the first."""
    found: dict[str, str] = {}
    for quantity, (needed, avoided, preferred) in NAMED.items():
        fits = [(n, name_words(n)) for n in names if n not in found.values()]
        ranked = [(len(w & preferred) + 2 * (n.strip().lower() == quantity), -i, n) for i, (n, w) in enumerate(fits) if w & needed and not w & avoided]
        if ranked:
            found[quantity] = max(ranked)[2]
    return found


def normalise_weather(df: DataFrame, elevation_m: Column | float | None = None) -> tuple[DataFrame, list[str]]:
    """A weather table in the library's names and units, and notes on what was changed.

    Numbers at or below -900 are missing. Units are those the names declare, else inferred from a column's median
    (approximate, in bounded memory). Wind of 10 m is brought to 2 m, sea-level pressure to the surface if the
    elevation is given, a missing dew point follows from temperature and humidity. Other columns are kept.
    """
    found, notes = find_quantities(df.columns), []
    lacking = [q for q in ("date", "rain", "t2m", "rh2m", "ps", "ws2m") if q not in found]
    if lacking:
        raise ValueError(f"no column for {', '.join(lacking)}")
    numbers = {q: scalars.missing_to_null(F.col(f"`{c}`").cast("string").try_cast("double")) for q, c in found.items() if q != "date"}
    silent = [q for q in numbers if declared_unit(found[q]) is None]
    middle = df.agg(*(F.percentile_approx(numbers[q], 0.5).alias(q) for q in silent), F.max(numbers["rh2m"]).alias("__wettest")).first()
    for q, x in numbers.items():
        unit = declared_unit(found[q])
        if unit is None:
            unit = next((u for above, u in MEDIAN_UNITS.get(q, []) if middle[q] is not None and middle[q] > above), WANTED[q])
        if q == "rh2m":
            unit = "fraction" if middle["__wettest"] is not None and middle["__wettest"] <= 1 else "%"
        if (unit, WANTED[q]) in scalars.UNITS:
            numbers[q] = scalars.convert(x, unit, WANTED[q])
            notes.append(f"{q}: from {unit} to {WANTED[q]}")
    if name_words(found["ws2m"]) & {"10m", "ws10m", "10"}:
        numbers["ws2m"] = scalars.wind_at_2m(numbers["ws2m"])
        notes.append("ws2m: from 10 m to 2 m")
    if name_words(found["ps"]) & {"msl", "slp", "mslp", "sea"} and elevation_m is not None:
        numbers["ps"] = scalars.surface_pressure(numbers["ps"], elevation_m if isinstance(elevation_m, Column) else F.lit(elevation_m))
        notes.append("ps: from sea level to the surface")
    if "t2mdew" not in numbers:
        numbers["t2mdew"] = scalars.dew_point(numbers["t2m"], numbers["rh2m"])
        notes.append("t2mdew: from temperature and humidity")
    date = F.to_date(F.try_to_timestamp(F.col(f"`{found['date']}`").cast("string"))).alias("date")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in found.values() and c not in NAMED]
    return df.select(*kept, date, *(numbers[q].alias(q) for q in WANTED)), notes
