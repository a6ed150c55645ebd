"""Large files in ranges of bytes, weather files whole, and runs that are committed or not there."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelforge.sources import lines, readers, runs, sinks

HEAD = "-BEGIN HEADER-\nsource;station\n\n-END HEADER-\n"


def big_file(path, n, end="\n", last=True):
    rng = random.Random(n)
    rows = [f"2020;{i};{'x' * rng.randrange(40)}é{i}" for i in range(n)]
    text = HEAD + "YEAR;DOY;Note" + end + end.join(rows) + (end if last else "")
    path.write_bytes(("\ufeff" + text).encode())
    return rows


@pytest.mark.parametrize(("end", "last"), [("\n", True), ("\r\n", False)])
@pytest.mark.parametrize("size", [1, 37, 1000, 10**7])
def test_one_file_in_any_ranges_gives_the_same_lines(spark, tmp_path, end, last, size):
    rows = big_file(tmp_path / "a.txt", 40 if size == 1 else 900, end, last)
    found = lines.lines_below_header(spark, f"{tmp_path}/*.txt", "^year", range_bytes=size, tasks=8)
    assert found.rdd.getNumPartitions() == 8
    got = found.collect()
    assert sorted(r.line for r in got) == sorted(rows) and {r.header for r in got} <= {"YEAR;DOY;Note"}
    if size in (37, 1000):
        spread = found.groupBy(F.spark_partition_id()).count().count()
        assert spread > 4


def test_chunks_shorter_than_lines(spark, tmp_path, monkeypatch):
    rows = big_file(tmp_path / "a.txt", 50)
    monkeypatch.setattr(lines, "CHUNK", 7)
    with open(tmp_path / "a.txt", "rb") as f:
        size = len(f.read())
    source = lines.fs.LocalFileSystem().open_input_file(str(tmp_path / "a.txt"))
    top, start = lines._header(source, lines.re.compile("^year"), 200)
    got = [x for a in range(0, size, 100) for x in lines._lines(source, max(a, start), a > start, min(a + 100, size))]
    assert got == rows and top == "YEAR;DOY;Note"


def test_files_without_header_or_content(spark, tmp_path):
    (tmp_path / "none.txt").write_text("a\nb\n")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "only.txt").write_text("date,rain")
    (tmp_path / "late.txt").write_text("x\n" * 200 + "date,rain\n1,2\n")
    assert lines.lines_below_header(spark, f"{tmp_path}/*.txt", "^date").count() == 0


def test_weather_files_of_several_sources(spark, tmp_path):
    (tmp_path / "power.csv").write_text("-BEGIN HEADER-\nx\n-END HEADER-\nYEAR,DOY,PRECTOTCORR,T2M,RH2M,PS,WS2M,T2MDEW\n2020,32,5.5,20.0,80,95.0,2.0,16.0\n2020,33,-999,21.0,81,95.5,2.5,17.0\n")
    (tmp_path / "us.csv").write_text('latitude;longitude\n1;2\n\n"time";rain_sum (inch);temperature_2m_mean (°F);relative_humidity_2m_mean (%);surface_pressure_mean (kPa);wind_speed_10m_mean (km/h)\n2020-02-01;1;68;50;95;18\n')
    found, notes = readers.read_weather(spark, f"{tmp_path}/*.csv", range_bytes=40)
    rows = {(r.file.rsplit("/", 1)[1], str(r.date)): r for r in found.collect()}
    assert set(rows) == {("power.csv", "2020-02-01"), ("power.csv", "2020-02-02"), ("us.csv", "2020-02-01")}
    assert rows["power.csv", "2020-02-02"].rain is None and rows["power.csv", "2020-02-01"].t2mdew == 16.0
    us = rows["us.csv", "2020-02-01"]
    assert us.rain == pytest.approx(25.4) and us.t2m == pytest.approx(20) and us.ps == 95.0 and us.ws2m == pytest.approx(5 * 4.87 / math.log(67.8 * 10 - 5.42))
    assert any("inch" in n or "from in" in n for n in notes)
    with pytest.raises(ValueError, match="no table"):
        readers.read_weather(spark, f"{tmp_path}/*.csv", header="^nothing")
    with pytest.raises(ValueError, match="more than 1 headers"):
        readers.read_weather(spark, f"{tmp_path}/*.csv", most=1)


# Runs.


def test_a_run_is_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    assert runs.read_runs(spark, path) is None and runs.current(spark, path) is None
    runs.commit_run(spark.range(5).withColumn("p", F.lit(0.1)), path, "r1", "2024-01-01 00:00:00")
    half = spark.range(0, 100, 1, 8).withColumn("p", F.when(F.col("id") < 90, 0.2).otherwise(F.raise_error(F.lit("broken half-way")).cast("double")))
    for run_id in ("r2", "r1"):  # a new one, and one in the place of a committed one
        with pytest.raises(Exception, match="broken half-way"):
            runs.commit_run(half, path, run_id, "2024-01-02 00:00:00")
        assert sorted(r.id for r in runs.read_runs(spark, path).collect()) == list(range(5))
    # Files without a manifest, and a manifest not yet renamed, are no run.
    half.where("id < 50").write.parquet(f"{path}/data/r3-aside")
    (tmp_path / "runs/manifests/_r3.json.x").write_text('{"run_id": "r3"}')
    assert {r.run_id for r in runs.manifests(spark, path).collect()} == {"r1"}
    assert runs.clear_uncommitted(spark, path) >= 1 and runs.current(spark, path).count() == 5
    runs.commit_run(spark.range(3), path, "r2", "2024-01-03 00:00:00")
    runs.commit_run(spark.range(7).withColumn("p", F.lit(0.3)), path, "r1", "2024-01-02 00:00:00")
    assert [r.id for r in runs.current(spark, path).orderBy("id").collect()] == [0, 1, 2]
    assert {(r.run_id, r["count"]) for r in runs.read_runs(spark, path).groupBy("run_id").count().collect()} == {("r1", 7), ("r2", 3)}


def test_damaged_files_are_told(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    runs.commit_run(spark.range(0, 100, 1, 3), path, "r1", "2024-01-01 00:00:00")
    assert runs.damaged_files(spark, path).count() == 0
    parts = sorted((tmp_path / "runs/data").glob("*/part-*"))
    parts[0].write_bytes(parts[0].read_bytes()[:-10])
    parts[1].unlink()
    found = {r.file.rsplit("/", 1)[1]: (r.bytes, r.there) for r in runs.damaged_files(spark, path).collect()}
    assert set(found) == {parts[0].name, parts[1].name} and found[parts[1].name][1] is None and found[parts[0].name][1] == found[parts[0].name][0] - 10


def test_written_tables_are_read_again_and_cleared(spark):
    drawn = sinks.written(spark.range(50).withColumn("x", F.rand()), "drawn")
    assert drawn.collect() == drawn.collect() and drawn.count() == 50
    assert sinks.clear_written(spark) >= 1 and sinks.clear_written(spark) == 0
