"""Runs committed whole: files are written aside, one rename of a manifest makes them readable.

A run that breaks off leaves files that no manifest names, so no reader meets them. A manifest lists the files of a run
with their lengths; files that are gone or shorter since are told by ``damaged_files``, so that they are fetched again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILES = "run_id string, finished string, folder string, schema string, files array<struct<name string, bytes long>>"


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def commit_run(df: DataFrame, path: str, run_id: str, finished: str) -> None:
    """Write ``df`` as the run ``run_id``; a run of that id that was committed before is replaced at once, or not at all."""
    spark = df.sparkSession
    folder = f"data/{run_id}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    system, where = _system(spark, f"{path}/{folder}")
    files = [{"name": s.getPath().getName(), "bytes": s.getLen()} for s in system.listStatus(where) if s.getPath().getName().startswith("part-")]
    manifest = {"run_id": run_id, "finished": finished, "folder": folder, "schema": df.schema.json(), "files": files}
    _put(spark, f"{path}/manifests", f"{run_id}.json", json.dumps(manifest))


def _put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """A file that is there whole or not at all."""
    system, where = _system(spark, folder)
    system.mkdirs(where)
    aside, final = (spark._jvm.org.apache.hadoop.fs.Path(where, n) for n in (f"_{name}.{uuid.uuid4().hex}", name))
    out = system.create(aside, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(aside, final, options)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each committed run."""
    system, where = _system(spark, f"{path}/manifests")
    if not system.exists(where):
        return spark.createDataFrame([], _FILES)
    return spark.read.schema(_FILES).json(f"{path}/manifests")


def read_runs(spark: SparkSession, path: str, runs: DataFrame | None = None) -> DataFrame | None:
    """The rows of the committed runs (or of those of ``runs``, rows of ``manifests``) with ``run_id`` and ``finished``; None without any."""
    chosen = (manifests(spark, path) if runs is None else runs).collect()  # one row a run
    out = None
    for r in sorted(chosen, key=lambda r: r.run_id):
        stamped = spark.read.schema(_schema(r.schema)).parquet(f"{path}/{r.folder}").withColumns({"run_id": F.lit(r.run_id), "finished": F.lit(r.finished).cast("timestamp")})
        out = stamped if out is None else out.unionByName(stamped, allowMissingColumns=True)
    return out


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the committed run that finished last."""
    last = manifests(spark, path).orderBy(F.col("finished").cast("timestamp").desc(), F.desc("run_id")).limit(1)
    return read_runs(spark, path, last)


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """run_id, file, ``bytes`` written and ``there`` (null: gone) of the committed files that are not as they were written."""
    named = manifests(spark, path).select("run_id", "folder", F.explode("files").alias("f"))
    named = named.select("run_id", F.concat_ws("/", "folder", "f.name").alias("file"), F.col("f.bytes").alias("bytes"))
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{path}/data")
    there = there.select(F.regexp_extract("path", r"(data/[^/]+/[^/]+)$", 1).alias("file"), F.col("length").alias("there"))
    return named.join(there, "file", "left").where(F.col("there").isNull() | (F.col("there") != F.col("bytes"))).select("run_id", "file", "bytes", "there")


def clear_uncommitted(spark: SparkSession, path: str) -> int:
    """Delete folders that no manifest names, of runs that broke off or were replaced; how many there were. Not while a run is written."""
    kept = {r.folder for r in manifests(spark, path).select("folder").collect()}
    system, where = _system(spark, f"{path}/data")
    gone = [s.getPath() for s in system.listStatus(where) if f"data/{s.getPath().getName()}" not in kept] if system.exists(where) else []
    for folder in gone:
        system.delete(folder, True)
    return len(gone)
