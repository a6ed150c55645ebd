"""Sinks: fixed-order tables, nested reports, versioned runs and snapshots."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions import scalars


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``; only a local master may do without that setting."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-landing-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once however often it is read, and kept if an executor is lost."""
    path = work_folder(df.sparkSession, tag)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of ``written`` that are still there.
_written: list[str] = []


def clear_written(spark: SparkSession) -> int:
    """Delete the tables that ``written`` has made for this driver; what is built on them can't be read any more."""
    gone = 0
    while _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return gone


def write_csv(df: DataFrame, path: str, order: Sequence[str], sep: str = ",") -> None:
    """The columns in this order, missing values blank; nested columns are left out."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [c for c in order if not isinstance(df.schema[c].dataType, nested)]
    df.select(*flat).write.mode("overwrite").option("header", True).option("nullValue", "").option("sep", sep).csv(path)


def finite(x: Column, kind: T.DataType) -> Column:
    """NaN and infinities as null, at any depth of arrays, maps' values and structs."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return scalars.finite(x)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: finite(e, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, e: finite(e, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(finite(x[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return x


def report(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, NaN and infinities as null."""
    clean = df.select(*(finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
    return clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


def land(df: DataFrame, path: str, partition: str) -> None:
    """Replace just the partitions that ``df`` holds; a rerun gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_run(df: DataFrame, path: str, run_id: str, finished: str) -> None:
    """Add the predictions of one run, kept beside earlier ones."""
    stamped = df.withColumns({"run_id": F.lit(run_id), "finished": F.lit(finished).cast("timestamp")})
    land(stamped, path, "run_id")


def current_run(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the run that finished last."""
    runs = spark.read.parquet(path)
    latest = runs.agg(F.max_by("run_id", F.struct("finished", "run_id")).alias("run_id"))
    return runs.join(F.broadcast(latest), "run_id")


def held_out(df: DataFrame, path: str, answers: Sequence[str]) -> None:
    """A test split twice: as it is, and without the answers."""
    df.write.mode("overwrite").parquet(f"{path}/with_answers")
    df.drop(*answers).write.mode("overwrite").parquet(f"{path}/without_answers")


def save_model(model, path: str, features: Sequence[str], threshold: float, modes: Sequence[str] = ()) -> None:
    """A fitted pipeline and a one-row table of what scoring with it needs."""
    model.write().overwrite().save(f"{path}/model")
    row = [(list(features), float(threshold), list(modes))]
    SparkSession.active().createDataFrame(row, "features array<string>, threshold double, modes array<string>").write.mode("overwrite").parquet(f"{path}/about")


def load_model(spark: SparkSession, path: str):
    """The pipeline and its row of features, threshold and modes."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/about").first()


def serving_summary(rows: DataFrame, medians: Sequence[str], ranges: Sequence[str], key: str = "site_id", date: str = "date", constant: str = "threshold") -> DataFrame:
    """What a server needs of a feature table, as (kind, key, month, name, low, high).

    kind ``base``: medians by key and month; ``range`` and ``experience``: the inner 99 and 99.8 per cent of a column;
    ``constant``: a key's one value; ``reference``: the overall median.
    """
    from panelforge.operators import metrics

    melted = rows.select(key, F.month(date).alias("month"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in dict.fromkeys([*medians, *ranges])))).alias("x")).select(key, "month", "x.*")
    none, no_month = F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(None).cast("int").alias("month")

    def part(kind: str, points: list[float], names: Sequence[str], keys: Sequence[str]) -> DataFrame:
        found = metrics.quantiles(melted.where(F.col("name").isin(*names)), "value", points, [*keys, "name"])
        return found.select(F.lit(kind).alias("kind"), F.col(key) if keys else none, F.col("month") if keys else no_month, "name", F.col("q")[0].alias("low"), F.col("q")[len(points) - 1].alias("high"))

    constants = rows.groupBy(key).agg(F.round(F.min(constant), 1).cast("double").alias("low"))
    constants = constants.select(F.lit("constant").alias("kind"), key, no_month, F.lit(constant).alias("name"), "low", F.col("low").alias("high"))
    out = part("base", [0.5], medians, [key, "month"]).unionByName(part("range", [0.005, 0.995], ranges, [])).unionByName(part("experience", [0.001, 0.999], ranges, []))
    return out.unionByName(part("reference", [0.5], medians, [])).unionByName(constants)
