"""What the operators of this package share: work folders, folds and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that splits words in every operator here, as a Java, Python and RE2 class.
SPACE = r"\x20\x09-\x0D"
_run_folder: ContextVar[str | None] = ContextVar("run_folder", default=None)


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder for intermediate tables below the shared ``spark.checkpoint.dir``.

    Where the session names no such folder, a local master gets a temporary one; a cluster gets an error,
    since a folder of one machine would hold a part of each table only.
    """
    context = spark.sparkContext
    base = _run_folder.get() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """One folder for all intermediate tables that are made inside the block; it goes with them at its end.

    Results must be written before the block ends, since they read these tables.
    """
    folder = work_dir(spark, "run")
    before = _run_folder.set(folder)
    try:
        yield folder
    finally:
        _run_folder.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """``name`` with so many underscores before it that no column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def list_array(parts: list[np.ndarray] | list[bytes], dtype: str = "<i4") -> pa.ListArray:
    """One Arrow list for each part."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    width = np.dtype(dtype).itemsize
    offsets = np.zeros(len(raw) + 1, dtype=np.int32)
    np.cumsum([len(r) // width for r in raw], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype=dtype)))
