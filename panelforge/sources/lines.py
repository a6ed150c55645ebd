"""Lines of text files of any size below a header that each file finds for itself, read in ranges of bytes.

A table of ranges is dealt to the tasks; a task opens its range alone. A line belongs to the range that its first byte
lies in, so lines across borders are whole and come once. Each range reads the head of its file for the header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
#: Bytes of a file's beginning among whose lines the header is looked for, and bytes read at a time.
HEAD_BYTES, CHUNK = 1 << 20, 4 << 20
BATCH_LINES = 10_000


def ranges_of(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``file``, ``start`` and ``stop`` of each range; Spark lists the files, whose contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    return files.select("file", "length", start.alias("start")).select("file", "start", F.least(F.col("start") + range_bytes, "length").alias("stop"))


def lines_below_header(spark: SparkSession, path: str, header: str, head_lines: int = 200, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """``file``, ``header`` and ``line`` of each line that is not blank; a file without a header gives none.

    The header is the first of ``head_lines`` lines that the pattern ``header`` finds, in lower case.
    """
    ranges = ranges_of(spark, path, range_bytes)
    tasks = tasks or min(10_000, max(1, ranges.count()))
    return ranges.repartition(tasks, "file", "start").mapInArrow(_reader(header, head_lines), "file string, header string, line string")


def _reader(header: str, head_lines: int):
    wanted = re.compile(header)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", file))
                with system.open_input_file(inner) as source:
                    found = _header(source, wanted, head_lines)
                    if found:
                        yield from _batches(file, found[0], _lines(source, max(start, found[1]), start > found[1], stop))

    return read


def _header(source: pa.NativeFile, wanted: re.Pattern, head_lines: int) -> tuple[str, int] | None:
    """The header's text and where the line below it begins."""
    at = 0
    for raw in source.read_at(HEAD_BYTES, 0).split(b"\n")[:head_lines]:
        at += len(raw) + 1
        text = raw.decode("utf-8", "replace").lstrip("\ufeff").rstrip("\r")
        if wanted.search(text.lower()):
            return text, at
    return None


def _lines(source: pa.NativeFile, at: int, inside: bool, stop: int) -> Iterator[str]:
    """The lines that begin from ``at`` on and before ``stop``; ``inside``: ``at`` may lie within a line, which is another range's."""
    if inside:
        at -= 1  # a line that begins at ``at`` has its newline before it
    source.seek(at)
    held, begins, skip = b"", at, inside
    while begins < stop or skip:
        chunk = source.read(CHUNK)
        if not chunk:
            if held and not skip and begins < stop:
                yield held.decode("utf-8", "replace")
            return
        parts = (held + chunk).split(b"\n")
        held = parts.pop()
        for raw in parts:
            if skip:
                skip = False
            elif begins < stop:
                yield raw.decode("utf-8", "replace")
            begins += len(raw) + 1


def _batches(file: str, header: str, lines: Iterator[str]) -> Iterator[pa.RecordBatch]:
    held: list[str] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(held)), pa.array([header] * len(held)), pa.array(held, pa.string())], names=["file", "header", "line"])

    for line in lines:
        if line.strip():
            held.append(line.rstrip("\r"))
            if len(held) >= BATCH_LINES:
                yield batch()
                held = []
    if held:
        yield batch()
