"""Line dedup with a log-template tree of fixed depth.

A line is parsed down a tree: its number of tokens, then its ``depth`` leading tokens, with every token that holds
a digit generalised to a wildcard. A leaf's lines fall into templates, in which some of the later tokens are
generalised: none, one run of a fifth of the line at most, or two runs of a tenth each (``wildcards``). So lines of
a template agree in 0.8 of their tokens or more, and may differ in two variable fields wherever these are, or in
one longer one. A template found in ``min_docs`` documents or more, or a masked line of ``LONG_LINE`` tokens in
two, is recurring, and its lines are dropped, but for the first (by document id, then line number), so that of
copied text one copy stays.

1. Documents are counted by leaf, in as many slots as a bitmap of fixed size has bits. The bitmap of the slots with
   two documents or more goes to all tasks. It only saves work: a shared leaf's slot is always in it.
2. Lines of such leaves give one row each. They are counted by masked line, with partial aggregation, so a line
   that all documents share is one row a task from there on.
3. Distinct lines of leaves with several of them and ``min_docs`` documents or more give one row for each template;
   templates are counted in the same way.
4. What becomes of each distinct line meets its rows: that of the most frequent lines, at most ``HOT`` of them,
   by broadcast, that of the others in a join. The line numbers to drop meet the documents.

Nulls: a null text stays null, an empty one empty; blank lines are never dropped. A document all of
whose lines go keeps its row, with an empty text. Null ids come last in the order that decides which
line stays. Rows of the same id and text count as one document and are cleaned alike. Empty tables give
empty results. Other columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import fresh, materialize, texts_of

DEPTH = 3
MIN_DOCS = 3
#: Tokens from which on the masked line itself is recurring in two documents.
LONG_LINE = 10
#: Slots of the bitmap.
SLOTS = 1 << 27
#: Lines of at least this part of all rows are broadcast.
HOT = 10_000
#: Lines of which a task remembers that it has handed on their tokens.
SEEN = 200_000
WILDCARD = "<*>"
DIGIT = re.compile(r"\d")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def parse(line: str) -> list[str]:
    """The tokens of a line, those with digits generalised."""
    tokens = line.split()
    return [WILDCARD if DIGIT.search(t) else t for t in tokens] if DIGIT.search(line) else tokens


def _lines(text: str) -> Iterator[tuple[int, list[str]]]:
    for number, line in enumerate(text.split("\n")):
        if tokens := parse(line):
            yield number, tokens


def leaf_of(tokens: list[str], depth: int) -> int:
    return xxhash.xxh64_intdigest("\n".join([str(len(tokens)), *tokens[:depth]]))


def wildcards(n: int, depth: int = DEPTH) -> list[list[range]]:
    """The runs of tokens that a line of ``n`` tokens has generalised in each of its templates but the line itself."""
    cut = lambda size: [range(at, min(at + size, n)) for at in range(depth, n, size)] if size else []
    small = cut(n // 10)
    runs = [[run] for run in cut(n // 5)] + [[a, b] for i, a in enumerate(small) for b in small[i + 1 :]]
    return list({tuple(i for r in w for i in r): w for w in reversed(runs)}.values())[::-1]


@lru_cache(maxsize=4096)
def _bounds(n: int, depth: int) -> np.ndarray:
    """First and last token of the first and second run of each template: four rows."""
    runs = [(w[0].start, w[0].stop, w[-1].start, w[-1].stop) if len(w) > 1 else (w[0].start, w[0].stop, 0, 0) for w in wildcards(n, depth)]
    return np.array(runs, dtype=np.int64).reshape(-1, 4).T


def template_keys(tokens: np.ndarray, leaf: int, depth: int) -> np.ndarray:
    """A key of each template with wildcards, from the hashes of a line's tokens by place."""
    a, b, c, d = _bounds(len(tokens), depth)
    with np.errstate(over="ignore"):
        upto = np.r_[np.uint64(0), np.cumsum(tokens, dtype=np.uint64)]
        left = np.uint64(leaf) + upto[-1] - (upto[b] - upto[a]) - (upto[d] - upto[c])
        key = ((left ^ (left >> np.uint64(31))) * _MIX) ^ (np.arange(1, len(a) + 1, dtype=np.uint64) * _MIX)
        return (key ^ (key >> np.uint64(29))) * _MIX


def _live_leaves(rows: DataFrame, depth: int) -> np.ndarray:
    """Bitmap of the slots that leaves of two documents reach (and of those that share one)."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in texts_of(batch.column(0)):
                found += {leaf_of(tokens, depth) & (SLOTS - 1) for _, tokens in _lines(text)}
            slot, n = np.unique(np.array(found, dtype=np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], names=["slot", "n"])

    live = rows.select("__text").mapInArrow(slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= 2)
    bits = F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767).cast("long"))
    bitmap = np.zeros(SLOTS // 8, dtype=np.uint8)
    for part, data in live.groupBy(F.shiftright("slot", 15).alias("part")).agg(bits.alias("bits")).toLocalIterator():
        bitmap[part << 12 : (part << 12) + len(data)] = np.frombuffer(data, dtype=np.uint8)
    return bitmap


def _line_rows(rows: DataFrame, bitmap: np.ndarray, depth: int) -> DataFrame:
    """A row for each line of a live leaf; the hashes of its tokens where the task meets the line first."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, seen, digest = sent.value, set(), xxhash.xxh64_intdigest
        for batch in batches:
            at, line, whole, leaves, long, hashes = [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(2))):
                for number, tokens in _lines(text):
                    leaf = leaf_of(tokens, depth)
                    slot = leaf & (SLOTS - 1)
                    if not live[slot >> 3] >> (slot & 7) & 1:
                        continue
                    key = digest("\n".join(tokens), 1)
                    at.append(i)
                    line.append(number)
                    whole.append(key)
                    leaves.append(leaf)
                    long.append(len(tokens) >= LONG_LINE)
                    if key in seen or len(tokens) < 5:
                        hashes.append(None)
                    else:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        hashes.append(np.array([digest(t, n) for n, t in enumerate(tokens)], dtype=np.uint64).tobytes())
            take = pa.array(at, pa.int64())
            signed = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (whole, leaves))
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(line, pa.int32()), *signed, pa.array(long, pa.bool_()), pa.array(hashes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["__row", "__id", "__line", "whole", "leaf", "long", "tokens"])

    schema = f"__row long, __id {rows.schema['__id'].dataType.simpleString()}, __line int, whole long, leaf long, long boolean, tokens binary"
    return rows.select("__row", "__id", "__text").mapInArrow(parsed, schema)


def _template_rows(lines: DataFrame, depth: int) -> DataFrame:
    """(key, whole, row, n, first) of each template of the lines (whole, leaf, tokens, row, n, first)."""
    rows = lines.select("tokens", "leaf", "whole", "row", "n", "first")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                leaves = part.column(1).to_numpy().view(np.uint64)
                keys = [template_keys(np.frombuffer(t, "<u8"), leaf, depth) for t, leaf in zip(part.column(0).to_pylist(), leaves, strict=True)]
                take = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(c.take(take) for c in part.columns[2:])], names=["key", *part.schema.names[2:]])

    return rows.mapInArrow(exploded, f"key long, whole long, row long, n long, first {rows.schema['first'].dataType.simpleString()}")


def _fates(found: DataFrame, depth: int, min_docs: int) -> DataFrame:
    """Of each distinct line with a recurring template: ``n`` documents, and the least and the last of its templates' first lines."""
    place = F.struct(F.col("__id").isNull().alias("none"), "__id", "__row", "__line")
    in_doc = found.groupBy("whole", "__row").agg(F.min(place).alias("place"), F.first("leaf").alias("leaf"), F.max("long").alias("long"), F.first("tokens", True).alias("tokens"))
    in_doc = materialize(in_doc, "lines-in-documents")
    distinct = in_doc.groupBy("whole").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.first("leaf").alias("leaf"), F.max("long").alias("long"), F.first("tokens", True).alias("tokens")
    )
    distinct = materialize(distinct, "distinct-lines")
    own = distinct.where((F.col("n") >= min_docs) | F.col("long") & (F.col("n") >= 2)).select("whole", F.col("first").alias("lo"), F.col("first").alias("hi"))
    # Only leaves of several lines and of min_docs documents at least can have another recurring template.
    several = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("docs"))
    several = several.where((F.col("lines") > 1) & (F.col("docs") >= min_docs)).select("leaf")
    varied = materialize(distinct.where("tokens is not null").join(several, "leaf", "left_semi"), "varied-lines")
    # A line of min_docs documents or more makes its templates recurring; of the others each document counts once.
    documents = in_doc.select("whole", F.col("__row").alias("row"))
    few = varied.where(F.col("n") < min_docs).join(documents, "whole")
    many = varied.where(F.col("n") >= min_docs).withColumn("row", F.lit(None).cast("long"))
    keyed = materialize(_template_rows(few.unionByName(many), depth), "templates")
    recurring = keyed.groupBy("key").agg(F.greatest(F.max("n"), F.count_distinct("row")).alias("docs"), F.min("first").alias("start")).where(F.col("docs") >= min_docs)
    of_templates = keyed.select("key", "whole").join(recurring.select("key", "start"), "key").select("whole", F.col("start").alias("lo"), F.col("start").alias("hi"))
    fates = own.unionByName(of_templates).groupBy("whole").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return fates.join(distinct.select("whole", "n"), "whole")


def dropped_lines(rows: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``__row`` and its ``__drop``, the numbers of the lines that go; rows without any are left out."""
    found = materialize(_line_rows(rows, _live_leaves(rows, depth), depth), "lines")
    fates = materialize(_fates(found, depth, min_docs), "fates")
    total = found.count()
    hot = fates.where(F.col("n") * HOT >= total)
    lines = found.select("__row", "__line", "whole")
    rest = lines.join(F.broadcast(hot.select("whole")), "whole", "left_anti").join(fates.where(F.col("n") * HOT < total), "whole")
    met = lines.join(F.broadcast(hot), "whole").unionByName(rest)
    stays = (F.col("lo") == F.col("hi")) & (F.col("lo.__row") == F.col("__row")) & (F.col("lo.__line") == F.col("__line"))
    return met.where(~stays).groupBy("__row").agg(F.collect_set("__line").alias("__drop"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with cleaned texts, and ``__n_lines`` and ``__n_dropped`` of each row (with more underscores where ``docs`` has such columns)."""
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("__row"))
    rows = keyed.select("__row", F.col(f"doc.`{id_col}`").alias("__id"), F.col(f"doc.`{text_col}`").alias("__text"))
    drops = materialize(dropped_lines(rows, depth, min_docs), "dropped-lines")
    joined = keyed.join(drops.hint("merge"), "__row", "left")  # one plan at every size
    whole = F.col(f"doc.`{text_col}`")
    lines = F.split(whole, "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.array_contains("__drop", i))
    text = F.when(F.col("__drop").isNull(), whole).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *((text if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(fresh("__n_lines", docs.columns)),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias(fresh("__n_dropped", docs.columns)),
    )
