"""SimHash near-dedup with BK-trees over shards of fingerprints.

Two fingerprints of 64 bits with at most ``radius`` = 3 different bits agree in at least two of five
blocks. Each distinct fingerprint is dealt to the shards of its ten pairs of blocks; within a shard a
BK-tree (children keyed by their integer Hamming distance to the parent) is searched for every member,
following only the edges within the radius. Shards reach the tasks by a shuffle, since a broadcast of
the trees would grow with the corpus.

A task reads its shards in key order and holds at most ``SHARD_ROWS`` rows of one. Of a larger shard it
hands the rows on; they are dealt again by seven of ten smaller blocks of the bits that their shard
leaves free. That leaves at most 12 free bits, so no second shard has more than 4096 members. Both steps
are exact: no link is lost, and the rows stay in proportion to the input however large a group is. A
shard returns a spanning star of each of its linked groups instead of all pairs.

Texts: null counts as empty; without words the fingerprint is zero and is linked like any other; fewer
words than a shingle has give one shingle of them all. Null ids are linked too and ignored as component
ids (a component of null ids alone has a null id). Repeated rows give repeated results, empty tables
none; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialize, texts_of
from panelforge.llm.graph import components

RADIUS = 3
#: First bit and width of the five blocks, and of the ten parts of three blocks' bits.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
SHARD_ROWS = 8192
#: Rows of whole shards that a task searches together.
CHUNK_ROWS = 50_000
#: Visited nodes of the trees at a time.
VISITS = 1 << 20


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each shingle in order, repeats included; none for a text without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str, width: int = 3) -> int:
    """The fingerprint of a text: the majority of the XXH64 bits of its shingles."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``id_col`` and ``fp`` (the 64 bits as a signed long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, width) for t in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(hashed, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp long")


class BKForest:
    """One BK-tree for each shard, in arrays: ``edges`` holds node * 65 + distance, ``child`` its node."""

    def __init__(self, fps: np.ndarray, shards: np.ndarray):
        """``shards``: ascending; the first row of each is its root. Rows of a shard must differ."""
        self.fps = fps
        new = np.r_[True, shards[1:] != shards[:-1]]
        self.roots = np.flatnonzero(new)[np.cumsum(new) - 1]
        at, rows = self.roots.copy(), np.flatnonzero(~new)
        edges, child = [], []
        while rows.size:
            key = at[rows] * 65 + np.bitwise_count(fps[rows] ^ fps[at[rows]])
            found, first, where = np.unique(key, return_index=True, return_inverse=True)
            edges.append(found)
            child.append(rows[first])
            at[rows] = rows[first][where]
            rows = np.delete(rows, first)
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.child = np.concatenate(child) if child else np.zeros(0, np.int64)
        order = np.argsort(self.edges)
        self.edges, self.child = self.edges[order], self.child[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query row, row of its shard) at most ``radius`` bits apart, level by level."""
        node = self.roots[queries]
        while queries.size:
            apart = np.bitwise_count(self.fps[queries] ^ self.fps[node]).astype(np.int64)
            near = apart <= radius
            yield queries[near], node[near]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(apart - radius, 0))
            n = np.searchsorted(self.edges, node * 65 + np.minimum(apart + radius, 64), side="right") - low
            ends = np.cumsum(n)
            node = self.child[np.repeat(low - (ends - n), n) + np.arange(ends[-1])]
            queries = np.repeat(queries, n)


def link_shards(fps: np.ndarray, shards: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Each row with the first row of its linked group, where these differ, as fingerprints."""
    forest, label = BKForest(fps, shards), np.arange(len(fps))
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]), len(fps)])
    work = np.cumsum(np.repeat(sizes, sizes))
    cuts = np.unique(np.r_[0, np.searchsorted(work, np.arange(VISITS, work[-1], VISITS)) + 1, len(fps)])
    for a, b in zip(cuts, cuts[1:], strict=False):
        for x, y in forest.search(np.arange(a, b), radius):
            while (apart := label[x] != label[y]).any():
                x, y = x[apart], y[apart]
                small = np.minimum(label[x], label[y])
                np.minimum.at(label, label[x], small)
                np.minimum.at(label, label[y], small)
                while (deeper := label[label] != label).any():
                    label[deeper] = label[label[deeper]]
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _packed(fp: Column, parts: list[tuple[int, int]], tag: int) -> Column:
    key = F.lit(tag).cast("long")
    for first, width in parts:
        key = F.shiftleft(key, width).bitwiseOR(_bits(fp, first, width))
    return key


def first_keys(fp: Column) -> Column:
    """The shards of a fingerprint: one for each pair of its five blocks."""
    return F.array(*(_packed(fp, list(pair), tag) for tag, pair in enumerate(combinations(BLOCKS, RADIUS - 1), 1)))


def second_keys(shards: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the keys by which rows of large shards are dealt again: seven of ten parts of their free bits."""
    for tag, pair in enumerate(combinations(BLOCKS, 2), 1):
        rows = np.flatnonzero(shards >> sum(width for _, width in pair) == tag)
        free = [bit for first, width in BLOCKS if (first, width) not in pair for bit in range(first, first + width)]
        for k, chosen in enumerate(combinations(np.array_split(free, 10), 7)):
            key = np.full(len(rows), k, dtype=np.int64)
            for bit in np.concatenate(chosen):
                key = key << 1 | fps[rows] >> bit & 1
            yield rows, key


def deal_again(large: DataFrame) -> DataFrame:
    """(shard, part, fp): each row of a large ``shard`` once for each of its second keys."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, fps = (c.to_numpy() for c in batch.columns)
            for rows, part in second_keys(shards, fps):
                yield pa.RecordBatch.from_arrays([pa.array(shards[rows]), pa.array(part), pa.array(fps[rows])], names=["shard", "part", "fp"])

    return large.mapInArrow(deal, "shard long, part long, fp long")


def _search_dealt(dealt: DataFrame, keys: list[str], limit: int | None) -> DataFrame:
    """Links (a, b) of the shards; of shards of more than ``limit`` rows, (shard key, fp, large=true)."""
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def result(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(np.full(len(a), large))], names=["a", "b", "large"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = [], None  # rows of whole shards and of the one that goes on; a large shard's key

        def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for shard, of in _large(rows, limit):
                yield result(np.full(len(of), shard), of, True)
            rows = _small(rows, limit)
            if len(rows):
                groups = np.cumsum(np.r_[0, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)])
                a, b = link_shards(rows[:, -1].astype(np.uint64), groups)
                yield result(a.view(np.int64), b.view(np.int64), False)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if passing is not None:
                same = int((rows[:, 0] == passing).sum())
                yield result(rows[:same, 0], rows[:same, -1], True)
                if same == len(rows):
                    continue
                rows, passing = rows[same:], None
            rows = np.concatenate([*held, rows])
            open_from = int(np.flatnonzero((rows[:, :-1] == rows[-1, :-1]).all(axis=1))[0])
            if limit and len(rows) - open_from > limit:
                yield from linked(rows)
                held, passing = [], rows[-1, 0]
            elif open_from >= CHUNK_ROWS:
                yield from linked(rows[:open_from])
                held = [rows[open_from:]]
            else:
                held = [rows]
        if held:
            yield from linked(np.concatenate(held))

    return dealt.select(*keys, "fp").mapInArrow(search, "a long, b long, large boolean")


def _sizes(rows: np.ndarray) -> np.ndarray:
    new = np.r_[True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1)]
    starts = np.flatnonzero(new)
    return np.diff(np.r_[starts, len(rows)])[np.cumsum(new) - 1]


def _large(rows: np.ndarray, limit: int | None) -> Iterator[tuple[int, np.ndarray]]:
    if limit:
        large = rows[_sizes(rows) > limit]
        for key in np.unique(large[:, 0]):
            yield key, large[large[:, 0] == key, -1]


def _small(rows: np.ndarray, limit: int | None) -> np.ndarray:
    sizes = _sizes(rows)
    return rows[(sizes > 1) & (sizes <= (limit or len(rows)))]


def link_fingerprints(distinct: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` at most three bits apart, directly or in steps."""
    dealt = distinct.select(F.explode(first_keys(F.col("fp"))).alias("shard"), "fp")
    found = materialize(_search_dealt(dealt, ["shard"], shard_rows), "shard-links")
    links = found.where("not large").select("a", "b")
    large = found.where("large").select(F.col("a").alias("shard"), F.col("b").alias("fp"))
    if not large.isEmpty():
        links = links.union(_search_dealt(deal_again(large), ["shard", "part"], None).select("a", "b"))
    return links


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """One row for each row of ``docs``: id, fp (signed long), component_id."""
    prints = materialize(fingerprints(docs, id_col, text_col, width).withColumnRenamed(id_col, "__id"), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("__id").alias("rep")), "classes")
    roots = materialize(components(link_fingerprints(classes, shard_rows)), "roots")
    linked = classes.join(roots, classes.fp == roots.node).select("fp", "rep", "root")
    least = linked.groupBy("root").agg(F.min("rep").alias("component"))
    named = linked.join(least, "root").select("fp", "component")
    of = classes.join(named, "fp", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
