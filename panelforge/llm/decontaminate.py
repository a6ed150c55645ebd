"""Benchmark decontamination by size-partitioned MinHash containment search.

Of a short test item, the share of its word shingles found in a document is what counts, however long
the document is. Items are partitioned by their number of shingles, and each size class is searched for itself.
In a class of items with at most u shingles, each item's sketch is its ``u - ceil(threshold * u) + 1`` smallest
shingle hashes: an item with ``threshold`` of its shingles in a document has at least one of these there, so the
search loses nothing. Documents stream past the sketches, and each candidate is then verified by the exact
containment of its shingles.

The items are a query set against all documents: they are read in blocks of at most ``BLOCK_CHARS`` characters (and
one item), and each block goes to the tasks as one broadcast, some ten bytes a character. With more than one block
the documents are read once past a bitmap of ``FILTER_BITS`` of all sketches' hashes, made by Spark and of fixed size;
only those that meet a bit of it are kept and read again for the blocks.

Words are runs of letters and digits in lower case. Nulls: a null or empty text has no words and matches nothing. A
text with fewer words than a shingle has them all as its one shingle. Null ids pass through; ids of documents and
items may be of any type. Repeated rows and items give repeated results; only ids and texts are read, so other
columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelforge.llm.common import materialize, texts_of

#: Characters of item texts in one broadcast block.
BLOCK_CHARS = 16_000_000
FILTER_BITS = 27
WORDS = re.compile(r"[^\W_]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def sketch_size(n: int, threshold: float) -> int:
    """Hashes kept of an item with ``n`` shingles: as many as the largest of its size class needs."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest - math.ceil(threshold * largest - 1e-9) + 1)


def size_class(n: int) -> int:
    return n.bit_length()


class ItemBlock:
    """A block of items: the shingles of all as rows of word numbers, and the sketches of each size class."""

    def __init__(self, items: list[tuple[object, str]], width: int, threshold: float):
        self.width, self.threshold, self.ids = width, threshold, [i for i, _ in items]
        self.words: dict[str, int] = {}
        self.short: dict[tuple[str, ...], list[int]] = {}
        self.sizes, rows, owners = [], [np.zeros((0, width), np.uint32)], [np.zeros(0, np.int32)]
        for item, (_, text) in enumerate(items):
            words = words_of(text)
            if len(words) < width:
                self.sizes.append(min(1, len(words)))
                if words:
                    self.short.setdefault(tuple(words), []).append(item)
                continue
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], dtype=np.uint32)
            rows.append(np.unique(np.lib.stride_tricks.sliding_window_view(ids, width), axis=0))
            owners.append(np.full(len(rows[-1]), item, dtype=np.int32))
            self.sizes.append(len(rows[-1]))
        # Distinct shingles by hash, and the items of each: owners[first[i] : first[i + 1]].
        self.rows, of = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        hashes = self._hash(self.rows)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.rows, self.hashes = self.rows[order], hashes[order]
        of, owners = place[of.reshape(-1)], np.concatenate(owners)
        by = np.argsort(of, kind="stable")
        self.owners, self.first = owners[by], np.searchsorted(of[by], np.arange(len(order) + 1))
        # Of each item, the shingles of the smallest hashes: (shingle, item) by size class.
        by = np.lexsort((of, owners))
        of, owners = of[by], owners[by]
        rank = np.arange(len(owners)) - np.searchsorted(owners, owners)
        kept = rank < np.array([sketch_size(n, threshold) if n else 0 for n in self.sizes])[owners] if len(owners) else rank < 0
        of, owners = of[kept], owners[kept]
        classes = np.array([size_class(n) for n in self.sizes], dtype=np.int64)[owners] if len(owners) else owners
        self.sketches = []
        for c in np.unique(classes):
            mine = np.flatnonzero(classes == c)
            mine = mine[np.argsort(of[mine], kind="stable")]
            self.sketches.append((of[mine], owners[mine]))

    def _hash(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for column in rows.T:
                out = (out ^ (out >> np.uint64(29))) * FACTOR + column
            return (out ^ (out >> np.uint64(32))) * FACTOR

    def search(self, text: str) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of the items contained in a text."""
        words = words_of(text)
        if len(words) < self.width:
            for item in self.short.get(tuple(words), ()):
                yield item, 1
            return
        ids = np.fromiter(map(self.words.get, words, repeat(0)), dtype=np.uint32, count=len(words))
        known = np.lib.stride_tricks.sliding_window_view(ids, self.width)
        known = known[(known > 0).all(axis=1)]
        if not len(known) or not len(self.hashes):
            return
        hashes = self._hash(known)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        found = np.unique(at[(self.hashes[at] == hashes) & (self.rows[at] == known).all(axis=1)])
        if not len(found):
            return
        candidates = np.unique(np.concatenate([_members(shingles, items, found) for shingles, items in self.sketches]))
        if not len(candidates):
            return
        all_owners = np.concatenate([self.owners[self.first[i] : self.first[i + 1]] for i in found.tolist()])
        shared = np.bincount(all_owners, minlength=len(self.ids))
        for item in candidates.tolist():
            if shared[item] >= self.threshold * self.sizes[item] - 1e-9:
                yield item, int(shared[item])


def _members(shingles: np.ndarray, items: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The items of the sketch rows whose shingle is among ``found``."""
    low, high = np.searchsorted(shingles, found), np.searchsorted(shingles, found, side="right")
    hit = high > low
    return np.concatenate([items[a:b] for a, b in zip(low[hit].tolist(), high[hit].tolist(), strict=True)]) if hit.any() else items[:0]


def shingle_keys(words: list[str], width: int) -> np.ndarray:
    """A 64-bit key of each shingle, the same in every task."""
    codes = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64)
    n = max(1, len(words) - width + 1) if words else 0
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(width, len(words))):
            out = (out ^ (out >> np.uint64(29))) * FACTOR + codes[i : i + n]
        return (out ^ (out >> np.uint64(32))) * FACTOR


def _sketch_bitmap(benchmark: DataFrame, text_col: str, width: int, threshold: float) -> np.ndarray:
    """The bits that the items' sketches set, by the keys of their shingles."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in texts_of(batch.column(0)):
                keys = np.unique(shingle_keys(words_of(text), width))
                found.append(keys[: sketch_size(len(keys), threshold)] if len(keys) else keys)
            slot = np.unique(np.concatenate(found) >> np.uint64(64 - FILTER_BITS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(slot)], names=["slot"])

    bits = F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767).cast("long"))
    parts = benchmark.select(text_col).mapInArrow(slots, "slot int").groupBy(F.shiftright("slot", 15).alias("part")).agg(bits.alias("bits"))
    bitmap = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for part, data in parts.toLocalIterator():
        bitmap[part << 12 : (part << 12) + len(data)] = np.frombuffer(data, dtype=np.uint8)
    return bitmap


def _candidates(rows: DataFrame, bitmap: np.ndarray, width: int) -> DataFrame:
    """The rows (id, text) with a shingle whose bit is set."""
    sent = rows.sparkSession.sparkContext.broadcast(bitmap)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            hits = []
            for text in texts_of(batch.column(1)):
                slot = (shingle_keys(words_of(text), width) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                hits.append(bool((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).any()))
            yield batch.filter(pa.array(hits, pa.bool_()))

    return rows.mapInArrow(kept, rows.schema)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, chars: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        block.append((item, text or ""))
        size += len(text or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained_items(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 5,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row for each document and item it contains: id, item id, n_shingles of the item, n_shared, containment."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text_col))
    item_type = benchmark.select(item_col).schema[0].dataType
    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, `{item_col}` {item_type.simpleString()}, n_shingles long, n_shared long"
    arrow_type = to_arrow_type(item_type)

    def searched(rows: DataFrame, block: list[tuple[object, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(ItemBlock(block, width, threshold))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                hits = [(row, item, n) for row, text in enumerate(texts_of(batch.column(1))) for item, n in items.search(text)]
                if hits:
                    at, item, n = zip(*hits, strict=True)
                    columns = [batch.column(0).take(pa.array(at)), pa.array([items.ids[i] for i in item], arrow_type), pa.array([items.sizes[i] for i in item], pa.int64()), pa.array(n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_col, item_col, "n_shingles", "n_shared"])

        return rows.mapInArrow(search, schema)

    blocks = _blocks(benchmark, item_col, item_text_col, block_chars)
    first, second = next(blocks, None), next(blocks, None)
    if second is not None:
        rows = materialize(_candidates(rows, _sketch_bitmap(benchmark, item_text_col, width, threshold), width), "candidates")
    found = [searched(rows, block) for block in chain([first, second], blocks) if block is not None]
    out = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
