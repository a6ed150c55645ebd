"""SimHash near-dedup at a wide radius, for pairs of a given similarity of their shingle sets.

Texts of Jaccard similarity 0.8 differ in some ten of 64 bits, too many for blocks of the bits to deal
them to small shards. Here the shards are the bands of a MinHash sketch: texts of similarity 0.8 share
none of ``BANDS`` = 24 bands of four hashes with a chance of 3 in a million, closer ones more rarely. In a
shard a BK-tree over the fingerprints is searched within ``RADIUS`` = 24 bits (five standard deviations
above the mean distance), and the exact similarity of the shingle sets decides.

1. Texts of equal words are one class.
2. In each shard each linked group sends its members with its most central one as pairs, so near copies of one
   text meet in pairs linear in their number. Verified pairs give components.
3. Each shard of several components is searched again for rows with a row of another component near them. Their
   shingle sets go to the shard's task, which verifies the pairs there and returns only those that join two
   components, at most one for each row; no link that would join two components is lost, except between texts that
   share no band or whose fingerprints are further apart than the radius.

   Rows are compared with one member of each other component first: the Jaccard distance obeys the triangle
   inequality, so the distances to that member rule out most others. Of a shard of more than ``SHARD_ROWS`` rows or
   ``SHARD_SHINGLES`` shingles the largest component is dealt to blocks that only meet the blocks of the other
   rows, never one another, so work grows with the product of a group of copies and the rows around it.

Texts: null counts as empty; texts without words are one class; fewer words than a shingle has give one
shingle of them all. Null ids are linked too and ignored as component ids. Repeated rows give repeated
results, empty tables none; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import list_array, materialize, texts_of
from panelforge.llm.graph import components
from panelforge.llm.simhash import BKForest, majority, shingle_hashes

RADIUS = 24
BANDS, ROWS = 24, 4
SHARD_ROWS = 4096
#: Shingles of a block, for the memory of a task that holds two.
SHARD_SHINGLES = 1 << 22
#: Rows of whole shards that a task searches together, and queries of one search.
CHUNK_ROWS, QUERIES = 50_000, 256
_random = np.random.default_rng(11)
_FACTORS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_ADDED = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash sketch of a set of hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            mixed = hashes[at : at + 4096, None] * _FACTORS + _ADDED
            mixed = (mixed ^ (mixed >> np.uint64(31))) * _MIX
            least = np.minimum(least, mixed.min(axis=0))
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            key = ((key ^ (key >> np.uint64(29))) * _MIX) ^ column
        return key * _MIX


def text_key(text: str) -> int:
    """A signed 64-bit key of the words of a text."""
    words = b" ".join(text.encode("utf-8", "replace").lower().split())
    return int(np.uint64(xxhash.xxh3_64_intdigest(words, 7)).view(np.int64))


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, bands = [], [], [], []
            for text in texts_of(batch.column(2)):
                hashes = shingle_hashes(text, width)
                distinct = np.unique(hashes)
                nodes.append(text_key(text))
                fps.append(majority(distinct))
                sizes.append(len(distinct))
                bands.append(band_keys(distinct) if len(distinct) else distinct)
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), list_array(bands, "<i8")]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__hash", "node", "fp", "n", "bands"])

    return docs.mapInArrow(sketch, f"__id {docs.schema[0].dataType.simpleString()}, __hash long, node long, fp long, n long, bands array<long>")


def _shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(2))
            for at in range(0, len(texts), 256):
                part = texts[at : at + 256]
                found = [np.unique(shingle_hashes(t, width)) for t in part]
                yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in part], pa.int64()), list_array(found, "<i8")], names=["node", "shingles"])

    return docs.mapInArrow(sets, "node long, shingles array<long>")


def _unique(fps: np.ndarray, shards: np.ndarray) -> tuple[BKForest, np.ndarray, np.ndarray]:
    """The trees over the distinct fingerprints of each shard; each row's number there; the shards of those."""
    pairs, where = np.unique(np.stack([shards.astype(np.uint64), fps], axis=1), axis=0, return_inverse=True)
    return BKForest(pairs[:, 1].copy(), pairs[:, 0]), where.reshape(-1), pairs[:, 0]


def star_pairs(fps: np.ndarray, shards: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(central row, other row) of each group of rows that a tree's search from its first members reaches."""
    forest, where, of = _unique(fps, shards)
    label, todo = np.full(len(of), -1), np.arange(len(of))
    while todo.size:  # the first unreached fingerprint of each shard takes all within the radius
        first = todo[np.unique(of[todo], return_index=True)[1]]
        for x, y in forest.search(first, radius):
            free = label[y] < 0
            label[y[free]] = x[free]
        todo = todo[label[todo] < 0]
    group = label[where]
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])
    sizes = np.diff(np.r_[starts, len(order)])
    bits = np.unpackbits(fps[order].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    centre = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    apart = np.bitwise_count(fps[order] ^ np.repeat(centre, sizes))
    number = np.repeat(np.arange(len(starts)), sizes)
    central = order[np.lexsort((apart, number))[starts]]
    a = np.repeat(central, sizes)
    return a[a != order], order[a != order]


def open_rows(fps: np.ndarray, shards: np.ndarray, comps: np.ndarray, sizes: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """Whether a row's fingerprint is within the radius of one, of a fitting size, that another component has in its shard.

    Decided by distinct fingerprints (the least and largest component and size of each), so rows that share one
    are not paired; a few more rows are open than have such a partner themselves.
    """
    forest, where, of = _unique(fps, shards)
    order = np.argsort(where, kind="stable")
    first = np.searchsorted(where[order], np.arange(len(of)))
    (c_lo, c_hi), (n_lo, n_hi) = ((np.minimum.reduceat(x[order], first), np.maximum.reduceat(x[order], first)) for x in (comps, sizes))
    opened = np.zeros(len(of), bool)
    for at in range(0, len(of), QUERIES):
        for x, y in forest.search(np.arange(at, min(at + QUERIES, len(of))), radius):
            apart = np.minimum(c_lo[x], c_lo[y]) != np.maximum(c_hi[x], c_hi[y])
            fits = (n_hi[x] >= similarity * n_lo[y] - 1e-9) & (n_hi[y] >= similarity * n_lo[x] - 1e-9)
            opened[x[apart & fits]] = True
            opened[y[apart & fits]] = True
    return opened[where]


def _by_shard(dealt: DataFrame, keys: list[str], limit: int | None, search: Callable, schema: str) -> DataFrame:
    """What ``search`` finds in the rows (keys, node, fp, n, comp, side) of whole shards and their shard numbers."""
    rest = ["node", "fp", "n", "comp", "side"]
    dealt = dealt.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, F.xxhash64(keys[0], "node"))

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        shards = np.cumsum(np.r_[False, (rows[1:, : len(keys)] != rows[:-1, : len(keys)]).any(axis=1)])
        many = np.bincount(shards)[shards] > 1
        if many.any():
            yield from search(rows[many], shards[many])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(keys) + len(rest)), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            last = int(np.flatnonzero((held[:, : len(keys)] == held[-1, : len(keys)]).all(axis=1))[0])
            if limit and len(held) - last > limit:  # a crowded shard in parts; its first row meets all of them
                yield from found(held)
                held = held[last : last + 1]
            elif last >= CHUNK_ROWS:
                yield from found(held[:last])
                held = held[last:]
        if len(held):
            yield from found(held)

    return dealt.mapInArrow(each, schema)


def fit_sizes(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    return np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9


def _stars(dealt: DataFrame, similarity: float, radius: int, limit: int) -> DataFrame:
    """Pairs of nodes (a < b): the members of each linked group with its most central one."""

    def search(rows: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, node, fp, n, _, _ = rows.T
        x, y = star_pairs(fp.astype(np.uint64), shards, radius)
        fits = fit_sizes(n[x], n[y], similarity)
        a, b = node[x[fits]], node[y[fits]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _by_shard(dealt, ["shard"], limit, search, "a long, b long").distinct()


def _open_rows(dealt: DataFrame, keys: list[str], similarity: float, radius: int) -> DataFrame:
    """The rows, once each, that have a row of another component within the radius in their shard."""
    names = [*keys, "node", "fp", "n", "comp", "side"]

    def search(rows: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, fp, n, comp, _ = rows[:, len(keys) :].T
        opened = open_rows(fp.astype(np.uint64), shards, comp, n, similarity, radius)
        yield pa.RecordBatch.from_arrays([pa.array(c.copy()) for c in rows[opened].T], names=names)

    return _by_shard(dealt, keys, None, search, ", ".join(f"{c} long" for c in names))


class _Sets:
    """The shingle sets of a shard's rows over the numbers of its distinct shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        distinct, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.own = np.zeros(len(distinct), bool)

    def similarity(self, a: int, others: np.ndarray) -> np.ndarray:
        """Jaccard similarity of row ``a`` with each of the others."""
        mine = self.ids[self.starts[a] : self.starts[a] + self.sizes[a]]
        self.own[mine] = True
        shared = np.zeros(len(others), dtype=np.int64)
        for at in range(0, len(others), QUERIES):
            part = others[at : at + QUERIES]
            filled = np.flatnonzero(self.sizes[part])
            part = part[filled]
            if len(part):
                first = np.cumsum(self.sizes[part]) - self.sizes[part]
                flat = np.repeat(self.starts[part] - first, self.sizes[part]) + np.arange(self.sizes[part].sum())
                shared[at + filled] = np.add.reduceat(self.own[self.ids[flat]], first, dtype=np.int64)
        self.own[mine] = False
        return shared / np.maximum(self.sizes[a] + self.sizes[others] - shared, 1)


def joining_pairs(
    fps: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int, sides: np.ndarray | None = None
) -> tuple[list[int], list[int]]:
    """Pairs of rows of the similarity that join the components of one shard: a spanning forest of all such pairs.

    Rows of the same non-zero ``sides`` are not compared: the pairs of these meet elsewhere.
    """
    found = _Sets(sets)
    sides = np.zeros(len(sets), np.int64) if sides is None else sides
    of, pivots = np.unique(comps, return_index=True)
    number = np.searchsorted(of, comps)
    label, away = number.copy(), np.zeros(len(sets))
    for c in np.flatnonzero(np.bincount(number) > 1).tolist():
        members = np.flatnonzero(number == c)
        away[members] = 1 - found.similarity(int(pivots[c]), members)
    left, right = [], []
    for a in range(len(sets) - 1):
        near = (np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= radius) & fit_sizes(found.sizes[a + 1 :], found.sizes[a], similarity)
        near &= (sides[a + 1 :] != sides[a]) | (sides[a] == 0)
        others = np.flatnonzero(near & (label[a + 1 :] != label[a])) + a + 1
        if len(others) > len(np.unique(number[others])):
            # No row is nearer than the distance to its component's pivot less its own distance from there.
            there = np.unique(number[others])
            to_pivot = np.zeros(len(of))
            to_pivot[there] = 1 - found.similarity(a, pivots[there])
            others = others[np.abs(to_pivot[number[others]] - away[others]) <= 1 - similarity + 1e-9]
        for at in range(0, len(others), QUERIES):
            part = others[at : at + QUERIES]
            part = part[label[part] != label[a]]  # rows that the part before has joined
            for b in part[found.similarity(a, part) >= similarity - 1e-12].tolist():
                if label[a] != label[b]:
                    label[label == label[b]] = label[a]
                    left.append(a)
                    right.append(b)
    return left, right


def _joining_links(opened: DataFrame, sets: DataFrame, keys: list[str], similarity: float, radius: int) -> DataFrame:
    """Pairs of components (a, b) that a verified pair of their nodes joins, at most one for each row of a shard."""
    rows = opened.join(sets, "node").select(*keys, "fp", "comp", "side", "shingles").repartition(*keys).sortWithinPartitions(*keys)

    def links(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            fp, comp, side = np.array([row[-3:] for row, _ in held]).T
            a, b = joining_pairs(fp.astype(np.uint64), comp, [s for _, s in held], similarity, radius, side)
            yield pa.RecordBatch.from_arrays([pa.array(comp[a]), pa.array(comp[b])], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            numbers = np.stack([c.to_numpy() for c in batch.columns[:-1]], axis=1)
            ends, flat = batch.column(-1).offsets.to_numpy(), batch.column(-1).values.to_numpy()
            for i, row in enumerate(numbers):
                if held and (held[-1][0][: len(keys)] != row[: len(keys)]).any():
                    yield from links(held)
                    held = []
                held.append((row, flat[ends[i] : ends[i + 1]]))
        yield from links(held)

    return rows.mapInArrow(search, "a long, b long").distinct()


def _parted(named: DataFrame, shard_rows: int) -> DataFrame:
    """The rows of shards of several components, dealt to (shard, i, j).

    A small shard is one part. Of a large one the rows of its largest component (side 1) go to blocks i < 0 and
    meet each block j of the others there (side 2); the others meet one another in pairs of blocks i <= j.
    """
    blocks = lambda n, weight: F.greatest(F.lit(1), F.ceil(F.greatest(n / shard_rows, weight / SHARD_SHINGLES)))
    by_comp = named.groupBy("shard", "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    top = F.max(F.struct("m", "comp", "w")).alias("top")
    mixed = by_comp.groupBy("shard").agg(F.count(F.lit(1)).alias("comps"), top, F.sum("m").alias("all_m"), F.sum("w").alias("all_w")).where("comps > 1")
    mixed = mixed.select(
        "shard",
        F.col("top.comp").alias("top"),
        ((F.col("all_m") <= shard_rows) & (F.col("all_w") <= SHARD_SHINGLES)).alias("small"),
        blocks(F.col("top.m"), F.col("top.w")).alias("big"),
        blocks(F.col("all_m") - F.col("top.m"), F.col("all_w") - F.col("top.w")).alias("rest"),
    )
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda i, j, side: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(side).cast("long").alias("side"))
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    rest = own(F.col("rest"))
    parts = (
        F.when(F.col("small"), F.array(pair(F.lit(0), F.lit(0), 0)))
        .when(F.col("comp") == F.col("top"), F.transform(upto(F.col("rest")), lambda j: pair(-1 - own(F.col("big")), j, 1)))
        .otherwise(
            F.concat(
                F.transform(upto(F.col("big")), lambda i: pair(-1 - i, rest, 2)),
                F.transform(upto(F.col("rest")), lambda j: pair(F.least(rest, j), F.greatest(rest, j), 0)),
            )
        )
    )
    return named.join(mixed, "shard").select("shard", "node", "fp", "n", "comp", F.explode(parts).alias("part")).select("*", "part.*").drop("part")


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row for each row of ``docs``: id, fp (signed long), component_id."""
    sketches, of = _components(docs, id_col, text_col, width, similarity, radius, shard_rows)
    return sketches.join(of, "node").select(F.col("__id").alias(id_col), "fp", "component_id")


def first_of_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    similarity: float = 0.8,
    radius: int = RADIUS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row of ``docs`` of each group, with all its columns: that of the smallest id, null ids last.

    Of rows with that id the one of the smallest text hash stays, and of rows alike in id and text one of them.
    """
    sketches, of = _components(docs, id_col, text_col, width, similarity, radius, shard_rows, group=True)
    place = F.struct(F.col("__id").isNull().alias("none"), "__id", "__hash")
    first = sketches.join(of, "node").groupBy("group").agg(F.min(place).alias("x")).select("x.*")
    copies = sketches.groupBy("__id", "__hash").count().select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), (F.col("count") > 1).alias("__many"))
    same = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))
    kept = materialize(first.join(copies, same).select("__i", "__h", "__many"), "first-of-groups")

    def rows(keys: DataFrame) -> DataFrame:
        return docs.join(keys, docs[id_col].eqNullSafe(keys["__i"]) & (F.xxhash64(docs[text_col]) == keys["__h"]), "left_semi")

    alike = kept.where("__many")
    if alike.isEmpty():
        return rows(kept)
    return rows(kept.where("not __many")).unionByName(rows(alike).dropDuplicates([id_col, text_col]))


def _components(
    docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, radius: int, shard_rows: int, group: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Each row's sketch (with ``__id``, ``__hash`` of the text and ``node``), and the component of each node.

    The component is its smallest id, or with ``group`` a number of its own (``group``).
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.col(text_col).alias("__text"))
    sketches = materialize(_sketches(rows, width), "sketches")
    classes = materialize(sketches.groupBy("node").agg(F.min(F.struct(F.col("__id").isNull(), "__id", "__hash")).alias("first"), F.min("__id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    dealt = classes.select("node", "fp", "n", F.explode("bands").alias("shard"))
    shared = materialize(dealt.groupBy("shard").count().where("count > 1").select("shard"), "shared-shards")
    dealt = materialize(dealt.join(shared, "shard", "left_semi").select("shard", "node", "fp", "n", F.col("node").alias("comp"), F.lit(0).cast("long").alias("side")), "dealt")

    inside = classes.join(dealt.select("node").distinct(), "node", "left_semi").select(F.col("first.__id").alias("__i"), F.col("first.__hash").alias("__h"))
    texts = rows.join(inside, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left_semi")
    sets = materialize(_shingle_sets(texts, width).groupBy("node").agg(F.first("shingles").alias("shingles")), "shingle-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
        return both.where(F.col("shared") >= similarity * (F.col("na") + F.col("nb") - F.col("shared")) - 1e-9).select("a", "b")

    stars = materialize(_stars(dealt, similarity, radius, shard_rows), "star-pairs")
    links = materialize(verified(stars), "star-links")
    roots = materialize(components(links), "star-roots")

    named = dealt.drop("comp").join(roots, dealt.node == roots.node, "left").select("shard", dealt.node, "fp", "n", F.coalesce("root", dealt.node).alias("comp"))
    parted = _parted(materialize(named, "named"), shard_rows)
    keys = ["shard", "i", "j"]
    opened = materialize(_open_rows(parted, keys, similarity, radius), "open-rows")
    joins = materialize(_joining_links(opened, sets, keys, similarity, radius), "joining-links")
    higher = materialize(components(joins), "higher-roots")  # of components
    above = higher.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    raised = roots.join(above, roots.root == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"))
    single = higher.join(roots, "node", "left_anti")  # linked in this step alone: a component of its own before
    roots = materialize(raised.union(single), "roots")

    if group:
        return sketches, classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"))
    linked = classes.join(roots, "node").select("node", "rep", "root")
    least = linked.groupBy("root").agg(F.min("rep").alias("component"))
    linked = linked.join(least, "root").select("node", "component")
    return sketches, classes.join(linked, "node", "left").select("node", F.coalesce("component", "rep").alias("component_id"))
