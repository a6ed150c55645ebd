"""Prefix trie of conversations: one node for each distinct beginning, rolled up by centroid decomposition.

**Turns.** Each turn becomes the digest of its role and text. A beginning's identity is a chain of digests; a conversation
is cut into blocks of turns whose chains run side by side, and the blocks' ends are chained again, so a conversation of
any length is spread over tasks. Nodes are the groups of equal identities, made by partial aggregates.

**Rollup.** Sums over subtrees come from a centroid decomposition of the parent-edge forest. A node weighs as many as
its members, so a subtree's weight is known from the grouping: the turns of its members from there on. In a component
the nodes with half of its weight or more are a chain from its top; the lowest is the centroid. What lies at or below the
centroid is totalled and added to the chain, which is the path from the centroid to the top. Then the centroid goes,
each of its children becomes a component, and the chain's nodes lose its weight. Every component has at most half of
the weight before, so the rounds are as many as the logarithm of the turns, however deep or wide the trie is.
Components above a bound are split by Spark, a round for all of them; their number is at most ``PARTS`` by the bound, so
what is known of each is broadcast. Components below it are split to the end in the tasks, many at once, in numpy.

**Ends.** The ids that end at a node are sorted by range, packed many to a row and hashed as a stream.

A null role or text counts as empty. Turns are ordered by turn (null first), equal ones by their digests; repeated rows
are turns each. Rows without a conversation are left out. Empty tables give no nodes. Other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialize
from panelforge.llm.ordering import ranges, ranked

BLOCK_TURNS = 128
#: Components that Spark splits have more than this weight, and more than a ``PARTS``-th of all.
LEAST_WEIGHT, PARTS = 1024, 1 << 16
PACK_IDS = 4096
#: Nodes that a task takes at once, and a component more.
TASK_NODES = 50_000
ROOT = b""
#: What is known of a node while components are split.
NODE = ("node", "up", "comp", "depth", "weight", "leaves", "saved", "n_leaves", "saved_tokens")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, ``at`` (from 0), ``n`` (turns of the conversation), ``item`` (digest of role and text) and ``bytes`` of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    item = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", item.alias("item"), F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row")
    )
    return ranked(materialize(rows, "turns"), ["conv_id"], ["turn", "item", "row"], "ordered-turns").select("conv_id", "at", "n", "item", "bytes")


def rebuilt(turns: DataFrame, step: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, ``depth`` from 1, ``len`` of the rebuilt conversation, item, bytes) and conversations (conv_id, len).

    A conversation takes the first h turns of the one whose id is the multiple of ``step`` below, then its own from h on;
    h is the crc32 of its id modulo ``longest``. So a conversation gives at most ``step * longest`` turns to others.
    """
    base = F.col("conv_id") - F.col("conv_id") % step
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    convs = turns.where("at = 0").select("conv_id", "n", base.alias("base"), head.alias("h"))
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    taken = F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken)
    convs = materialize(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt-conversations")
    heads = turns.where((F.col("at") < longest) & (F.col("conv_id") % step == 0)).select(F.col("conv_id").alias("base"), "at", "item", "bytes")
    first = convs.where("taken > 0").join(heads, "base").where("at < taken").select("conv_id", (F.col("at") + 1).alias("depth"), "len", "item", "bytes")
    own = turns.where(F.col("at") >= head).join(convs.select("conv_id", "h", "taken", "len"), "conv_id")
    own = own.select("conv_id", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "len", "item", "bytes")
    return first.unionByName(own), convs.select("conv_id", "len")


def prefix_digests(items: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """``node`` and ``up``: digests of the items up to and before each row of ``items`` (conv_id, depth from 1, item and others).

    Rows of equal beginnings have equal digests. ``up`` is empty for the first.
    """
    kept = items.columns
    placed = items.withColumn("block", F.floor((F.col("depth") - 1) / block))
    placed = placed.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "depth").select("block", *kept)
    conv, at, item = (placed.columns.index(c) for c in ("conv_id", "block", "item"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, digest = None, b""
        for batch in batches:
            nodes, ups = [], []
            for key, i in zip(zip(batch.column(conv).to_pylist(), batch.column(at).to_pylist(), strict=True), batch.column(item).to_pylist(), strict=True):
                if key != run:
                    run, digest = key, b""
                ups.append(digest)
                digest = hashlib.sha256(digest + i).digest()
                nodes.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary()), pa.array(ups, pa.binary())], names=[*batch.schema.names, "node", "up"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", node binary, up binary"
    found = materialize(placed.mapInArrow(chained, schema), "chains")
    last = F.col("depth") % block == 0
    ends = found.where(last)
    if ends.isEmpty():
        return found.drop("block")
    # The ends of whole blocks are a sequence too. Its digests name the blocks' last rows, and later blocks start from them.
    ends = ends.select("conv_id", (F.col("block") + 1).alias("depth"), F.col("node").alias("item"))
    starts = prefix_digests(ends, block).select("conv_id", F.col("depth").alias("block"), F.col("node").alias("start"))

    def after(digest: Column) -> Column:
        return F.when(F.length(digest) == 0, F.col("start")).otherwise(F.unhex(F.sha2(F.concat("start", digest), 256)))

    later = found.where("block > 0").join(starts, ["conv_id", "block"])
    placed = found.where("block = 0").unionByName(later.select("block", *kept, after(F.col("node")).alias("node"), after(F.col("up")).alias("up")))
    named = placed.where(last).drop("node").withColumn("block", F.col("block") + 1).join(starts, ["conv_id", "block"]).withColumnRenamed("start", "node")
    return materialize(placed.where(~last).select(*kept, "node", "up").unionByName(named.select(*kept, "node", "up")), "prefixes")


def nodes_of(members: DataFrame, convs: DataFrame) -> DataFrame:
    """node, up, depth, conv_id (smallest member), n_convs, bytes of the last text, weight (turns of its members from it on)."""
    from_here = F.col("len") - F.col("depth") + 1
    inner = members.groupBy("node").agg(F.min("up").alias("up"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.sum(from_here).alias("weight"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") + 1).alias("weight")).where("n_convs > 0")
    nothing = F.lit(0).cast("long")
    root = root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("up"), nothing.alias("depth"), "conv_id", "n_convs", nothing.alias("bytes"), "weight")
    return inner.unionByName(root)


def with_family(nodes: DataFrame, crowded: int = 1000) -> DataFrame:
    """``parent_conv_id`` and ``n_children``. Parents of more than a ``crowded``-th of the nodes are broadcast, at most ``crowded`` rows."""
    kids = nodes.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    own = materialize(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "family")
    parents = own.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"), "n_children").where("n_children > 0")
    many = F.col("n_children") * crowded > own.count()
    hot = F.broadcast(parents.where(many).drop("n_children"))
    near = own.join(hot, "up", "left")
    rest = near.where("parent_conv_id is null").drop("parent_conv_id").join(parents.where(~many).drop("n_children"), "up", "left")
    return near.where("parent_conv_id is not null").unionByName(rest)


def rolled_up(nodes: DataFrame, members: DataFrame, least: int = LEAST_WEIGHT, parts: int = PARTS) -> DataFrame:
    """``node``, ``n_leaves`` and ``saved_tokens`` summed over each node's subtree."""
    own_saved = (F.col("n_convs") - 1) * F.col("bytes")
    nothing = F.lit(0).cast("long")
    large = nodes.select(
        "node", F.coalesce("up", F.lit(ROOT)).alias("up"), F.lit(ROOT).alias("comp"), "depth", "weight", (F.col("n_children") == 0).cast("long").alias("leaves"),
        own_saved.alias("saved"), nothing.alias("n_leaves"), nothing.alias("saved_tokens"), "conv_id", F.lit(None).cast("long").alias("total"),
    )
    whole = nodes.where("depth = 0").select("weight").first()
    whole = whole[0] if whole else 0
    bound = max(least, whole // parts)
    large = materialize(large.withColumn("total", F.lit(whole).cast("long")), "one-component")
    done, lookup = [large.where(F.lit(whole <= bound))], members.select("conv_id", "depth", "node", "up")
    while whole > bound:
        large = materialize(_split(large, lookup, bound), "component")
        done.append(large.where((F.col("total") <= bound) | F.col("total").isNull()))
        large = large.where(F.col("total") > bound)
        whole = large.agg(F.max("total")).first()[0] or 0
    small = reduce(DataFrame.unionByName, done)
    ready = small.where("comp is null").select("node", "n_leaves", "saved_tokens")
    open_ = small.where("comp is not null").select(*NODE).repartition("comp").sortWithinPartitions("comp")
    return ready.unionByName(open_.mapInArrow(_finished, "node binary, n_leaves long, saved_tokens long"))


def _split(large: DataFrame, lookup: DataFrame, bound: int) -> DataFrame:
    """One round: removes the centroid of every component of ``large``; a node that is done has no component any more."""
    chain = F.col("weight") * 2 >= F.col("total")
    lowest = F.max_by(F.struct("node", "depth", "weight"), "depth").alias("c")
    centroids = large.where(chain).groupBy("comp").agg(lowest).select("comp", F.col("c.node").alias("c"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight"))
    centroids = materialize(centroids, "centroids")
    placed = large.join(F.broadcast(centroids), "comp")
    # The child of the centroid above a node, if it lies below it: what its smallest member has at that depth.
    steps = lookup.join(F.broadcast(centroids.select(F.col("c").alias("up"))), "up").select("conv_id", F.col("depth").alias("step"), F.col("node").alias("child"), F.col("up").alias("c"))
    placed = placed.withColumn("step", F.col("c_depth") + 1)
    below = placed.where("depth >= step").join(steps, ["conv_id", "step", "c"], "left")
    above = placed.where("depth < step").withColumn("child", F.lit(None).cast("binary"))
    placed = materialize(below.unionByName(above), "placed")
    inside = F.col("child").isNotNull() | (F.col("node") == F.col("c"))
    totals = placed.where(inside).groupBy("comp").agg(F.sum("leaves").alias("t_leaves"), F.sum("saved").alias("t_saved"))
    heavy = placed.where((F.col("node") == F.col("child")) & (F.col("weight") > bound)).select("child", F.col("weight").alias("child_total"))
    placed = placed.join(F.broadcast(totals), "comp").join(F.broadcast(heavy), "child", "left")
    gone = F.col("node") == F.col("c")
    higher = chain & ~gone
    return placed.select(
        "node",
        "up",
        F.when(gone, None).when(F.col("child").isNotNull(), F.col("child")).otherwise(F.col("comp")).alias("comp"),
        "depth",
        (F.col("weight") - F.when(higher, F.col("c_weight")).otherwise(0)).alias("weight"),
        "leaves",
        "saved",
        (F.col("n_leaves") + F.when(chain, F.col("t_leaves")).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + F.when(chain, F.col("t_saved")).otherwise(0)).alias("saved_tokens"),
        "conv_id",
        F.when(gone, None).when(F.col("child").isNotNull(), F.coalesce("child_total", F.lit(0))).otherwise(F.col("total") - F.col("c_weight")).alias("total"),
    )


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits whole components, which come one after the other, to the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TASK_NODES:
            table = pa.Table.from_batches(held).combine_chunks()
            comp = table.column("comp").to_pylist()
            cut = next((i for i in range(len(comp) - 1, 0, -1) if comp[i] != comp[i - 1]), 0)
            if cut:
                yield _rolled(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield _rolled(pa.Table.from_batches(held))


def _rolled(table: pa.Table) -> pa.RecordBatch:
    node, up, comp = (table.column(c).to_pylist() for c in ("node", "up", "comp"))
    depth, weight, leaves, saved, n_leaves, saved_tokens = (table.column(c).to_numpy().copy() for c in ("depth", "weight", "leaves", "saved", "n_leaves", "saved_tokens"))
    index = {n: i for i, n in enumerate(node)}
    tops: dict[bytes, int] = {}
    part = np.array([tops.setdefault(c, len(tops)) for c in comp], dtype=np.int64)
    parent = np.array([-1 if n == c else index[u] for n, u, c in zip(node, up, comp, strict=True)], dtype=np.int64)
    decomposed(parent, part, depth, weight, leaves, saved, n_leaves, saved_tokens)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(n_leaves), pa.array(saved_tokens)], names=["node", "n_leaves", "saved_tokens"])


def decomposed(parent: np.ndarray, part: np.ndarray, depth: np.ndarray, weight: np.ndarray, leaves: np.ndarray, saved: np.ndarray, n_leaves: np.ndarray, saved_tokens: np.ndarray) -> int:
    """Adds each node's subtree sums to ``n_leaves`` and ``saved_tokens``, by centroids of all components at once; returns the rounds.

    ``parent`` is -1 for the top of a component, ``part`` its number, ``weight`` that of the node's subtree in it.
    """
    order = np.argsort(depth, kind="stable")
    rounds = 0
    while len(order):
        rounds += 1
        n = int(part.max()) + 1
        top = order[parent[order] < 0]
        total = np.zeros(n, dtype=np.int64)
        total[part[top]] = weight[top]
        chain = order[weight[order] * 2 >= total[part[order]]]
        centroid = np.full(n, -1, dtype=np.int64)
        centroid[part[chain]] = chain  # in the order of depth, so the lowest stays
        # Downwards, a level at a time: the child of the centroid that each node lies below.
        child = np.full(len(parent), -1, dtype=np.int64)
        steps = np.flatnonzero(np.diff(depth[order])) + 1
        for level in np.split(order, steps):
            level = level[parent[level] >= 0]
            above = parent[level]
            child[level] = np.where(centroid[part[level]] == above, level, child[above])
        gone = centroid[part[order]] == order
        inside = order[gone | (child[order] >= 0)]
        for values, sums in ((leaves, n_leaves), (saved, saved_tokens)):
            found = np.zeros(n, dtype=np.int64)
            np.add.at(found, part[inside], values[inside])
            sums[chain] += found[part[chain]]
        lost = weight[centroid[part[chain]]]
        higher = chain[centroid[part[chain]] != chain]
        weight[higher] -= lost[centroid[part[chain]] != chain]
        order = order[~gone]
        parent[order[child[order] == order]] = -1
        # New numbers: what lies below takes that of the child, the rest keeps the component's.
        label = np.where(child[order] >= 0, n + child[order], part[order])
        part[order] = np.unique(label, return_inverse=True)[1]
    return rounds


def ends_digests(convs: DataFrame, members: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the nodes at which conversations end."""
    ends = members.where("depth = len").select("node", "conv_id").unionByName(convs.where("len = 0").select(F.lit(ROOT).alias("node"), "conv_id"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (at != node or len(ids) >= PACK_IDS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = at
                ids.append(conv)
            if len(out) >= 1000:
                yield _rows(out, "node", "first", "ids")
                out = []
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
        if out:
            yield _rows(out, "node", "first", "ids")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is None or at != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) >= 1000:
                yield _rows(out, "node", "ends_sha256")
                out = []
        if state is not None:
            out.append((node, state.hexdigest()))
            yield _rows(out, "node", "ends_sha256")

    dealt = ends.repartitionByRange(ranges(convs), "node", "conv_id").sortWithinPartitions("node", "conv_id")
    packs = dealt.mapInArrow(packed, "node binary, first long, ids string")
    return packs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashed, "node binary, ends_sha256 string")


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {"node": pa.binary(), "first": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.string())) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names=list(names))


def prefix_trie(conversations: DataFrame, block: int = BLOCK_TURNS, least: int = LEAST_WEIGHT) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    items, convs = rebuilt(ordered_turns(conversations))
    members = prefix_digests(items, block)
    nodes = materialize(with_family(nodes_of(members, convs)), "nodes")
    found = nodes.join(rolled_up(nodes, members, least), "node").join(ends_digests(convs, members), "node", "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
