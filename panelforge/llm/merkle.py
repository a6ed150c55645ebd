"""Merkle manifest of a dataset: a tree of hashes for each source and one over the sources.

Every level is a self-join: each node sends its hash to the computed indices of its siblings (XOR for a binary tree,
the other slots of the run otherwise), nodes meet what was sent to their own index by equality, and the rows of
slot 0 emit the parents. Levels are written to the shared folder, so none is computed again. Proofs are handed
down: a node's proof is its own siblings and its parent's proof, joined by index, so nothing is gathered by tree.

A leaf is the hash of chosen columns: ``-`` for a null, else byte count, colon and value. Leaves of a source ascend by
id (nulls first), then by leaf. A null source is a tree of its own and comes first. A tree of one leaf is that leaf.
Repeated rows are leaves each. An empty table has no root and no rows. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import materialize
from panelforge.llm.ordering import ranked

FANOUT = 16


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def hash_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def sibling_indices(at: Column, n: Column, fanout: int) -> Column:
    """The indices of the other nodes of the run that node ``at`` of ``n`` stands in."""
    if fanout == 2:
        other = at.bitwiseXOR(F.lit(1).cast("long"))
        return F.when(other < n, F.array(other)).otherwise(F.array().cast("array<bigint>"))
    first = at - at % fanout
    return F.filter(F.transform(F.sequence(F.lit(0), F.least(F.lit(fanout), n - first) - 1), lambda slot: first + slot), lambda i: i != at)


def with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``before`` and ``after``: the joined hashes of a node's siblings on either side (a run holds ``fanout`` nodes at most)."""
    sent = nodes.where("n > 1").select("tree", F.col("at").alias("sender"), "hash", F.explode(sibling_indices(F.col("at"), F.col("n"), fanout)).alias("at"))
    met = sent.groupBy("tree", "at").agg(F.array_sort(F.collect_list(F.struct("sender", "hash"))).alias("siblings"))

    def side(keep) -> Column:
        own = F.transform(F.filter(F.coalesce("siblings", F.array().cast(met.schema["siblings"].dataType)), keep), lambda s: s["hash"])
        return F.aggregate(own, F.lit(b""), lambda joined, h: F.concat(joined, h))

    joined = nodes.join(met, ["tree", "at"], "left")
    return joined.select(*nodes.columns, side(lambda s: s["sender"] < F.col("at")).alias("before"), side(lambda s: s["sender"] > F.col("at")).alias("after"))


def parents(level: DataFrame, fanout: int) -> DataFrame:
    """The next level, from the first row of each run; trees that have come to one node end here."""
    firsts = level.where((F.col("n") > 1) & (F.col("at") % fanout == 0))
    up = hash_of(F.concat(hexed(F.col("hash")), hexed(F.col("after"))))
    return firsts.select("tree", F.floor(F.col("at") / fanout).alias("at"), F.ceil(F.col("n") / fanout).alias("n"), up.alias("hash"))


def forest(leaves: DataFrame, fanout: int, tag: str) -> list[DataFrame]:
    """The levels of all trees (tree, at, n, hash, before, after and what the leaves carry), each written once."""
    levels, widest = [], leaves.agg(F.max("n")).first()[0] or 0
    while not levels or widest > 1:
        if levels:
            widest = -(-widest // fanout)
        nodes = parents(levels[-1], fanout) if levels else leaves
        levels.append(materialize(with_siblings(nodes, fanout), f"{tag}-{len(levels)}"))
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """``tree`` and ``hash`` of the one node that each tree comes to."""
    return reduce(DataFrame.unionByName, (x.where("n = 1").select("tree", "hash") for x in levels))


def handed_down(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """The lowest level with ``path`` (the sides at each level upwards) and the other columns that ``above`` has for each tree."""
    shared = [c for c in above.columns if c not in ("tree", "path")]
    below: DataFrame | None = None
    for level in reversed(levels):
        found = level.where("n = 1").join(above, "tree")
        if below is not None:
            up = below.select("tree", F.col("at").alias("__up"), "path", *shared)
            inner = level.where("n > 1").withColumn("__up", F.floor(F.col("at") / fanout)).join(up, ["tree", "__up"])
            found = found.unionByName(inner.withColumn("path", F.concat(F.array(F.struct("before", "after")), "path")).drop("__up"))
        below = found
    return below


def folded(start: Column, path: Column) -> Column:
    """The hash that ``start`` and the sides of its ancestors come to, as hex text."""
    return F.aggregate(path, hexed(start), lambda node, s: F.sha2(F.concat(hexed(s["before"]), node, hexed(s["after"])).cast("binary"), 256))


def proof_text(path: Column) -> Column:
    return F.aggregate(path, F.lit(""), lambda joined, s: F.concat(joined, hexed(s["before"]), hexed(s["after"])))


def manifest(docs: DataFrame, source: str = "source", id_col: str = "doc_id", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of ``docs``: id, ``leaf``, ``subroot``, ``root`` and ``path``, the siblings' hashes at each level.

    ``changed`` has other values of some fields; ``changed_leaf`` is the leaf with them. Hashes are binary.
    """

    def leaf(values: dict[str, Column]) -> Column:
        return hash_of(F.concat(*(field(values.get(c, F.col(quoted(c)))) for c in fields)))

    tree = F.coalesce(F.concat(F.lit("s"), F.col(quoted(source)).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(quoted(id_col)).alias("id"), leaf({}).alias("hash"), leaf(changed or {}).alias("changed"), F.monotonically_increasing_id().alias("row"))
    leaves = ranked(materialize(rows, "leaves"), ["tree"], ["id", "hash", "row"], "ordered-leaves").drop("row")
    trees = forest(leaves, fanout, "tree")
    found = subroots(trees).select(F.col("tree").alias("source"), "hash")
    over = forest(ranked(found, [], ["source"], "subroots").withColumn("tree", F.lit("")), fanout, "root")
    root = subroots(over).first()
    root = F.lit(bytes(root["hash"]) if root else None).cast("binary")
    none = F.array().cast("array<struct<before:binary,after:binary>>")
    over = handed_down(over, subroots(over).select("tree", none.alias("path")), fanout)
    above = over.select(F.col("source").alias("tree"), F.col("hash").alias("subroot"), "path")
    below = handed_down(trees, above, fanout)
    return below.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", root.alias("root"), F.col("changed").alias("changed_leaf"), "path")
