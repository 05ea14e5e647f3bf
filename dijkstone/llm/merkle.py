"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the roots of the groups.

A leaf is the SHA-256 of a row's fields; a field is its length in UTF-8 bytes, ``:`` and its value, or ``-`` if it is null.
The nodes of a level are numbered from 0 within their tree. The first node of every ``fanout`` consecutive ones (slot zero)
computes the indices of its siblings from their slots (by XOR in a binary tree, by addition otherwise), meets these in an
equijoin of the level with itself, and emits their parent. The paths back down are equijoins on the index of the parent.

A tree's leaves are numbered by one range sort over all trees: a partition numbers its own rows, and what lies before it in
the same tree is a sum over partitions. So a group that holds much of the table lies in many tasks; a key of the joins is
(tree, index), which at most ``fanout`` rows share.

Defined results: digests are joined and hashed as lower-case hex. A null group is a group of its own, before all others;
groups are ordered bytewise. Rows with a null id come before the others of their group; rows of equal ids are ordered by their
leaves, so repeated rows are neighbours with a leaf each. A tree of one leaf is that leaf. An empty table has no rows and no
root. Only the named columns are read, and the result has no others, whatever the names of the input's other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dijkstone.llm.common import discard, materialize

FANOUT = 16
_LEVELS = "array<struct<before:string,after:string>>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    """The digest of one row."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def _numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` (with tree) and each one's idx within its tree by ``order``, and the tree's number of rows as n."""
    at = F.monotonically_increasing_id()  # the number of the partition, and within it that of the row
    laid = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", at)
    laid = materialize(laid.withColumn("part", F.shiftright("at", 33)), label)
    parts = laid.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumns({"before": F.coalesce(before, F.lit(0)), "n": F.sum("size").over(tree)})
    idx = F.col("at") - F.col("first") + F.col("before")
    out = materialize(laid.join(parts, ["tree", "part"]).select(*rows.columns, idx.alias("idx"), "n"), label)
    discard(laid)
    return out


def _sibling(idx: Column, slot: Column, fanout: int) -> Column:
    return idx.bitwiseXOR(slot) if fanout == 2 else idx + slot


def _grown(leaves: DataFrame, fanout: int, label: str) -> list[DataFrame]:
    """The levels over ``leaves`` (tree, idx, n, digest), the lowest first: (tree, idx, n, digest, below), where below has
    the digests that a node was made of. A tree has no more nodes above the level where it has one."""
    levels, now = [], leaves
    while not now.where("n > 1").isEmpty():
        first = now.where((F.col("n") > 1) & (F.col("idx") % fanout == 0))
        slots = F.sequence(F.lit(0), F.least(F.lit(fanout), F.col("n") - F.col("idx")).cast("int") - 1)
        asked = first.select("tree", "idx", "n", F.explode(slots).alias("slot")).withColumn("sibling", _sibling(F.col("idx"), F.col("slot").cast("long"), fanout))
        met = asked.join(now.select("tree", F.col("idx").alias("sibling"), "digest"), ["tree", "sibling"])
        runs = met.groupBy("tree", "idx", "n").agg(F.sort_array(F.collect_list(F.struct("slot", "digest")))["digest"].alias("below"))
        up = runs.select("tree", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.sha2(F.array_join("below", ""), 256).alias("digest"), "below")
        levels.append(materialize(up, label))
        now = levels[-1].drop("below")
    return levels


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the one node on top of each tree."""
    out = leaves.where("n = 1").select("tree", "digest")
    for level in levels:
        out = out.union(level.where("n = 1").select("tree", "digest"))
    return out


def _with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """``leaves`` with path, the (before, after) of siblings from its own level up, and with the columns of ``tops`` (tree,
    path, others), whose path goes on from the root of the tree."""
    above, others = None, [c for c in tops.columns if c not in ("tree", "path")]
    slot = F.pmod("idx", F.lit(fanout)).cast("int")
    for level in [*reversed(levels), leaves]:
        own = [c for c in level.columns if c != "n"]
        out = level.where("n = 1").join(tops, "tree").select(*own, "path", *others)
        if above is not None:
            up = above.select("tree", F.col("idx").alias("parent"), F.col("below").alias("run"), F.col("path").alias("upper"), *others)
            met = level.where("n > 1").withColumn("parent", F.expr(f"idx div {fanout}")).join(up, ["tree", "parent"])
            step = F.struct(F.array_join(F.slice("run", F.lit(1), slot), "").alias("before"), F.array_join(F.slice("run", slot + 2, F.lit(fanout)), "").alias("after"))
            out = out.union(met.select(*own, F.concat(F.array(step), "upper").alias("path"), *others))
        above = out
    return above


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, digest, lambda d, x: F.sha2(F.concat(x["before"], d, x["after"]), 256))


def manifest(docs: DataFrame, id_col: str, group_col: str, fields: list[str], presented: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Rows (the id, leaf, subroot, root, path, proof_sha256, folded_root, verified), one for each row of ``docs``.

    path has the siblings (before, after) level by level up to the root and proof_sha256 their hash. folded_root is recomputed
    from the path and the leaf of the row as it is presented: ``presented`` has fields by name that are other than stored.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))  # null before all others
    given = [(presented or {}).get(c, F.col(c)) for c in fields]
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_of([F.col(c) for c in fields]).alias("digest"), (leaf_of(given) if presented else F.lit(None).cast("string")).alias("given"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")  # parts equal rows when dealt
    leaves = _numbered(rows, ["id", "digest", "row"], "numbered")
    discard(rows)
    levels = _grown(leaves.select("tree", "idx", "n", "digest"), fanout, "level")

    subroots = _roots(leaves, levels).select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    crowns = _numbered(subroots, ["of"], "subroots")
    crown_levels = _grown(crowns.select("tree", "idx", "n", "digest"), fanout, "crown")
    root = _roots(crowns, crown_levels).select("tree", F.array().cast(_LEVELS).alias("path"), F.col("digest").alias("root"))
    tops = materialize(_with_paths(crowns, crown_levels, root, fanout).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "tops")

    out = _with_paths(leaves, levels, tops, fanout)
    folded = fold(F.coalesce("given", "digest"), F.col("path"))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    out = out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
