"""Trees as adjacency lists: ancestors, nearest kinds, subtrees, paths.

The closure is built by pointer jumping: each round joins every node's farthest known ancestor to that ancestor's own, so a
tree of depth d takes log2(d) joins on the parent key, whatever its size. A round is written to the shared folder, which
cuts the lineage; rounds end when nothing new is found, and at ``max_depth``, which also ends cycles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dijkstone.sources.storage import discard, materialize


#: Levels of a walk that ends by itself; only a cycle would reach it.
ANY_DEPTH = 10_000


def ancestors(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", max_depth: int = 25) -> DataFrame:
    """(id, ancestor, depth): every ancestor of every node up to ``max_depth`` levels, the parent at depth 1."""
    first = nodes.where(F.col(parent_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(parent_col).alias("ancestor"), F.lit(1).alias("depth"))
    known, reach = [materialize(first, "ancestors")], 1
    while reach < max_depth:
        every = reduce(DataFrame.unionByName, known)
        beyond = every.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("__a"), F.col("depth").alias("__d"))
        far = every.where(F.col("depth") == reach).join(beyond, "ancestor")
        more = far.select("id", F.col("__a").alias("ancestor"), (F.col("depth") + F.col("__d")).alias("depth")).where(F.col("depth") <= max_depth)
        known.append(materialize(more, "ancestors"))
        if known[-1].isEmpty():
            break
        reach *= 2
    return reduce(DataFrame.unionByName, known)


def nearest_of_kind(nodes: DataFrame, kinds: list[str], keep: list[str], id_col: str = "id", parent_col: str = "parent_id", kind_col: str = "kind", max_depth: int = 20) -> DataFrame:
    """Per node, for each kind the nearest of that kind at or above it: one struct column a kind (id and ``keep``)."""
    up = ancestors(nodes, id_col, parent_col, max_depth)
    own = nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("ancestor"), F.lit(0).alias("depth"))
    named = nodes.where(F.col(kind_col).isin(kinds)).select(F.col(id_col).alias("ancestor"), F.col(kind_col).alias("__kind"), *[F.col(k).alias(f"__{k}") for k in keep])
    hits = own.unionByName(up).join(named, "ancestor")
    best = [
        F.min_by(F.struct(F.col("ancestor").alias("id"), *[F.col(f"__{k}").alias(k) for k in keep]), F.when(F.col("__kind") == kind, F.col("depth"))).alias(kind.lower())
        for kind in kinds
    ]
    return hits.groupBy("id").agg(*best)


def _levels(start: DataFrame, step, label: str, max_depth: int) -> list[DataFrame]:
    """``start`` and what ``step`` makes of each level in turn, written level by level, until one is empty."""
    levels = [start]
    for depth in range(1, max_depth + 1):
        here = materialize(step(levels[-1], depth), label)
        if here.isEmpty():
            discard(here)
            break
        levels.append(here)
    return levels


def climb(nodes: DataFrame, start: DataFrame, id_col: str = "id", parent_col: str = "parent_id", max_depth: int = 25) -> DataFrame:
    """(id, ancestor, depth) as in ``ancestors``, of the ids of ``start`` (column id) only: the work grows with their paths."""
    up = nodes.where(F.col(parent_col).isNotNull()).select(F.col(id_col).alias("ancestor"), F.col(parent_col).alias("__p"))
    own = start.select("id").distinct().select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    step = lambda level, depth: level.join(up, "ancestor").select("id", F.col("__p").alias("ancestor"), F.lit(depth).alias("depth"))
    return reduce(DataFrame.unionByName, _levels(own, step, "climb", max_depth)[1:], own.where("false"))


def subtree(nodes: DataFrame, roots: DataFrame, id_col: str = "id", parent_col: str = "parent_id", max_depth: int = ANY_DEPTH) -> DataFrame:
    """(root, id, depth): all nodes at or below each root (column root), walked down from the roots."""
    down = nodes.where(F.col(parent_col).isNotNull()).select(F.col(parent_col).alias("id"), F.col(id_col).alias("__c"))
    top = roots.select("root").distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("depth"))
    own = top.join(nodes.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").select("root", "id", "depth")
    step = lambda level, depth: level.join(down, "id").select("root", F.col("__c").alias("id"), F.lit(depth).alias("depth"))
    return reduce(DataFrame.unionByName, _levels(top, step, "subtree", max_depth)[1:], own)


def subtree_text(nodes: DataFrame, roots: DataFrame, text: str, order: str, separator: str = " ", id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Per root the texts of its subtree, by depth and order, joined."""
    rows = subtree(nodes, roots, id_col, parent_col).join(nodes.select(F.col(id_col).alias("id"), F.col(order).alias("__o"), F.col(text).alias("__t")), "id").where("__t is not null")
    return rows.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "__o", "id", "__t"))), lambda x: x["__t"]), separator).alias("text"))


def descendants_or(nodes: DataFrame, roots: DataFrame, kind: str, fallback: DataFrame, id_col: str = "id", parent_col: str = "parent_id", kind_col: str = "kind") -> DataFrame:
    """Descendants of a kind below each root; a root without any takes its rows (root, id) from ``fallback``."""
    found = subtree(nodes, roots, id_col, parent_col).where("depth > 0").join(nodes.where(F.col(kind_col) == kind).select(F.col(id_col).alias("id")), "id", "left_semi").select("root", "id")
    return found.unionByName(fallback.select("root", "id").join(found.select("root").distinct(), "root", "left_anti"))


def most_specific(hits: DataFrame, nodes: DataFrame, key: list[str], id_col: str = "id", parent_col: str = "parent_id", max_depth: int = 25) -> DataFrame:
    """Of the nodes hit for a key, those that aren't an ancestor of another one hit for it."""
    up = climb(nodes, hits.select(F.col(id_col).alias("id")), id_col, parent_col, max_depth).withColumnRenamed("id", id_col)
    covered = hits.select(*key, id_col).join(up, id_col).select(*key, F.col("ancestor").alias(id_col)).distinct()
    return hits.join(covered, [*key, id_col], "left_anti")


def heading_paths(nodes: DataFrame, heading: str, separator: str = " > ", id_col: str = "id", parent_col: str = "parent_id", max_depth: int = 20) -> DataFrame:
    """(id, path, depth): headings from the root to the node, without the empty ones."""
    up = ancestors(nodes, id_col, parent_col, max_depth)
    own = nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("ancestor"), F.lit(0).alias("depth"))
    named = own.unionByName(up).join(nodes.select(F.col(id_col).alias("ancestor"), F.col(heading).alias("__h")), "ancestor")
    rows = F.sort_array(F.collect_list(F.when(F.coalesce("__h", F.lit("")) != "", F.struct((-F.col("depth")).alias("d"), "__h"))))
    return named.groupBy("id").agg(F.array_join(F.transform(rows, lambda x: x["__h"]), separator).alias("path"), F.max("depth").alias("depth"))


def flag_subtrees(nodes: DataFrame, flagged: Column, name: str, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``nodes`` with a boolean: the node or one above it is flagged."""
    top = nodes.where(flagged).select(F.col(id_col).alias("root"))
    below = subtree(nodes, top, id_col, parent_col).select(F.col("id").alias(id_col)).distinct().withColumn(name, F.lit(True))
    return nodes.join(below, id_col, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def changed_with_ancestors(nodes: DataFrame, changed: Column, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Changed nodes and all above them: what a view of changes shows."""
    ids = nodes.where(changed).select(F.col(id_col).alias("id"))
    up = climb(nodes, ids, id_col, parent_col, ANY_DEPTH).select(F.col("ancestor").alias("id"))
    return nodes.join(ids.union(up).distinct().withColumnRenamed("id", id_col), id_col, "left_semi")


def roots_of(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id", max_depth: int = 50) -> DataFrame:
    """(id, root, depth): the topmost node above each; orphans, whose parent isn't there, are roots."""
    known = nodes.select(F.col(id_col).alias(parent_col)).distinct()
    sound = nodes.join(known, parent_col, "left_semi")
    up = ancestors(sound, id_col, parent_col, max_depth)
    top = up.groupBy("id").agg(F.max_by("ancestor", "depth").alias("root"), F.max("depth").alias("depth"))
    own = nodes.select(F.col(id_col).alias("id"))
    return own.join(top, "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def nested_order(nodes: DataFrame, order: str, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, root, depth, place): a sortable place of each node, so that ordering by it prints the tree."""
    up = ancestors(nodes, id_col, parent_col)
    own = nodes.select(F.col(id_col).alias("id"), F.col(id_col).alias("ancestor"), F.lit(0).alias("depth"))
    steps = own.unionByName(up).join(nodes.select(F.col(id_col).alias("ancestor"), F.col(order).alias("__o")), "ancestor")
    rows = F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("__o").alias("o"), F.col("ancestor").alias("a"))))
    return steps.groupBy("id").agg(F.max("depth").alias("depth"), F.array_join(F.transform(rows, lambda x: F.lpad(x["o"].cast("string"), 12, "0")), "/").alias("place"))


def annotation_articles(bindings: dict[str, DataFrame], articles: DataFrame) -> DataFrame:
    """(annotation, article, path): annotations bound over several paths, each climbed to its article."""
    out = None
    for tag, b in bindings.items():
        one = b.select("annotation", F.col("element").alias("id")).join(articles.select("id", "article"), "id").select("annotation", "article", F.lit(tag).alias("path"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def unique_labels(df: DataFrame, scope: list[str], label: str, order: str, name: str = "label_id") -> DataFrame:
    """Repeated labels of a scope get ``__2``, ``__3`` and so on."""
    n = F.row_number().over(Window.partitionBy(*scope, label).orderBy(order))
    return df.withColumn(name, F.when(n > 1, F.concat(F.col(label), F.lit("__"), n.cast("string"))).otherwise(F.col(label)))
