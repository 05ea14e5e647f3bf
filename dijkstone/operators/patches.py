"""Patches of document trees: an adjacency table after the additions, changes and removals of one or more versions.

Within a version the order of patches plays no part: of several for one node a removal counts before a change and that before
an addition, and of equal ones the one with the greatest values. Removing a node removes what is below it, but for nodes that
the same version puts elsewhere, which take along what is below them. A patch whose parent isn't in the tree afterwards is
dropped with what hangs on it. A change of an unknown node adds it. Rows with a null id are no nodes and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dijkstone.operators import trees
from dijkstone.sources.storage import materialize

#: Operations, and the actions of text nodes that stand for them.
ADD, CHANGE, REMOVE = "toevoegen", "wijzigen", "verwijderen"
ACTIONS = {"voegtoe": ADD, "nieuweContainer": ADD, "verwijder": REMOVE, "verwijderContainer": REMOVE}
#: What an item without an operation means by its kind; other kinds are context and are skipped.
DEFAULTS = {"annotatie": ADD, "locatie": ADD}


def operation(action):
    """The operation that a text node's action (a column) stands for; of other actions a change, of none null."""
    out = F.when(action.isNotNull(), CHANGE)
    for name, op in ACTIONS.items():
        out = F.when(action == name, op).otherwise(out)
    return out


def with_defaults(items: DataFrame, kind: str, op: str, defaults: dict[str, str] = DEFAULTS) -> DataFrame:
    """``items`` with the default of their kind where they have no operation; those of kinds without one are left out."""
    default = F.lit(None).cast("string")
    for name, value in defaults.items():
        default = F.when(F.col(kind) == name, value).otherwise(default)
    return items.withColumn(op, F.coalesce(F.col(op), default)).where(F.col(op).isNotNull())


def inherited(bindings: DataFrame, rules: DataFrame, key: str, op: str) -> DataFrame:
    """``bindings`` with the operation of their rule; those of rules that are skipped are left out."""
    return bindings.drop(op).join(rules.where(F.col(op).isNotNull()).select(key, op).distinct(), key)


def replaced(stored: DataFrame, incoming: DataFrame, scopes: DataFrame, scope: list[str]) -> DataFrame:
    """Delete then insert: of the scopes that were delivered only the incoming rows remain, also where these are none."""
    return stored.join(scopes.select(*scope).distinct(), scope, "left_anti").unionByName(incoming.join(scopes.select(*scope).distinct(), scope, "left_semi").select(*stored.columns))


def patched(tree: DataFrame, patches: DataFrame, op: str = "op", id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``tree`` after one version; ``patches`` has its columns and the operation."""
    columns, others = tree.columns, [c for c in tree.columns if c != id_col]
    rank = F.when(F.col(op) == REMOVE, 3).when(F.col(op) == CHANGE, 2).when(F.col(op) == ADD, 1)
    ranked = patches.where(F.col(id_col).isNotNull()).withColumn("__rank", rank).where("__rank is not null")
    chosen = ranked.groupBy(id_col).agg(F.max(F.struct("__rank", *others)).alias("p"))
    chosen = materialize(chosen.select(id_col, "p.__rank", *(f"p.{c}" for c in others)), "patches")
    put, removed = chosen.where("__rank < 3").select(*columns), chosen.where("__rank = 3").select(F.col(id_col).alias("root"))

    tree = tree.where(F.col(id_col).isNotNull())
    kept = materialize(tree.join(put.select(id_col), id_col, "left_anti"), "kept")  # moved nodes aren't below their old parents any more
    dead = trees.subtree(kept, removed, id_col, parent_col).select(F.col("id").alias(id_col)).distinct()
    after = materialize(kept.join(dead, id_col, "left_anti").select(*columns).unionByName(put), "after")

    there = after.select(F.col(id_col).alias(parent_col)).distinct()
    loose = after.join(put.select(id_col), id_col, "left_semi").where(F.col(parent_col).isNotNull()).join(there, parent_col, "left_anti")
    lost = trees.subtree(after, loose.select(F.col(id_col).alias("root")), id_col, parent_col).select(F.col("id").alias(id_col)).distinct()
    return after.join(lost, id_col, "left_anti").select(*columns)


def replay(tree: DataFrame, patches: DataFrame, version: str = "version", op: str = "op", id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """``tree`` after all versions, in their order; a version is one pass over the tree."""
    for v in sorted(r[0] for r in patches.where(F.col(version).isNotNull()).select(version).distinct().collect()):
        tree = materialize(patched(tree, patches.where(F.col(version) == v).drop(version), op, id_col, parent_col), "version")
    return tree
