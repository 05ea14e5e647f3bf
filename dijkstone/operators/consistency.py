"""Do texts and objects say the same? Signals and their classes; the names in texts are found by ``names``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consistency_class(annotated: Column, referenced: Column, named: Column, targets_match: Column, not_annotatable: Column) -> Column:
    """One of seven classes; the order of the branches decides, and an unknown reference counts differently in each.

    annotated and named are never null; referenced and targets_match may be.
    """
    unsure_yes, unsure_no = F.coalesce(referenced, F.lit(True)), F.coalesce(referenced, F.lit(False))
    return (
        F.when(not_annotatable, "niet_annoteerbaar")
        .when(annotated & unsure_no & (targets_match == F.lit(False)), "tegenstrijdige_doelen")
        .when(annotated & unsure_yes & named, "consistent_aanwezig")
        .when(~annotated & named, "vermoedelijk_vergeten_annotatie")
        .when(~annotated & unsure_no, "intioref_zonder_annotatie_of_naam")
        .when(annotated & ~unsure_no & ~named, "annotatie_zonder_naam_match")
        .when(annotated, "consistent_aanwezig")
        .otherwise("overig_inconsistent")
    )


def candidates_with_signals(signals: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Every pair that any signal names, with a flag for each signal."""
    every = reduce(DataFrame.unionByName, [s.select(*keys) for s in signals.values()]).distinct()
    for name, s in signals.items():
        every = every.join(s.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return every


def first_branches(branches: list[tuple[str, DataFrame]], keys: list[str], fallback: tuple[str, DataFrame], owner: str) -> DataFrame:
    """Annotations from several branches with their provenance; the fallback only for owners that no branch has."""
    out = reduce(DataFrame.unionByName, [d.select(*keys).withColumn("provenance", F.lit(n)) for n, d in branches]).distinct()
    name, rest = fallback
    missing = rest.select(*keys).distinct().join(out.select(owner).distinct(), owner, "left_anti").withColumn("provenance", F.lit(name))
    return out.unionByName(missing)


def dead_ends(found: DataFrame, links: list[DataFrame], key: str) -> DataFrame:
    """One row: distinct keys that can be found, and those of them that no table of links names."""
    linked = reduce(DataFrame.unionByName, [d.select(key) for d in links]).where(F.col(key).isNotNull()).distinct().withColumn("__l", F.lit(True))
    known = found.select(key).distinct().join(linked, key, "left")
    return known.agg(F.count("*").alias("n_found"), F.count_if(F.col("__l").isNull()).alias("n_dead"))
