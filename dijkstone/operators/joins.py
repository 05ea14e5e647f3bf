"""Joins with particular semantics, each as equi-joins that can be shuffled on their keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chain(first: DataFrame, *steps: tuple[DataFrame, list[str], str]) -> DataFrame:
    """Equi-joins one after the other: (table, key columns, how)."""
    return reduce(lambda df, s: df.join(s[0], s[1], s[2]), steps, first)


def scoped_or_null(left: DataFrame, right: DataFrame, key: str, scope: str, scoped: bool = True) -> DataFrame:
    """Rows of equal key whose scope is equal, or null on the right (unscoped).

    An OR in a join condition can't be hashed, so it is the union of two equi-joins. ``scoped=False`` gives the plain join.
    """
    r = right.withColumnRenamed(scope, "__scope")
    if not scoped:
        return left.join(r, key).drop("__scope")
    named = left.join(r.where("__scope is not null").withColumnRenamed("__scope", scope), [key, scope])
    free = left.join(r.where("__scope is null").drop("__scope"), key)
    return named.select(*free.columns).unionByName(free)


def any_column(left: DataFrame, columns: list[str], right: DataFrame, right_key: str) -> DataFrame:
    """``right.key IN (a, b, c)``: the columns become rows, each distinct value once, and an equi-join follows."""
    value = F.explode(F.array_distinct(F.array_compact(F.array(*columns))))
    return left.withColumn("__v", value).join(right, F.col("__v") == F.col(right_key)).drop("__v")


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """``NOT IN``: nothing if the other side holds a null, and no row whose value is null (unless the other side is empty)."""
    facts = other.agg(F.count("*").alias("n"), F.count(other_column).alias("m")).select((F.col("n") > F.col("m")).alias("__has_null"), (F.col("n") == 0).alias("__none"))
    kept = df.join(other.select(F.col(other_column).alias(column)), column, "left_anti").crossJoin(F.broadcast(facts))  # one row
    return kept.where("__none or (not __has_null)").where(F.col("__none") | F.col(column).isNotNull()).select(*df.columns)


def lateral_first(left: DataFrame, right: DataFrame, key: str, order: list[Column], how: str = "left") -> DataFrame:
    """``LATERAL (... ORDER BY ... LIMIT 1)``: the first matching row of the right for each left row."""
    from dijkstone.operators.ranking import first_per_key

    return left.join(first_per_key(right, [key], order), key, how)


def ordered_lookup(spark, keys: list, table: DataFrame, key: str) -> DataFrame:
    """Rows for a list of keys in its order, with the misses (nulls) and repeats in it."""
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, keys))).alias("ord", key))
    return F.broadcast(asked).join(table, key, "left").orderBy("ord")


def ordered_requests(asked: DataFrame, table: DataFrame, key: str, position: str = "ord") -> DataFrame:
    """The same for a request table of any size."""
    return asked.join(table, key, "left").orderBy(position)


def as_of_pairs(before: DataFrame, after: DataFrame, keys: list[str], before_ts: str, after_ts: str, days: int) -> DataFrame:
    """Pairs of equal keys in which ``before`` lies at most ``days`` days before ``after``.

    Days are dealt into buckets as wide as the range, and a row of ``before`` is asked of its own bucket and the next: a busy
    key meets its rows of that time, not all of them, and is spread over its buckets."""
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / (days + 1))
    asked = before.withColumn("__bucket", F.explode(F.array(bucket(before_ts), bucket(before_ts) + 1)))
    met = asked.join(after.withColumn("__bucket", bucket(after_ts)), [*keys, "__bucket"]).drop("__bucket")
    gap = F.date_diff(F.col(after_ts), F.col(before_ts))
    return met.withColumn("gap_days", gap).where((F.col(before_ts) <= F.col(after_ts)) & gap.between(0, days))


def mutual_nearest(pairs: DataFrame, left_id: str, right_id: str, gap: str) -> DataFrame:
    """One-to-one pairs: for each right the nearest left, then for each left the nearest of those rights. Ties: smaller id."""
    w1 = Window.partitionBy(right_id).orderBy(gap, left_id)
    w2 = Window.partitionBy(left_id).orderBy(gap, right_id)
    once = pairs.withColumn("__n", F.row_number().over(w1)).where("__n = 1")
    return once.withColumn("__n", F.row_number().over(w2)).where("__n = 1").drop("__n")


def cases_in_tiers(requests: DataFrame, decisions: DataFrame, scope: str, number: str, ts: str, key: str, days: int) -> DataFrame:
    """(scope, start, end, tier): requests and their decisions, by case number where both have one, else by nearness in time.

    A number that has both is one case, from its first request to its first decision, if that isn't earlier; all its rows are
    claimed. Of what no such number claims, mutually nearest rows of a scope at most ``days`` days apart are a case."""
    first = lambda d, name: d.where(F.col(number).isNotNull()).groupBy(scope, number).agg(F.min(ts).alias(name))
    both = first(requests, "start").join(first(decisions, "end"), [scope, number])
    rest = lambda d, side: d.join(both.select(scope, number), [scope, number], "left_anti").select(scope, F.col(key).alias(f"__{side}"), F.col(ts).alias(side))
    near = mutual_nearest(as_of_pairs(rest(requests, "start"), rest(decisions, "end"), [scope], "start", "end", days), "__start", "__end", "gap_days")
    tier = lambda d, name: d.select(scope, "start", "end", F.lit(name).alias("tier"))
    return tier(both.where("start <= end"), "number").unionByName(tier(near, "nearest"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """For each left row the values of the latest right row at or before it: one sort of the union, no pairs."""
    l = left.withColumns({"__ts": F.col(left_ts), "__side": F.lit(1)} | {f"__{v}": F.lit(None) for v in values})
    r = right.select(*keys, F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.struct(*[F.col(v) for v in values]).alias("__hit"))
    both = l.drop(*(f"__{v}" for v in values)).withColumn("__hit", F.lit(None).cast(r.schema["__hit"].dataType)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__hit", F.last("__hit", ignorenulls=True).over(w)).where("__side = 1")
    return out.select(*left.columns, *[F.col("__hit")[v].alias(v) for v in values])


def equal_sets(df: DataFrame, owner: str, member: str) -> DataFrame:
    """(id, first_id, n_owners, n_members): each owner with the least owner of the same set and their number; linear in owners."""
    sets = set_classes(df, owner, member)
    alike = sets.groupBy("class_id").agg(F.min("id").alias("first_id"), F.count("*").alias("n_owners"))
    return sets.join(alike, "class_id").select("id", "first_id", "n_owners", "n_members")


def set_classes(df: DataFrame, owner: str, member: str) -> DataFrame:
    """One row an owner with the class of its set of members: owners of equal sets share a class, and no pairs are formed.

    The class is a hash of the sorted members, each with its length before it, so that no two sets read alike."""
    sets = df.groupBy(F.col(owner).alias("id")).agg(F.array_sort(F.collect_set(F.col(member).cast("string"))).alias("members"))
    said = F.transform("members", lambda m: F.concat(F.char_length(m).cast("string"), F.lit(":"), m))
    return sets.select("id", F.md5(F.array_join(said, ",").cast("binary")).alias("class_id"), F.size("members").alias("n_members"))


def shared_sets(df: DataFrame, scope: str, owner: str, member: str) -> DataFrame:
    """Per scope: how many owners share one and the same set of members."""
    sets = df.groupBy(scope, owner).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets.groupBy(scope, "members").agg(F.count("*").alias("n_owners")).where("n_owners > 1")


def junction(left: DataFrame, mid: DataFrame, right: DataFrame, left_key: str, right_key: str, out: list[str]) -> DataFrame:
    """Two hops over junction tables, distinct."""
    return left.join(mid, left_key).join(right, right_key).select(*out).distinct()


def paths_union(paths: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The union of several ways to resolve a reference, each tagged, duplicates removed."""
    return reduce(DataFrame.unionByName, [p.select(*columns).withColumn("path", F.lit(tag)) for tag, p in paths.items()]).distinct()


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side) with side ``missing`` (only in a) or ``extra`` (only in b)."""
    ka, kb = a.select(key).distinct(), b.select(key).distinct()
    return ka.join(kb, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(kb.join(ka, key, "left_anti").withColumn("side", F.lit("extra")))


def resolve_references(refs: DataFrame, targets: DataFrame, ref: str, target_key: str, hop: str, resolved: str, fallback: Column) -> DataFrame:
    """Fill ``resolved``: what is set stays, else a direct hit, else a hit through the row that ``hop`` names, else ``fallback``."""
    direct = targets.select(F.col(target_key).alias("__t1"), F.lit(True).alias("__d"))
    via = refs.select(F.col("ref_id").alias("__hop"), F.col(ref).alias("__via")).where("__hop is not null")
    second = targets.select(F.col(target_key).alias("__t2"), F.lit(True).alias("__v"))
    out = refs.join(direct, F.col(ref) == F.col("__t1"), "left").join(via, F.col(hop) == F.col("__hop"), "left").join(second, F.col("__via") == F.col("__t2"), "left")
    value = F.coalesce(F.col(resolved), F.when(F.col("__d"), F.col(ref)), F.when(F.col("__v"), F.col("__via")), fallback)
    return out.withColumn(resolved, value).select(*refs.columns)


def regressed(active: DataFrame, old: DataFrame, keys: list[str], text: str, least: int = 30) -> DataFrame:
    """Active rows whose text is empty or short though an inactive version of the same element had one."""
    had = old.where(F.length(text) > least).select(*keys).distinct()
    return active.where(F.coalesce(F.length(text), F.lit(0)) <= least).join(had, keys, "left_semi")


def guarded_edges(edges: DataFrame, ends: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Edges whose ends exist: column of the edge to (table, its key)."""
    for column, (table, key) in ends.items():
        edges = edges.join(table.select(F.col(key).alias(column)).distinct(), column, "left_semi")
    return edges


def same(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets: the difference is empty both ways. For checking a rewrite."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
