"""First rows, ranks, paging and their tie-breaks. Every order given here should end in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``DISTINCT ON (keys) ... ORDER BY order``. The planner keeps one row a task and key before the shuffle (group limit)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_per_bucket(df: DataFrame, bucket: str, order: list[Column], limits: dict[str, int] | int, default: int = 5, rank: str = "rank") -> DataFrame:
    """The first rows of each bucket; buckets may have their own limits."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    if isinstance(limits, int):
        return ranked.where(F.col(rank) <= limits)
    most = F.lit(default)
    for name, n in limits.items():
        most = F.when(F.col(bucket) == name, n).otherwise(most)
    return ranked.where(F.col(rank) <= max([default, *limits.values()])).where(F.col(rank) <= most)


def distinct_then_rank(df: DataFrame, distinct: list[str], tie: list[Column], bucket: str, order: list[Column], n: int) -> DataFrame:
    """Duplicates go first, so they use up no rank."""
    return top_per_bucket(first_per_key(df, distinct, tie), bucket, order, n)


def remove_duplicates(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows equal in ``keys`` (null equals null) only the first stays."""
    return first_per_key(df, keys, order)


def two_rankings(df: DataFrame, group: str, score: Column, tie: list[Column], cap: int, k: int) -> DataFrame:
    """Ranks within the group and over all: the best half over all, then round robin over groups, at most ``cap`` of each.

    The overall rank needs one order over everything, so only the best ``cap`` of every group go into it.
    """
    within = df.withColumn("group_rank", F.row_number().over(Window.partitionBy(group).orderBy(score.desc(), *tie))).where(F.col("group_rank") <= cap)
    top = within.orderBy(score.desc(), *tie).limit(k * cap)
    ranked = top.withColumn("overall_rank", F.row_number().over(Window.orderBy(score.desc(), *tie)))
    half = k // 2
    first = F.when(F.col("overall_rank") <= half, F.col("overall_rank")).otherwise(F.lit(half) + 1)
    return ranked.orderBy(first, F.when(F.col("overall_rank") > half, F.col("group_rank")).otherwise(0), "overall_rank").limit(k)


def case_rank(column: str, order: list[str]) -> Column:
    """Position of a value in a fixed order; other values last."""
    out = F.lit(len(order) + 1)
    for i, v in reversed(list(enumerate(order, 1))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


def prefer(column: str, order: list[str]) -> Column:
    """``array_position`` of a value in a list of preferences; values not in it last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(at > 0, at).otherwise(len(order) + 1)


#: Sort modes by name: (column, ascending). The unique id ends each.
def sort_by(df: DataFrame, modes: dict[str, tuple[str, bool]], mode: str, unique: str) -> DataFrame:
    """Only listed modes are allowed; nulls come last either way."""
    column, up = modes[mode]
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if up else c.desc_nulls_last(), unique)


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def capped(df: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, bool]:
    """The first ``n`` rows, and whether there are more."""
    more = df.limit(n + 1).count() > n
    return df.orderBy(*order).limit(n), more


def capped_count(df: DataFrame, cap: int) -> DataFrame:
    """One row: the count up to ``cap``, and whether there are more. Reads no more rows than it needs."""
    return df.limit(cap + 1).agg(F.count("*").alias("n")).select(F.least("n", F.lit(cap)).alias("total"), (F.col("n") > cap).alias("total_capped"))


def version_key(column: Column) -> Column:
    """Numbers of what follows ``@``, compared one by one as numbers: 10-0 comes after 9-0."""
    return F.transform(F.regexp_extract_all(F.element_at(F.split(column, "@"), -1), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))


def stagnation(runs: DataFrame, by: list[str], order: str, value: str, n: int = 3, drop: float = 0.1) -> DataFrame:
    """Signals per run: it lost more than ``drop`` of the previous value; it and the ``n - 1`` before it didn't grow."""
    w = Window.partitionBy(*by).orderBy(order)
    grown = F.col(value) - F.lag(value).over(w)
    out = runs.withColumns({"growth": grown})
    still = F.sum(F.when(F.coalesce(F.col("growth"), F.lit(1)) <= 0, 1).otherwise(0)).over(w.rowsBetween(-(n - 1), 0))
    return out.withColumns(
        {"dropped": F.coalesce(F.col("growth") < -drop * F.lag(value).over(w), F.lit(False)), "stagnant": still >= n}
    )


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 1) -> DataFrame:
    """A repeatable random sample of each group: the rows of the least hash."""
    return top_per_bucket(df, group, [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], n)
