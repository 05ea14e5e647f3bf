"""Aggregations, facets and reports. All are partial before the shuffle unless they say otherwise."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dijkstone.operators.predicates import Filters


def count_tuples(*columns: str) -> Column:
    """``count(DISTINCT (a, b))``: a row with a null member counts, as a row value does in SQL."""
    return F.count_distinct(F.struct(*columns))


def text_list(column: str, separator: str = " | ", where: Column | None = None) -> Column:
    """Distinct texts of a group in order, joined."""
    c = F.when(where, F.col(column)) if where is not None else F.col(column)
    joined = F.array_join(F.array_sort(F.collect_set(c)), separator)
    return F.when(F.count(c) > 0, joined)


def ordered_lists(order: str, *columns: str) -> dict[str, Column]:
    """Parallel arrays of several columns, all in one order."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return {c: rows[c] for c in columns}


def percent(part: Column, of: Column, digits: int = 1) -> Column:
    """A share in per cent, half up; null if there is nothing."""
    return F.round(F.lit(100).cast("decimal(20,0)") * part.cast("decimal(20,0)") / F.nullif(of, F.lit(0)).cast("decimal(20,0)"), digits).cast("double")


def quartiles(column: str) -> list[Column]:
    """percentile_disc at 0.25, 0.5, 0.75 and percentile_cont at 0.5."""
    disc = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})").alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))]
    return [*disc, F.percentile(column, 0.5).alias("median")]


def histogram(df: DataFrame, column: str, width: int, last: int) -> DataFrame:
    """Counts per bin of ``width`` units; the last bin is open, empty bins are there with 0."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.least(F.expr(f"{column} div {width}"), F.lit(last)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def threshold_ladder(df: DataFrame, group: str, column: str, asked: int, ladder: tuple[int, ...] = (30, 10, 5, 1)) -> DataFrame:
    """Groups with at least ``asked`` rows; if there are none, the next lower rung that has any. One aggregation.

    The rung is found by an aggregate of one row, not by asking again and again.
    """
    rungs = [asked, *(t for t in ladder if t < asked)]
    counted = df.groupBy(group).agg(F.count("*").alias("n"), F.percentile(column, 0.5).alias("median"))
    most = counted.agg(F.max("n").alias("most"))
    rung = F.coalesce(*[F.when(F.col("most") >= t, F.lit(t)) for t in rungs])
    return counted.crossJoin(F.broadcast(most.select(rung.alias("threshold")))).where("n >= threshold")  # one row


def facets(df: DataFrame, dims: list[str], filters: Filters, exclude_own: bool = False, top: int = 100) -> DataFrame:
    """(dim, value, n): counts of the values of each dimension, the ``top`` most frequent, nulls left out.

    One pass: each row is turned into one entry per dimension whose filters it meets, and entries are pre-aggregated. With
    ``exclude_own`` a dimension's own choice doesn't restrict its own counts.
    """
    entry = [F.when(filters.predicate(without=d if exclude_own else None), F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"))) for d in dims]
    some = reduce(lambda a, b: a | b, [filters.predicate(without=d) for d in dims]) if exclude_own else filters.predicate()
    entries = df.where(some).select(F.explode(F.array_compact(F.array(*entry))).alias("e")).select("e.dim", "e.value").where("value is not null")
    counted = entries.groupBy("dim", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dim").orderBy(F.desc("n"), "value")
    return counted.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top).drop("__n")


def having(df: DataFrame, keys: list[str], counts: dict[str, Column], condition: str) -> DataFrame:
    """GROUP BY with counts of rows that meet conditions, and a HAVING on those counts."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in counts.items()]).where(condition)


def rollup_with_parent(facts: DataFrame, key: str, parents: DataFrame, extra: DataFrame, name: str) -> DataFrame:
    """A scalar subquery per group: counts of another table, aggregated first and joined, 0 where there is none."""
    more = extra.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(facts, key, "left").join(more, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


#: Bytes of joined parts in one row: small enough that an Arrow batch of 10,000 rows stays at some 40 MB.
_CHUNK_BYTES = 4096


def _runs(batches, scopes: int):
    """The rows of sorted Arrow batches by scope, as they come: (scope, rows), and the types of the columns."""
    types = []

    def rows():
        for batch in batches:
            types[:] = batch.schema.types
            yield from zip(*(c.to_pylist() for c in batch.columns))

    return groupby(rows(), key=lambda r: r[:scopes]), types


def _as_batches(rows, types, names: list[str], at_most: int = 1_000):
    while part := list(islice(rows, at_most)):
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*part), types())], names=names)


def _join_parts(scopes: int, names: list[str]):
    """(scope, key, part) in order to (scope, first key, place, chunk of joined parts or null, rows)."""

    def chunks(runs):
        for scope, rows in runs:
            held, size, n, first = [], 0, 0, None
            place = 0
            for r in rows:
                if n == 0:
                    first = r[scopes]
                n += 1
                if r[scopes + 1] is not None:
                    held.append(r[scopes + 1].encode())
                    size += len(held[-1]) + 1
                if size >= _CHUNK_BYTES:
                    yield *scope, first, place, b"|".join(held), n
                    held, size, n, place = [], 0, 0, place + 1
            if n:
                yield *scope, first, place, b"|".join(held) if held else None, n

    def run(batches):
        runs, types = _runs(batches, scopes)
        yield from _as_batches(chunks(runs), lambda: [*types[: scopes + 1], pa.int64(), pa.binary(), pa.int64()], names)

    return run


def _hash_chunks(scopes: int, names: list[str]):
    """Chunks in order to (scope, hash, rows): MD5 takes them one after the other, so no scope is ever held whole."""

    def hashes(runs):
        for scope, rows in runs:
            digest, n, any_yet = hashlib.md5(usedforsecurity=False), 0, False
            for *_, chunk, m in rows:
                n += m
                if chunk is not None:
                    digest.update(b"|" + chunk if any_yet else chunk)
                    any_yet = True
            yield *scope, digest.hexdigest(), n

    def run(batches):
        runs, types = _runs(batches, scopes)
        yield from _as_batches(hashes(runs), lambda: [*types[:scopes], pa.string(), pa.int64()], names)

    return run


def content_hash(df: DataFrame, scope: list[str], key: str, text: str) -> DataFrame:
    """MD5 of ``key:text`` parts joined by a pipe in order of the key, per scope.

    No row or task holds the parts of a scope: they are dealt out and sorted by ranges of scope and key, neighbours are
    joined to chunks, and a scope's chunks are hashed as a stream. That stream is one task a scope, as MD5 is sequential.
    """
    k, n = F.col(key).alias("__key"), len(scope)
    parts = df.select(*scope, k, F.concat(F.col(key).cast("string"), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).alias("__part"))
    kinds = parts.schema.fields
    ordered = parts.repartitionByRange(*scope, "__key").sortWithinPartitions(*scope, "__key", "__part")
    chunked = T.StructType([*kinds[: n + 1], T.StructField("__place", T.LongType()), T.StructField("__chunk", T.BinaryType()), T.StructField("__n", T.LongType())])
    chunks = ordered.mapInArrow(_join_parts(n, chunked.names), chunked).repartition(*scope).sortWithinPartitions(*scope, "__key", "__place")
    hashed = T.StructType([*kinds[:n], T.StructField("hash", T.StringType()), T.StructField("n", T.LongType())])
    return chunks.mapInArrow(_hash_chunks(n, hashed.names), hashed)


def notable(df: DataFrame, facts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """(fact, name, value): for each fact the name with the greatest value, ties to the smaller name. One pass."""
    rows = [F.struct(F.lit(f).alias("fact"), n.cast("string").alias("name"), v.cast("double").alias("value")) for f, (n, v) in facts.items()]
    long = df.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("value is not null")
    w = Window.partitionBy("fact").orderBy(F.desc("value"), "name")
    return long.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def dominant(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The most frequent value per key; of equally frequent ones the one seen first in ``order``."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "__first", value)
    return counted.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, value, "n")


def merge_hits(hits: DataFrame, key: list[str], score: str, word: str, field: str, part: str, article: str) -> DataFrame:
    """Per object: the greatest score, each (word, field) once with its greatest part, and its distinct articles in order."""
    by_word = hits.groupBy(*key, word, field).agg(F.max(part).alias("part"))
    words = by_word.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(word, field, "part"))).alias("words"))
    rest = hits.groupBy(*key).agg(F.max(score).alias("score"), F.array_sort(F.collect_set(article)).alias("articles"))
    return rest.join(words, key)


def table_totals(spark, names: list[str], path: str) -> DataFrame:
    """(table, n): exact row counts, from Parquet footers; null for a table that isn't there."""
    out = None
    for name in names:
        try:
            one = spark.read.parquet(f"{path}/{name}.parquet").agg(F.count("*").alias("n"))
        except Exception as e:  # only a missing path counts as missing
            if "PATH_NOT_FOUND" not in str(e):
                raise
            one = spark.range(1).select(F.lit(None).cast("long").alias("n"))
        one = one.select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
