"""Near copies by the Jaccard similarity of their sets of word shingles.

MinHash bands propose, and the exact similarity of the whole sets decides. A pair of similarity s shares a band with
probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8, and more above. No bucket is capped and none is paired with itself.
The members of a bucket are compared with its first hub, the one that meets most others in all its buckets, such as the text
that a family was copied from; those unlike it with the next ``HUBS - 1`` hubs; and those unlike all of these meet again, in
the same way, in the finer buckets of any two bands that they share. All that is linear in the members of buckets and joins
most families. Hubs leave pairs out, so what shares a bucket and isn't joined yet goes through an exact join (``_apart``):
every similar pair that shares a band is joined, directly or through others.

Defined results: words are parted by ASCII white space and A-Z count as a-z, as in ``simhash``. A text of fewer words than
``shingle`` is one shingle; null and empty texts have the same, empty set. Sets are equal where their 64-bit hashes are.
Texts that only rows with a null id have are compared with no others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dijkstone.llm import simhash
from dijkstone.llm.common import Powers, byte_slices, connected_components, discard, in_small_batches, materialize, mix64, run_hash, splittable_join, word_table

SHINGLE_WORDS = 5
#: Least similarity of near copies in tenths, so that it is compared exactly.
LEAST_TENTHS = 8
BANDS, ROWS = 20, 5
#: Members of a bucket that the others are compared with.
HUBS = 6
_CHUNK = 2_048

_odd = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One value a band: the least of each of its permutations of the shingles, hashed with the band's own factors."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        part = shingles[at : at + _CHUNK, None] * _odd[0]
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
    return mix64((mix64(least) * _odd[1]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _sets(shingle: int, whole: bool):
    """(id, text) to (id, key of the set, its bands, or with ``whole`` its sorted shingles)."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            ids, texts = batch.column(0), pc.ascii_lower(batch.column(1))
            for at, to in byte_slices(texts):
                *_, row, hashes = word_table(texts.slice(at, to - at), powers)
                bounds = np.searchsorted(row, np.arange(to - at + 1))
                keys, values = [], []
                for a, b in zip(bounds, bounds[1:]):
                    s = np.unique(run_hash(hashes[a:b], min(shingle, b - a))) if b > a else np.zeros(0, np.uint64)
                    keys.append(xxhash.xxh64_intdigest(s.tobytes()))
                    values.append(s.view(np.int64) if whole else bands_of(s))
                ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.array(np.array(keys, np.uint64).view(np.int64)), lists], names=["id", "key", "values"])

    return run


def sets(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE_WORDS, whole: bool = False) -> DataFrame:
    chosen = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return chosen.mapInArrow(_sets(shingle, whole), "id long, key long, values array<long>")


def _similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of keys whose sets are similar."""
    met = pairs.join(known.select(F.col("key").alias("a"), F.col("values").alias("x")), "a")
    met = met.join(known.select(F.col("key").alias("b"), F.col("values").alias("y")), "b")
    both, all_ = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    return met.where(10 * both >= LEAST_TENTHS * (all_ - both)).select("a", "b").distinct()


def _stars(members: DataFrame, known: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Members (bucket, key, weight) of buckets compared with the hubs of their bucket: the similar pairs (a, b), and the
    members that are unlike all hubs."""
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("weight"), "key"))  # tasks hand on HUBS rows a bucket
    hubs = members.withColumn("place", place).where(F.col("place") <= HUBS).groupBy("bucket")
    hubs = hubs.agg(F.sort_array(F.collect_list(F.struct("place", "key"))).alias("hubs")).where("size(hubs) > 1").select("bucket", F.col("hubs.key").alias("hubs"))
    left, near = materialize(splittable_join(members, hubs, "bucket"), label), []
    for pick in (F.slice("hubs", 1, 1), F.slice("hubs", 2, HUBS)):
        asked = left.select("bucket", "key", F.explode(pick).alias("hub")).where("key <> hub")
        near.append(materialize(_similar(asked.select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).distinct(), known), label))
        both = near[-1].union(near[-1].select("b", "a")).toDF("key", "hub")
        settled = asked.join(both, ["key", "hub"], "left_semi").select("bucket", "key").distinct()
        left = materialize(left.join(settled, ["bucket", "key"], "left_anti"), label)
    return near[0].union(near[1]), left.where(~F.array_contains("hubs", F.col("key"))).drop("hubs")


def _apart(members: DataFrame, near: DataFrame, known: DataFrame) -> DataFrame:
    """All similar pairs (a, b) of the keys that share a bucket with one that ``near`` doesn't join them to, unless it joins
    the two.

    Shingles have one order, rarest first. Two sets that have ``least`` shingles in common share one of the first
    size - least + 1 of either. Of similar sets the smaller holds 8/9 of its own in common, and the larger 8/10. At their
    first common shingle what follows must still suffice.
    """
    parts = connected_components(near, "near-cc").withColumnRenamed("id", "key")
    now = materialize(members.select("bucket", "key").join(parts, "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component"), "parts")
    mixed = now.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("bucket")
    asked = splittable_join(now, mixed, "bucket").select("key", "part").distinct()
    held = materialize(known.join(asked, "key").select("key", "part", F.size("values").alias("n"), F.explode("values").alias("shingle")), "apart")
    counts = held.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = splittable_join(held, counts, "shingle").groupBy("key", "part", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))  # a text's own
    shared = shared.withColumn("own", F.col("n") - F.size("s"))  # shingles of no other text come first
    most = F.greatest(F.expr(f"n - ({LEAST_TENTHS} * n + 9) div 10 + 1 - own"), F.lit(0)).cast("int")
    first = shared.select("key", "part", "n", "own", F.posexplode(F.slice("s", F.lit(1), most)).alias("i", "e")).select("key", "part", "n", F.expr("own + i").alias("at"), "e.shingle")
    first = materialize(first, "first")
    several = first.groupBy("shingle").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("shingle")
    first = materialize(splittable_join(first, several, "shingle"), "first")
    twice, both = 2 * LEAST_TENTHS, 10 + LEAST_TENTHS
    less = first.where(f"at <= n - ({twice} * n + {both - 1}) div {both}").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("key", "part", "n", "at")])
    more = first.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("key", "part", "n", "at")])
    fit = (F.col("part_a") != F.col("part_b")) & (F.struct("n_a", "key_a") < F.struct("n_b", "key_b")) & (10 * F.col("n_a") >= LEAST_TENTHS * F.col("n_b"))
    fit = fit & (both * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= LEAST_TENTHS * (F.col("n_a") + F.col("n_b")))
    pairs = less.join(more, "shingle").where(fit).select(F.greatest("key_a", "key_b").alias("a"), F.least("key_a", "key_b").alias("b")).distinct()
    return _similar(pairs, known)


def edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Pairs (a, b) of ids that join the near copies of ``docs`` to components."""
    rows = materialize(sets(docs, id_col, text_col, shingle), "bands")
    classes = rows.groupBy("key").agg(F.min("id").alias("least"))
    copies = splittable_join(rows.select("id", "key"), classes, "key").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))

    laid = rows.where("id is not null").select("key", F.explode("values").alias("bucket")).distinct()
    sizes = laid.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(splittable_join(laid, sizes, "bucket"), "shared")
    weights = shared.groupBy("key").agg(F.sum("size").alias("weight"))
    members = materialize(shared.drop("size").join(weights, "key"), "buckets")
    discard(shared)
    wanted = members.select("key").distinct().join(classes, "key").select(F.col("least").alias("id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_col).join(wanted, "id", "left_semi")
    known = materialize(sets(texts, "id", text_col, shingle, whole=True), "shingles")

    near, rest = _stars(members, known, "near")
    left = materialize(rest.groupBy("key", "weight").agg(F.sort_array(F.collect_set("bucket")).alias("buckets")), "left")  # a set of BANDS at most
    one = left.select("key", "weight", "buckets", F.posexplode("buckets").alias("i", "x"))
    finer = one.select("key", "weight", "x", F.explode(F.slice("buckets", F.col("i") + 2, F.size("buckets"))).alias("y"))
    last, _ = _stars(finer.select(F.xxhash64("x", "y").alias("bucket"), "key", "weight"), known, "last")
    by = lambda c: classes.select(F.col("key").alias(c), F.col("least").alias(f"id_{c}"))
    joined = near.union(last)
    named = joined.union(_apart(members, joined, known)).join(by("a"), "a").join(by("b"), "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return copies.union(named)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those of whose near copies one has a smaller id: near by similarity, or by the bits of ``simhash``,
    directly or through others. Rows with a null id stay, as do repeated rows of one id."""
    parts = connected_components(simhash.edges(docs, id_col, text_col).union(edges(docs, id_col, text_col)), "copies-cc")
    gone = parts.where("id <> component").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
