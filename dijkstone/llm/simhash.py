"""SimHash near-dedup with multi-index hashing.

A fingerprint of 64 bits is the bitwise majority over the XXH64 values of a text's word shingles. Two fingerprints within
``radius`` bits agree up to ``radius // 2`` bits in one of their two 32-bit halves at least. So every distinct fingerprint
is in a table under both halves, each fingerprint asks for all values in the small Hamming ball around either half, and the
complete distance of what it meets is verified. Copies share a fingerprint and are one entry; documents get their class
back by a join that can be split. Links are never all pairs of documents, and no bucket is capped.

Defined results: null and empty texts have no shingles and fingerprint zero, which links like any other. A text of fewer
words than ``shingle`` is one shingle. Rows with a null id take part, but a component is named by its smallest id that is
not null (null if it has none). Repeated rows get equal results. Extra columns pass through; one that has the name of a
result column is replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dijkstone.llm.common import connected_components, in_small_batches, materialize, splittable_join

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text (UTF-8); words are parted by ASCII white space, A-Z count as a-z."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, total, counts = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    spans = list(zip(starts.tolist(), ends.tolist()))
    for at in range(0, total, _CHUNK):
        part = spans[at : at + _CHUNK]
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in part), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def rows(batches):
        for batch in batches:
            prints = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "print"])

    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, print): the fingerprint of each row as a signed long."""
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(_fingerprints(shingle), "id long, print long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column print) within ``radius`` bits."""
    ball = [0, *(sum(1 << i for i in bits) for n in range(1, radius // 2 + 1) for bits in combinations(range(32), n))]
    low = F.lit((1 << 32) - 1)
    halves = [F.struct(F.lit(k).alias("half"), v.alias("value")) for k, v in ((0, F.shiftrightunsigned("print", 32)), (1, F.col("print").bitwiseAND(low)))]
    halved = prints.select("print", F.explode(F.array(*halves)).alias("h")).select("print", "h.half", "h.value")
    table = halved.withColumnRenamed("print", "b")
    asked = halved.select(F.col("print").alias("a"), "half", F.explode(F.array(*[F.col("value").bitwiseXOR(F.lit(m)) for m in ball])).alias("value"))
    near = asked.join(table, ["half", "value"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return near.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for each row of ``docs``."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = rows.groupBy("print").agg(F.min("id").alias("least"))
    parts = connected_components(links(classes.select("print"), radius), "prints-cc").withColumnRenamed("id", "print")
    named = classes.join(parts, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = splittable_join(named, least, "component").select("print", "component_id")
    return rows.join(named, "print").select("id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def edges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of ids that join the documents of equal or near fingerprints to components; rows with a null id make none."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle).where("id is not null"), "prints")
    classes = rows.groupBy("print").agg(F.min("id").alias("least"))
    copies = splittable_join(rows, classes, "print").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    near = links(classes.select("print"), radius)
    for side in ("a", "b"):
        near = near.join(classes.select(F.col("print").alias(side), F.col("least").alias(f"id_{side}")), side)
    return copies.union(near.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without those whose component has a smaller id. Rows with a null id stay, as do repeated rows of one id."""
    copies = near_duplicates(docs, id_col, text_col, **how).where("id <> component_id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(copies, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
