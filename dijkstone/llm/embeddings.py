"""Embedding near-dedup by an epsilon grid order join.

Cosine >= t between unit vectors means a distance of at most eps = sqrt(2 - 2t), in full and on any orthonormal directions.
Vectors are projected on their leading principal directions and sorted by grid cells of width eps there. Runs of the sorted
sequence are blocks; two blocks are joined only where vectors of one lie within eps of the other's bounding box, and within
such a join the intervals are halved recursively, leaving out intervals whose boxes are more than eps apart. What is left
at the bottom is compared by complete cosine in double precision.

Equal vectors of a label are one entry with a multiplicity. A block join returns counts of links and, for its links, a
spanning forest: all links are counted, none is lost to the components, and a dense group doesn't make all its pairs rows.
The number of blocks is at most ``max_blocks``, so their boxes can be broadcast; the directions come from a bounded sample
and steer only what is skipped.

Defined results: ids are whole numbers; labels of other types (text, fractions) are told apart by their 64-bit hashes. Null
labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing. Vectors of different lengths don't link. Repeated rows (also of one id) are vectors like others. A null id takes
part, and names a component only if that has no other. Extra columns pass through; one that has the name of a result
column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dijkstone.llm.common import connected_components, materialize, splittable_join

LEAST_COSINE = 0.98
DIRECTIONS = 8
SAMPLE = 20_000
BLOCK_ROWS, MAX_BLOCKS = 2_000, 4_096
_LEAF = 128
RESULTS = ("n_links", "component_id", "kept")


def principal_directions(vectors: DataFrame, column: str, key: str, n: int, size: int, k: int, sample: int) -> np.ndarray:
    """(size, k) orthonormal directions of the most variance in a sample of the unit vectors."""
    drawn = vectors.where(F.size(column) == size)
    share = min(1.0, 0.9 * sample / max(n, 1))
    drawn = drawn.where(F.pmod(F.xxhash64(F.col(key), F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample)
    x = np.array([r[0] for r in drawn.select(column).collect()], np.float64).reshape(-1, size)
    if len(x) < 2:
        return np.eye(size, min(k, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x -= x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, : min(k, size)]


def _project_rows(directions, eps: float, k: int):
    """Input: key, label, vector, many. Output: also cells, the projection and the doubles of the vector, packed."""

    def rows(batches):
        d = directions.value
        for batch in batches:
            cells, shadows, packed = [], [], []
            for v in batch.column(2).to_pylist():
                x = np.array(v, np.float64)
                y = np.zeros(k)
                if len(x) in d:
                    part = (x / np.linalg.norm(x)) @ d[len(x)]
                    y[: len(part)] = part
                cells.append(np.floor(y / eps).astype(int).tolist())
                shadows.append(y.tolist())
                packed.append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.int32())), pa.array(shadows, pa.list_(pa.float64())), pa.array(packed, pa.binary()), batch.column(3)],
                names=["key", "label", "cells", "shadow", "vector", "many"],
            )

    return rows


def _send_rows(boxes, eps: float):
    """Each vector to the joins of its block with itself and with every block whose box is within eps of it."""

    def rows(batches):
        block, low_label, high_label, low, high = boxes.value
        for batch in batches:
            own = batch.column("block").to_numpy()
            label = batch.column("label").to_numpy(zero_copy_only=False)
            shadow = np.array(batch.column("shadow").to_pylist(), np.float64).reshape(len(batch), -1)
            out_row, a, b = [], [], []
            for i in range(len(batch)):
                near = np.flatnonzero((low_label <= label[i]) & (label[i] <= high_label))
                gap = np.maximum(np.maximum(low[near] - shadow[i], shadow[i] - high[near]), 0)
                near = block[near[(gap * gap).sum(axis=1) <= eps * eps * (1 + 1e-9) + 1e-12]]
                out_row += [i] * len(near)
                a += np.minimum(near, own[i]).tolist()
                b += np.maximum(near, own[i]).tolist()
            t = batch.take(pa.array(out_row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *(t.column(c) for c in _SENT)], names=["a", "b", *_SENT])

    return rows


_SENT = ("block", "key", "label", "cells", "shadow", "vector", "many")


class _Forest:
    def __init__(self, n):
        self.up = np.arange(n)

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _join_intervals(shadow, unit, eps, least, left, right, found):
    """Recursive join of two intervals of the sorted sequence; ``found`` takes index pairs."""
    stack = [(left, right)]
    reach = eps * eps * (1 + 1e-9) + 1e-12
    while stack:
        (a0, a1), (b0, b1) = stack.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        x, y = shadow[a0:a1], shadow[b0:b1]
        gap = np.maximum(np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)), 0)
        if (gap * gap).sum() > reach:
            continue
        if a1 - a0 <= _LEAF and b1 - b0 <= _LEAF:
            i, j = np.nonzero(unit[a0:a1] @ unit[b0:b1].T >= least)
            i, j = i + a0, j + b0
            if (a0, a1) == (b0, b1):
                i, j = i[i < j], j[i < j]
            found(i, j)
            continue
        if (a0, a1) == (b0, b1):
            m = (a0 + a1) // 2
            stack += [((a0, m), (a0, m)), ((m, a1), (m, a1)), ((a0, m), (m, a1))]
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            stack += [((a0, m), (b0, b1)), ((m, a1), (b0, b1))]
        else:
            m = (b0 + b1) // 2
            stack += [((a0, a1), (b0, m)), ((a0, a1), (m, b1))]


def _join_group(eps: float, least: float):
    """Links of one pair of blocks: (key, links, root): linked vectors with multiplicity, and a parent in a spanning forest."""

    def join(pdf):
        import pandas as pd

        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        pdf = pdf.assign(size=pdf["vector"].map(len))
        out = []
        for _, part in pdf.groupby(["label", "size"], sort=False):
            cells = np.array(part["cells"].tolist())
            side = (part["block"].to_numpy() == b).astype(int) if a != b else np.zeros(len(part), int)
            order = np.lexsort((*cells.T[::-1], side))  # one block after the other, each in grid order
            part, side = part.iloc[order], side[order]
            x = np.frombuffer(b"".join(part["vector"]), np.float64).reshape(len(part), -1)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            shadow = np.array(part["shadow"].tolist())
            many, links, forest = part["many"].to_numpy(), np.zeros(len(part), np.int64), _Forest(len(part))

            def found(i, j):
                np.add.at(links, i, many[j])
                np.add.at(links, j, many[i])
                for p, q in zip(i.tolist(), j.tolist()):
                    p, q = forest.find(p), forest.find(q)
                    if p != q:
                        forest.up[max(p, q)] = min(p, q)

            cut = int((side == 0).sum())
            pairs = ((0, cut), (0, cut)) if a == b else ((0, cut), (cut, len(part)))
            _join_intervals(shadow, unit, eps, least, *pairs, found)
            hit = np.flatnonzero(links)
            key = part["key"].to_numpy()
            out.append(pd.DataFrame({"key": key[hit], "links": links[hit], "root": key[[forest.find(i) for i in hit]]}))
        return pd.concat(out)

    return join


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE, block_rows: int = BLOCK_ROWS, max_blocks: int = MAX_BLOCKS, directions: int = DIRECTIONS
) -> DataFrame:
    """``rows`` with n_links, component_id and kept (the row names its component)."""
    spark, eps = rows.sparkSession, float(np.sqrt(2 - 2 * least))
    rows = rows.drop(*(c for c in RESULTS if c not in (id_col, vector_col, label_col)))
    vector = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    whole = dict(rows.dtypes)[label_col] in ("tinyint", "smallint", "int", "bigint")
    label = F.col(label_col).cast("long") if whole else F.xxhash64(label_col)
    # 128 bits name a class of equal vectors of a label; unsound rows get none.
    name = F.struct(F.xxhash64(F.col(label_col), vector), F.xxhash64(vector, F.lit(7), F.col(label_col)))
    named = rows.withColumn("__class", F.when(sound, name.cast("struct<x:bigint,y:bigint>")))
    inside = named.where(F.col("__class").isNotNull())
    classes = inside.groupBy("__class").agg(F.min(F.col(id_col).cast("long")).alias("id"), F.count("*").alias("many"), F.first(label).alias("label"), F.first(vector).alias("vector"))
    classes = materialize(classes.withColumn("key", F.xxhash64("__class")), "vectors")
    n = classes.count()
    sizes = [r[0] for r in classes.groupBy(F.size("vector").alias("s")).count().orderBy(F.desc("count"), "s").limit(16).collect()]
    axes = {s: principal_directions(classes, "vector", "key", n, s, directions, SAMPLE) for s in sizes}
    handed = spark.sparkContext.broadcast(axes)
    projected = classes.select("key", "label", "vector", "many").mapInArrow(
        _project_rows(handed, eps, directions), "key long, label long, cells array<int>, shadow array<double>, vector binary, many long"
    )
    n_blocks = max(1, min(max_blocks, -(-n // block_rows)))
    grid = [F.col("cells")[i] for i in range(directions)]
    blocks = materialize(projected.repartitionByRange(n_blocks, "label", *grid, "key").withColumn("block", F.spark_partition_id()), "blocks")
    ends = [f(F.col("shadow")[i]).alias(f"{w}{i}") for i in range(directions) for f, w in ((F.min, "low"), (F.max, "high"))]
    boxes = blocks.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high"), *ends).orderBy("block").collect()  # one row a block
    table = spark.sparkContext.broadcast(
        (
            np.array([r["block"] for r in boxes], np.int64),
            np.array([r["low"] for r in boxes], np.int64),
            np.array([r["high"] for r in boxes], np.int64),
            *(np.array([[r[f"{w}{i}"] for i in range(directions)] for r in boxes], np.float64).reshape(len(boxes), directions) for w in ("low", "high")),
        )
    )
    sent = blocks.mapInArrow(_send_rows(table, eps), "a int, b int, block int, key long, label long, cells array<int>, shadow array<double>, vector binary, many long")
    linked = materialize(sent.groupBy("a", "b").applyInPandas(_join_group(eps, least), "key long, links long, root long"), "links")
    counts = linked.groupBy("key").agg(F.sum("links").alias("links"))
    parts = connected_components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")), "vectors-cc").select(F.col("id").alias("key"), "component")
    told = classes.select("__class", "key", "id", "many").join(counts, "key", "left").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least_id = told.groupBy("component").agg(F.min("id").alias("component_id"))
    told = splittable_join(told, least_id, "component").select("__class", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    out = named.join(told, "__class", "left")
    own = F.col(id_col).cast("long")
    component = F.when(F.col("__class").isNull(), own).otherwise(F.col("component_id"))
    return out.select(*rows.columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", own.eqNullSafe(F.col("component_id")))
