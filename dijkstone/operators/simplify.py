"""Simpler polygons: fewer points with a bounded error, for a map's level or within a budget of characters.

``generalise`` keeps a point of a ring only where leaving it out would move the line by more than the tolerance (Douglas and
Peucker, with a stack of its own, so a ring's length is no limit). A closed ring is halved at the point farthest from its
first one. What is smaller than the tolerance both ways goes. Work is by row; a refresh redoes only rows whose source changed.

Defined results: null polygons have no size and go; within a budget they stay null. Rings of fewer than three points, or that
collapse to fewer, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dijkstone.operators.geo import visible_at, with_box
from dijkstone.sources.tables import scattered

#: Tolerances in pixels that are tried in turn, and the characters that a drawing may have.
LADDER, BUDGET = (0.5, 2.0, 8.0), 60_000
_POINTS = "array<array<struct<x:double,y:double>>>"


def _distance(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of points from the segment a-b."""
    d, v = b - a, points - a
    long = float(d @ d)
    if not long:
        return np.hypot(v[:, 0], v[:, 1])
    t = np.minimum(np.maximum(v @ d / long, 0), 1)
    return np.hypot(v[:, 0] - t * d[0], v[:, 1] - t * d[1])


def kept_points(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay; its ends do."""
    keep, todo = np.zeros(len(line), bool), [(0, len(line) - 1)]
    keep[[0, -1]] = True
    while todo:
        a, b = todo.pop()
        if b - a > 1:
            far = _distance(line[a + 1 : b], line[a], line[b])
            ties = np.flatnonzero(far == far.max())  # of equally far points the middle one, so that halves are even
            at = int(ties[len(ties) // 2])
            if far[at] > tolerance:
                keep[a + 1 + at] = True
                todo += [(a, a + 1 + at), (a + 1 + at, b)]
    return keep


def simpler(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring (its first point isn't repeated) with fewer points."""
    if len(ring) < 3:
        return ring[:0]
    half = int(np.hypot(*(ring - ring[0]).T).argmax())
    if not half:
        return ring[:0]
    back = np.concatenate((ring[half:], ring[:1]))
    keep = np.concatenate((kept_points(ring[: half + 1], tolerance)[:-1], kept_points(back, tolerance)[:-1]))
    return ring[keep] if keep.sum() > 2 else ring[:0]


def _rings(value, tolerance):
    rings = [simpler(np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2), tolerance) for r in value if r]
    return [[{"x": x, "y": y} for x, y in r.tolist()] for r in rings if len(r)]


def _mapped(df: DataFrame, rings: str, more: str, each):
    """(names, schema, function of Arrow batches): the other columns, and the rings and columns ``more`` that ``each`` makes of a
    row's rings and one further value."""
    names = [c for c in df.columns if c != rings]
    schema = T.StructType([*df.select(*names).schema, *T._parse_datatype_string(f"{rings} {_POINTS}{more}")])
    kinds = [pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), *[pa.float64()] * more.count("double")]

    def run(batches):
        for batch in batches:
            made = [each(*row) for row in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())]
            columns = [pa.array(x, k) for x, k in zip(zip(*made), kinds)] if made else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns], names=schema.names)

    return names, schema, run


def generalise(df: DataFrame, tolerance: float, rings: str = "rings") -> DataFrame:
    """``df`` without what is smaller than ``tolerance`` both ways, its rings simplified."""
    box = ("min_x", "min_y", "max_x", "max_y")
    seen = visible_at(with_box(df.drop(*box), rings), tolerance).drop(*box)
    names, schema, run = _mapped(seen, rings, "", lambda value, _: (None if value is None else _rings(value, tolerance),))
    return scattered(seen.select(*names, F.col(rings).cast(_POINTS), F.lit(0.0).alias("__none"))).mapInArrow(run, schema)


def _characters(rings) -> int:
    return sum(len(f"{p['x']:.1f},{p['y']:.1f} ") for r in rings for p in r)


def within_budget(df: DataFrame, pixel: str, rings: str = "rings", budget: int = BUDGET) -> DataFrame:
    """``df`` with rings simplified by the first tolerance of the ladder (in pixels; the column ``pixel`` has a pixel's width)
    at which a row is drawn in ``budget`` characters, else by the last; and that tolerance in pixels."""

    def each(value, width):
        if value is None or width is None:
            return value, None
        for step in LADDER:
            made = _rings(value, step * width)
            if _characters(made) <= budget:
                break
        return made, step

    given = df.drop("tolerance")
    names, schema, run = _mapped(given, rings, ", tolerance double", each)
    return scattered(given.select(*names, F.col(rings).cast(_POINTS), F.col(pixel).cast("double").alias("__pixel"))).mapInArrow(run, schema)


def source_hash(rings: str = "rings"):
    return F.md5(F.to_json(F.col(rings)))


def refreshed(stored: DataFrame, current: DataFrame, key: str, tolerance: float, rings: str = "rings") -> DataFrame:
    """``stored`` (key, source_hash, rings) after changes of the source: rows of the same hash stay as they are, others are made
    again, and those whose source is gone or too small go."""
    hashed = current.select(key, F.col(rings).cast(_POINTS).alias(rings)).withColumn("source_hash", source_hash(rings))
    same = stored.join(hashed.select(key, "source_hash"), [key, "source_hash"], "left_semi").select(key, "source_hash", rings)
    new = hashed.join(stored.select(key, "source_hash"), [key, "source_hash"], "left_anti")
    return same.unionByName(generalise(new, tolerance, rings).select(key, "source_hash", rings))
