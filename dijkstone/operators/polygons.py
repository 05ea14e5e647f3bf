"""Polygons in pieces: subdivision, quadtree joins, and unions without overlap.

A polygon is an array of rings (array of struct<x,y>, the last point joined to the first) under the even-odd rule, so holes are
rings like others. Everything that looks at a polygon as a whole works on one row; what meets is joined by key.

``subdivide`` halves a polygon's box until no piece has more than ``max_vertices`` points. A piece's box is half open, so that
every point of the polygon's box lies in one piece; its clipped rings tell inside from outside within the box, and its
``edges``, the original ones that touch the box, tell what lies on the boundary.

``keyed`` gives a box the quadtree level whose cells are at least as wide, so it touches four cells at most, whatever its size;
``holders`` asks for a point's cell once a level that is in use (some dozens at most).

``dissolve`` cuts the members of a group into cells of a quadtree until a cell holds few edges or is covered by one member,
and sweeps each cell by itself: between neighbouring heights of corners and crossings edges don't cross, so their order at
the middle and the number of members that are open there give the trapezoids of the union. They don't overlap, and their
areas sum to the union's. No group meets in one row or task.

Defined results: null or empty rings, and those without an area, hold nothing and have no pieces. Rings that repeat or cross
each other count by the even-odd rule. Of repeated members one counts. A null group is a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dijkstone.operators.geo import inside, with_box
from dijkstone.sources.storage import materialize
from dijkstone.sources.tables import scattered

MAX_VERTICES = 256
#: Edges of a cell that are swept together; halvings of a cell in a round; rounds after which it is swept whatever it holds.
CELL_EDGES, HALVINGS, ROUNDS = 400, 4, 5

#: Points of the rows that are handed on together.
_BATCH_POINTS = 50_000
_POINTS = "array<array<struct<x:double,y:double>>>"
_EDGES = "array<struct<ax:double,ay:double,bx:double,by:double>>"


def _half(ring: np.ndarray, axis: int, at: float, upper: bool) -> np.ndarray:
    """The part of a ring (n x 2) on one side of a line, closed along it."""
    if not len(ring):
        return ring
    keep = ring[:, axis] >= at if upper else ring[:, axis] <= at
    if keep.all():
        return ring
    after = np.roll(keep, -1)
    cut = np.flatnonzero(keep != after)
    a, b = ring[cut], ring[(cut + 1) % len(ring)]
    t = (at - a[:, axis]) / (b[:, axis] - a[:, axis])
    p = a + t[:, None] * (b - a)
    p[:, axis] = at
    order = np.argsort(np.concatenate((2 * np.flatnonzero(keep), 2 * cut + 1)))
    return _straightened(np.concatenate((ring[keep], p))[order])


def _straightened(points: np.ndarray) -> np.ndarray:
    """A ring without repeated points and without those between others on one upright or level line. What ran outside of a
    box leaves many of these along its border."""
    same = points[1:] == points[:-1]
    if not same.all(axis=1).any() and not (same[1:] & same[:-1]).any():
        return points
    out: list[tuple[float, float]] = []
    for x, y in points.tolist():
        while out and (out[-1] == (x, y) or (len(out) > 1 and (out[-2][0] == out[-1][0] == x or out[-2][1] == out[-1][1] == y))):
            out.pop()
        out.append((x, y))
    return np.array(out, float).reshape(-1, 2)


def clip(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> list[np.ndarray]:
    """The part of rings within a box (x0, y0, x1, y1); parts that only run along its border have no area and are dropped."""
    out = []
    for r in rings:
        low, high = r.min(axis=0), r.max(axis=0)
        if low[0] > box[2] or high[0] < box[0] or low[1] > box[3] or high[1] < box[1]:
            continue
        for axis, at, upper in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
            if low[axis] < at if upper else high[axis] > at:
                r = _half(r, axis, at, upper)
        if len(r) > 2 and np.ptp(r[:, 0]) > 0 and np.ptp(r[:, 1]) > 0:
            out.append(r)
    return out


def _rings(value) -> list[np.ndarray]:
    found = [np.array([(p["x"], p["y"]) for p in r], float) for r in (value if value is not None else ()) if r is not None and len(r) > 2]
    return [r for r in found if np.isfinite(r).all()]


def _ring_lists(column: pa.ListArray) -> list[list[np.ndarray]]:
    """Of each row the rings of three points or more, all of them finite."""
    offsets, inner = column.offsets.to_numpy(), column.values
    ends, there = inner.offsets.to_numpy(), inner.is_valid().to_numpy(zero_copy_only=False)
    xy = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in inner.values.flatten()])
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(xy).all(axis=1))))
    good = there & (ends[1:] - ends[:-1] > 2) & (bad[ends[1:]] == bad[ends[:-1]])
    null = column.is_null().to_numpy(zero_copy_only=False)
    return [[] if gone else [xy[ends[k] : ends[k + 1]] for k in range(a, b) if good[k]] for gone, a, b in zip(null, offsets, offsets[1:])]


def _lists(arrays, names: tuple[str, ...]) -> pa.ListArray:
    """Arrays (n x names) as an Arrow list of structs for each."""
    flat = np.concatenate(arrays).reshape(-1, len(names)) if len(arrays) else np.zeros((0, len(names)))
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(len(names))], names=list(names))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), values)


def _polygons(many: list[list[np.ndarray]]) -> pa.ListArray:
    """Polygons as an Arrow list of rings for each."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, many)]), pa.int32()), _lists([r for rings in many for r in rings], ("x", "y")))


def _box(rings: list[np.ndarray]) -> tuple[float, float, float, float]:
    flat = np.concatenate(rings)
    return (*flat.min(axis=0), *flat.max(axis=0))


def _edges(rings: list[np.ndarray]) -> np.ndarray:
    """Edges (ax, ay, bx, by) of rings."""
    return np.concatenate([np.hstack((r, np.roll(r, -1, axis=0))) for r in rings]) if rings else np.zeros((0, 4))


def _halves(box):
    """The two halves of a box across its longer side."""
    x0, y0, x1, y1 = box
    if x1 - x0 >= y1 - y0:
        return ((x0, y0, (x0 + x1) / 2, y1), ((x0 + x1) / 2, y0, x1, y1))
    return ((x0, y0, x1, (y0 + y1) / 2), (x0, (y0 + y1) / 2, x1, y1))


def _touching(e: np.ndarray, box) -> np.ndarray:
    """Which edges touch a box: their boxes meet, and its corners aren't all on one side of the edge's line."""
    x0, y0, x1, y1 = box
    near = (np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 1], e[:, 3]) >= y0) & (np.minimum(e[:, 1], e[:, 3]) <= y1)
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    side = np.array([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (x0, x1) for y in (y0, y1)])
    slack = 1e-12 * (np.abs(dx) + np.abs(dy)) * max(map(abs, (*box, 1.0)))
    return near & (side.min(axis=0) <= slack) & (side.max(axis=0) >= -slack)


def pieces_of(rings: list[np.ndarray], max_vertices: int):
    """(box, clipped rings, original edges that touch the box), by halves of the box."""
    if not rings:
        return
    box = _box(rings)
    todo = [(box, rings, _edges(rings))]
    while todo:
        b, part, edges = todo.pop()
        edges = edges[_touching(edges, b)]
        # Where more edges than that meet in one point, halving doesn't end.
        narrow = max(b[2] - b[0], b[3] - b[1]) <= 1e-9 * max(map(abs, (*box, 1.0)))
        if max(sum(map(len, part)), len(edges)) <= max_vertices or narrow:
            if part or len(edges):
                yield b, part, edges
        else:
            todo += [(q, clip(part, q), edges) for q in _halves(b)]


def subdivide(polygons: DataFrame, rings: str = "rings", max_vertices: int = MAX_VERTICES) -> DataFrame:
    """``polygons`` without ``rings``, a row for each piece: piece (number), min_x, min_y, max_x, max_y, last_x, last_y (the
    box also has its upper border), rings (clipped, max_vertices points at most) and edges."""
    names = [c for c in polygons.columns if c != rings]
    more = f"piece int, min_x double, min_y double, max_x double, max_y double, last_x boolean, last_y boolean, rings {_POINTS}, edges {_EDGES}"
    schema = T.StructType([*polygons.select(*names).schema, *T._parse_datatype_string(more)])

    def made(batch, of, rows):
        number, boxes, tops, parts, edges = zip(*rows)
        box, top = np.array(boxes, float), np.array(tops, float)
        columns = [pa.array(number, pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in box.T), *(pa.array(box[:, k] == top[:, k]) for k in (2, 3))]
        return _beside(batch, names, of, columns + [_polygons(parts), _lists(edges, ("ax", "ay", "bx", "by"))], schema.names)

    def run(batches):
        for batch in batches:
            of, rows, size = [], [], 0
            for i, whole in enumerate(_ring_lists(batch.column("__rings"))):
                top = _box(whole) if whole else None
                for k, (b, part, edges) in enumerate(pieces_of(whole, max_vertices)):
                    of.append(i)
                    rows.append((k, b, top, part, edges))
                    size += sum(map(len, part)) + 2 * len(edges)
                    if size >= _BATCH_POINTS:
                        yield made(batch, of, rows)
                        of, rows, size = [], [], 0
            if rows:
                yield made(batch, of, rows)

    spread = scattered(polygons.select(*names, F.col(rings).cast(_POINTS).alias("__rings")))
    return spread.mapInArrow(run, schema)


def _beside(batch, names, of, columns, all_names):
    """Columns that were made of the rows ``of`` of a batch beside these."""
    at = pa.array(of, pa.int32())
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), *columns], names=all_names)


# ---------------------------------------------------------------- quadtree keys


def level_of(width: Column) -> Column:
    """The level of the quadtree whose cells are 2 ** level wide and no narrower than ``width``."""
    return F.when(width > 0, F.least(F.greatest(F.ceil(F.log2(width)), F.lit(-20)), F.lit(60))).otherwise(-20).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level)).cast("long")


def keyed(boxes: DataFrame) -> DataFrame:
    """A row for each cell that a box (min_x, min_y, max_x, max_y) touches at its own level: level, cx, cy; four at most."""
    levelled = boxes.withColumn("level", level_of(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))))
    span = lambda a, b: F.explode(F.sequence(_cell(F.col(a), F.col("level")), _cell(F.col(b), F.col("level"))))
    return levelled.withColumn("cx", span("min_x", "max_x")).withColumn("cy", span("min_y", "max_y"))


def on_edges(edges: Column, x: Column, y: Column) -> Column:
    """The point lies on one of the edges."""

    def on(e):
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return (cross == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))

    return F.exists(edges, on)


def holders(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", rings: str = "rings", boundary: bool = True, max_vertices: int = MAX_VERTICES) -> DataFrame:
    """Pairs of a point and a polygon that holds it, with the columns of both but the rings. ``boundary`` decides about points
    on an edge."""
    cells = materialize(keyed(subdivide(polygons, rings, max_vertices).withColumnRenamed("rings", "__rings")), "polygon-cells")
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # 81 at most
    at = F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))
    placed = points.withColumn("level", at).withColumns({"cx": _cell(F.col(x), F.col("level")), "cy": _cell(F.col(y), F.col("level"))})
    px, py = F.col(x), F.col(y)
    within = (px >= F.col("min_x")) & (py >= F.col("min_y")) & ((px < F.col("max_x")) | (F.col("last_x") & (px == F.col("max_x")))) & ((py < F.col("max_y")) | (F.col("last_y") & (py == F.col("max_y"))))
    near = placed.join(cells, ["level", "cx", "cy"]).where(within)
    on, hit = on_edges(F.col("edges"), px, py), inside(F.col("__rings"), px, py)
    near = near.where(on | hit if boundary else ~on & hit)
    return near.drop("level", "cx", "cy", "piece", "min_x", "min_y", "max_x", "max_y", "last_x", "last_y", "__rings", "edges")


# ---------------------------------------------------------------- unions


def sweep(members: list[list[np.ndarray]]) -> np.ndarray:
    """Trapezoids (y0, y1, left at y0, left at y1, right at y0, right at y1) of the union of polygons; they don't overlap."""
    edges = [_edges(m) for m in members]
    of = np.repeat(np.arange(len(edges)), [len(e) for e in edges])
    e = np.concatenate(edges) if edges else np.zeros((0, 4))
    swap = e[:, 1] > e[:, 3]
    e[swap] = e[swap][:, [2, 3, 0, 1]]  # upwards
    slanted = e[:, 1] < e[:, 3]
    e, of = e[slanted], of[slanted]
    if not len(e):
        return np.zeros((0, 6))
    heights = np.unique(np.concatenate((e[:, 1], e[:, 3], _crossings(e))))
    low, high = np.searchsorted(heights, e[:, 1]), np.searchsorted(heights, e[:, 3])
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    out = []
    for k in range(len(heights) - 1):
        y0, y1 = heights[k], heights[k + 1]
        here = np.flatnonzero((low <= k) & (high > k))
        if not len(here):
            continue
        at = lambda y: e[here, 0] + (y - e[here, 1]) * slope[here]  # noqa: E731, B023
        order = np.argsort(at((y0 + y1) / 2), kind="stable")
        x0, x1, who = at(y0)[order], at(y1)[order], of[here][order]
        open_, begun = set(), -1
        for j, m in enumerate(who):
            open_ ^= {m}
            if begun < 0 and open_:
                begun = j
            elif begun >= 0 and not open_:
                if x0[j] > x0[begun] or x1[j] > x1[begun]:
                    out.append((y0, y1, x0[begun], x1[begun], x0[j], x1[j]))
                begun = -1
    return np.array(out).reshape(-1, 6)


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross."""
    ax, ay, dx, dy = e[:, 0], e[:, 1], e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    found = [np.zeros(0)]
    for i in range(len(e) - 1):
        j = slice(i + 1, None)
        cross = dx[i] * dy[j] - dy[i] * dx[j]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((ax[j] - ax[i]) * dy[j] - (ay[j] - ay[i]) * dx[j]) / cross
            u = ((ax[j] - ax[i]) * dy[i] - (ay[j] - ay[i]) * dx[i]) / cross
        found.append(ay[i] + t[(cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)] * dy[i])
    return np.concatenate(found)


def _covers(rings: list[np.ndarray], box) -> bool:
    """A clipped polygon is its whole box: one ring along the border."""
    return len(rings) == 1 and math.isclose(_signed(rings[0]), (box[2] - box[0]) * (box[3] - box[1]), rel_tol=1e-12) and bool(np.isin(rings[0][:, 0], (box[0], box[2])).all() and np.isin(rings[0][:, 1], (box[1], box[3])).all())


def _signed(r: np.ndarray) -> float:
    x, y = r[:, 0] - r[0, 0], r[:, 1] - r[0, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


_CELL = f"cell long, x0 double, y0 double, x1 double, y1 double, rings {_POINTS}, n int, covers boolean"
_SHAPE = "y0 double, y1 double, left0 double, left1 double, right0 double, right1 double"


def _parts(rings, box, cell: int, halvings: int):
    """(cell, box, clipped rings) of the parts of a cell that a polygon reaches."""
    if not halvings:
        yield cell, box, rings
        return
    for side, half in enumerate(_halves(box)):
        part = clip(rings, half)
        if part:
            yield from _parts(part, half, 2 * cell + side, halvings - 1)


def _cut(names: list[str]):
    """Members of cells in the parts of their cell."""

    def made(batch, of, rows):
        cells, boxes, parts = zip(*rows)
        columns = [pa.array(cells, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in np.array(boxes, float).T), _polygons(parts)]
        columns += [pa.array([sum(map(len, p)) for p in parts], pa.int32()), pa.array([_covers(p, b) for p, b in zip(parts, boxes)])]
        return _beside(batch, ["grp"], of, columns, names)

    def run(batches):
        for batch in batches:
            cells, boxes = batch.column("cell").to_pylist(), zip(*(batch.column(c).to_pylist() for c in ("x0", "y0", "x1", "y1")))
            of, rows, size = [], [], 0
            for i, (rings, cell, box) in enumerate(zip(_ring_lists(batch.column("rings")), cells, boxes)):
                for row in _parts(rings, box, cell, HALVINGS):
                    of.append(i)
                    rows.append(row)
                    size += sum(map(len, row[2]))
                    if size >= _BATCH_POINTS:
                        yield made(batch, of, rows)
                        of, rows, size = [], [], 0
            if rows:
                yield made(batch, of, rows)

    return run


def _swept(cell: pa.Table) -> pa.Table:
    """The trapezoids of one cell."""
    x0, y0, x1, y1 = (cell.column(c)[0].as_py() for c in ("x0", "y0", "x1", "y1"))
    full = pc.any(cell.column("covers")).as_py()
    t = np.array([[y0, y1, x0, x0, x1, x1]]) if full else sweep(_ring_lists(cell.column("rings").combine_chunks()))
    group = cell.column("grp").take(pa.array([0] * len(t), pa.int32()))
    return pa.Table.from_arrays([group, *map(pa.array, t.T)], names=["grp", *(c.split()[0] for c in _SHAPE.split(", "))])


def dissolve(members: DataFrame, group: str, rings: str = "rings", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(group, y0, y1, left0, left1, right0, right1, area): trapezoids that don't overlap and together are the union of each
    group's members."""
    kind = members.schema[group].dataType
    cell = T._parse_datatype_string(_CELL)
    schema = T.StructType([T.StructField("grp", kind), *cell])
    whole = with_box(members.where(F.size(rings) > 0).select(F.col(group).alias("grp"), F.col(rings).cast(_POINTS).alias("rings")).distinct(), "rings")
    extent = whole.groupBy("grp").agg(F.min("min_x").alias("x0"), F.min("min_y").alias("y0"), F.max("max_x").alias("x1"), F.max("max_y").alias("y1"))
    same = F.col("w.grp").eqNullSafe(F.col("e.grp"))
    n = F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r))
    now = whole.alias("w").join(extent.alias("e"), same).select("w.grp", F.lit(1).cast("long").alias("cell"), "x0", "y0", "x1", "y1", "rings", n.alias("n"), F.lit(False).alias("covers"))
    done = []
    for turn in range(ROUNDS + 1):
        now = materialize(now.distinct(), "cells")
        load = now.groupBy("grp", "cell").agg(F.sum("n").alias("load"), F.max("covers").alias("full"))
        full = F.col("load.full") | (F.col("load.load") <= cell_edges)
        met = now.alias("now").join(load.alias("load"), F.col("now.grp").eqNullSafe(F.col("load.grp")) & (F.col("now.cell") == F.col("load.cell")))
        own = [f"now.{c}" for c in ("grp", "cell", "x0", "y0", "x1", "y1", "rings", "n", "covers")]
        if turn == ROUNDS:
            full = F.lit(True)
        # Of a covered cell only one covering member is needed.
        ready = met.where(full & (~F.col("load.full") | F.col("covers"))).select(*own)
        done.append(ready.withColumn("rings", F.when(~F.col("covers"), F.col("rings"))).distinct())
        rest = met.where(~full).select(*own)
        if turn == ROUNDS or rest.isEmpty():
            break
        now = scattered(rest).mapInArrow(_cut(schema.names), schema)
    ready = done[0]
    for d in done[1:]:
        ready = ready.union(d)
    shape = T.StructType([T.StructField("grp", kind), *T._parse_datatype_string(_SHAPE)])
    # Cells are few bytes and much work: by a number, adaptive execution doesn't gather them in one task.
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = ready.repartition(tasks, "grp", "cell").groupBy("grp", "cell").applyInArrow(_swept, shape)
    area = (F.col("y1") - F.col("y0")) * (F.col("right0") - F.col("left0") + F.col("right1") - F.col("left1")) / 2
    return out.withColumn("area", area).withColumnRenamed("grp", group)


def union_area(members: DataFrame, group: str, rings: str = "rings", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(group, union_area): the area that any member of a group covers."""
    return dissolve(members, group, rings, cell_edges).groupBy(group).agg(F.sum("area").alias("union_area"))


def shares(members: DataFrame, owners: DataFrame, owner: str, rings: str = "rings") -> DataFrame:
    """``owners`` (with area) and n_parts, part_area (of the union of the owner's members) and pct of the owner's area."""
    counts = members.groupBy(owner).agg(F.count("*").alias("n_parts"))
    out = owners.join(counts, owner, "left").join(union_area(members, owner, rings), owner, "left")
    part = F.coalesce("union_area", F.lit(0.0))
    # As SQL engines round doubles: 1.275 is less than its digits say, so it becomes 1.27.
    pct = F.when(F.col("area") > 0, F.round(100 * part / F.col("area") * 100) / 100).otherwise(0.0)
    return out.withColumns({"n_parts": F.coalesce("n_parts", F.lit(0)), "part_area": part, "pct": pct}).drop("union_area")


def group_geometry(groups: DataFrame, members: DataFrame, group: str, rings: str = "rings") -> DataFrame:
    """(group, rings): the geometry that a group has, or where it has none (null) its members' union, as a row for each piece."""
    own = groups.where(F.col(rings).isNotNull()).select(group, F.col(rings).cast(_POINTS).alias(rings))
    without = groups.where(F.col(rings).isNull()).select(F.col(group).alias("__g")).distinct()
    pieces = dissolve(members.join(without, F.col(group).eqNullSafe(F.col("__g")), "left_semi"), group, rings)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("left0", "y0"), corner("right0", "y0"), corner("right1", "y1"), corner("left1", "y1"))
    return own.union(pieces.select(group, F.array(ring).alias(rings)))


def centroid_of(rings: Column) -> Column:
    """Area centroid under the even-odd rule of an outer ring, which is the first, and its holes."""

    def moments(r):
        shifted = F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
        return F.aggregate(
            F.zip_with(r, shifted, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"))),
            F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
            lambda s, v: F.struct((s["c"] + v["c"]).alias("c"), (s["x"] + v["x"] * v["c"]).alias("x"), (s["y"] + v["y"] * v["c"]).alias("y")),
        )

    def signed(m, i):
        k = F.when(i == 0, 1.0).otherwise(-1.0) * F.signum(m["c"])
        return F.struct((k * m["c"]).alias("c"), (k * m["x"]).alias("x"), (k * m["y"]).alias("y"))

    parts = F.transform(F.transform(rings, moments), signed)
    total = F.aggregate(parts, F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), lambda s, v: F.struct((s["c"] + v["c"]).alias("c"), (s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y")))
    return F.when(total["c"] != 0, F.struct((total["x"] / (3 * total["c"])).alias("x"), (total["y"] / (3 * total["c"])).alias("y")))
