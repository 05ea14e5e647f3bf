import math
import random

import numpy as np
from pyspark.sql import functions as F

from dijkstone.operators import polygons as P

SHAPE = "id long, grp string, rings array<array<struct<x:double,y:double>>>"


def star(r, n, cx, cy, size):
    """A polygon of n corners around a centre, not convex."""
    far = [size * (0.3 + 0.7 * r.random()) for _ in range(n)]
    return [(cx + d * math.cos(2 * math.pi * i / n), cy + d * math.sin(2 * math.pi * i / n)) for i, d in enumerate(far)]


def area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def holds(rings, x, y, boundary=True):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return boundary
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def rows(shapes):
    return [(i, g, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings] if rings is not None else None) for i, g, rings in shapes]


def square(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]


def test_pieces_are_small_and_keep_the_area(spark):
    r = random.Random(1)
    shapes = [(0, "a", [star(r, 3000, 0, 0, 1e5), square(-1000, -1000, 2000)]), (1, "a", [square(5, 5, 2)]), (2, "b", None), (3, "b", [])]
    out = P.subdivide(spark.createDataFrame(rows(shapes), SHAPE), max_vertices=64).collect()
    assert max(sum(map(len, x.rings)) for x in out) <= 64 and max(len(x.edges) for x in out) <= 64
    for i, _, rings in shapes[:2]:
        mine = [x for x in out if x.id == i]
        # Rings of one piece count by the even-odd rule, so its area is that of its sweep.
        got = sum((t[:, 1] - t[:, 0]) @ (t[:, 4] - t[:, 2] + t[:, 5] - t[:, 3]) / 2 for t in (P.sweep([P._rings(x.rings)]) for x in mine))
        assert math.isclose(got, area(rings[0]) - sum(map(area, rings[1:])), rel_tol=1e-9)
    assert {x.id for x in out} == {0, 1} and len([x for x in out if x.id == 1]) == 1


def test_points_in_huge_and_tiny_polygons(spark):
    r = random.Random(2)
    shapes = [(0, "huge", [square(0, 0, 300_000), square(1000, 1000, 1000)]), (1, "star", [star(r, 900, 1500, 1500, 1400)])]
    shapes += [(i, "tiny", [square(r.randrange(3000), r.randrange(3000), 2)]) for i in range(2, 40)]
    points = [(i, float(r.randrange(3000)), float(r.randrange(3000))) for i in range(300)]
    points += [(300 + k, *map(float, p)) for k, p in enumerate([*shapes[1][2][0][:50], (0, 0), (300_000, 300_000), (150_000, 75_000), (1000, 1500), (300_001, 5)])]
    df = spark.createDataFrame(points, "pid long, x double, y double")
    for boundary in (True, False):
        got = {(x.pid, x.id) for x in P.holders(df, spark.createDataFrame(rows(shapes), SHAPE), boundary=boundary, max_vertices=32).collect()}
        assert got == {(i, s[0]) for i, x, y in points for s in shapes if holds(s[2], x, y, boundary)}
    cells = P.keyed(P.subdivide(spark.createDataFrame(rows(shapes), SHAPE)))
    assert max(x["count"] for x in cells.groupBy("id", "piece").count().collect()) <= 4


def union_by_sampling(members, box, n=400):
    xs, ys = np.linspace(box[0], box[2], n, endpoint=False) + (box[2] - box[0]) / n / 2, np.linspace(box[1], box[3], n, endpoint=False) + (box[3] - box[1]) / n / 2
    covered = np.zeros((n, n), bool)
    for rings in members:
        odd = np.zeros((n, n), bool)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                if ay != by:
                    above = (ay > ys) != (by > ys)
                    at = (bx - ax) * (ys - ay) / (by - ay) + ax
                    odd ^= above[:, None] & (xs[None, :] < at[:, None])
        covered |= odd
    return covered.mean() * (box[2] - box[0]) * (box[3] - box[1])


def test_union_of_known_shapes(spark):
    diamond = [(0, -math.sqrt(2)), (math.sqrt(2), 0), (0, math.sqrt(2)), (-math.sqrt(2), 0)]
    shapes = [
        (0, "two", [square(0, 0, 2)]), (1, "two", [square(1, 1, 2)]), (2, "two", [square(1, 1, 2)]),
        (3, "ring", [square(0, 0, 10), square(2, 2, 6)]), (4, "ring", [square(4, 4, 2)]), (5, "ring", [square(1, 1, 3)]),
        (6, "octagram", [square(-1, -1, 2)]), (7, "octagram", [diamond]), (8, None, [square(0, 0, 1)]), (9, None, None), (10, "bow", [[(0, 0), (2, 2), (2, 0), (0, 2)]]),
        (11, "apart", [square(0, 0, 1)]), (12, "apart", [square(1, 0, 1)]), (13, "flat", [[(0, 0), (1, 0), (2, 0)]]),
    ]
    df = spark.createDataFrame(rows(shapes), SHAPE)
    # The star of both squares: each has 4, and they share the regular octagon of width 2.
    want = {"two": 7.0, "ring": 64 + 4 + 4.0, "octagram": 8 - 8 * (math.sqrt(2) - 1), None: 1.0, "bow": 2.0, "apart": 2.0}
    want["ring"] = 100 - 36 + 4 + 4.0
    for edges in (400, 6):
        got = {x.grp: x.union_area for x in P.union_area(df, "grp", cell_edges=edges).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want), got


def test_union_of_many_overlapping_shapes(spark):
    r = random.Random(4)
    members = [[star(r, 24, r.uniform(0, 100), r.uniform(0, 100), r.uniform(3, 30))] for _ in range(30)]
    df = spark.createDataFrame(rows([(i, "g", m) for i, m in enumerate(members)]), SHAPE)
    few, many = (P.dissolve(df, "grp", cell_edges=e).collect() for e in (300, 5000))
    total = lambda t: sum(x.area for x in t)
    assert math.isclose(total(few), total(many), rel_tol=1e-9)
    sampled = union_by_sampling(members, (-40, -40, 140, 140))
    assert abs(total(few) - sampled) < 0.01 * sampled
    # Pieces don't overlap: a point is in one at most, and in one where a member holds it.
    y0, y1, l0, l1, r0, r1 = (np.array([t[c] for t in few]) for c in ("y0", "y1", "left0", "left1", "right0", "right1"))
    for _ in range(200):
        x, y = r.uniform(-40, 140), r.uniform(-40, 140)
        k = (y - y0) / (y1 - y0)
        n = ((k > 0) & (k < 1) & (l0 + k * (l1 - l0) < x) & (x < r0 + k * (r1 - r0))).sum()
        assert n == any(holds(m, x, y) for m in members)


def test_shares_and_centroids(spark):
    shapes = rows([(0, "a", [square(0, 0, 4), square(1, 1, 2)]), (1, "a", [square(0, 0, 2)]), (2, "b", [[(0, 0), (3, 0), (0, 3)]])])
    owners = spark.createDataFrame([("a", 100.0), ("b", 0.0), ("c", 50.0)], "grp string, area double")
    got = {x.grp: (x.n_parts, round(x.part_area, 9), x.pct) for x in P.shares(spark.createDataFrame(shapes, SHAPE), owners, "grp").collect()}
    assert got == {"a": (2, 13.0, 13.0), "b": (1, 4.5, 0.0), "c": (0, 0.0, 0.0)}
    at = {x.id: (round(x.c.x, 9), round(x.c.y, 9)) for x in spark.createDataFrame(shapes, SHAPE).select("id", P.centroid_of(F.col("rings")).alias("c")).collect()}
    assert at == {0: (2.0, 2.0), 1: (1.0, 1.0), 2: (1.0, 1.0)}


def test_one_split_of_polygons_is_cut_in_many_tasks(spark):
    shapes = [(i, "g", [star(random.Random(i), 40, 0, 0, 10)]) for i in range(64)]
    df = spark.createDataFrame(rows(shapes), SHAPE).coalesce(1)
    out = P.subdivide(df, max_vertices=16)
    assert out.select("id", F.spark_partition_id().alias("p")).distinct().select("p").distinct().count() > 1
    got = {x.id: x.n for x in out.groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: len(list(P.pieces_of([np.array(s[0], float)], 16))) for i, _, s in shapes}


def test_rings_with_gaps_are_left_out():
    import pyarrow as pa

    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    at = lambda *p: [{"x": x, "y": y} for x, y in p]
    fine = at((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))
    column = pa.array([None, [], [None, fine], [[*fine, None], at((0.0, None), *square(0, 0, 1)), fine[:2]], [fine, fine]], kind)
    for part in (column, column.slice(1, 4), column.slice(2, 1)):
        assert [len(r) for r in P._ring_lists(part)] == [0, 0, 1, 0, 2][part.offset : part.offset + len(part)]


def test_shares_are_rounded_as_doubles(spark):
    """1.275 % in doubles is a little less, so SQL says 1.27."""
    owners = spark.createDataFrame([("a", 25e6)], "grp string, area double")
    shapes = rows([(0, "a", [[(0, 0), (637.5, 0), (637.5, 500), (0, 500)]])])
    assert [x.pct for x in P.shares(spark.createDataFrame(shapes, SHAPE), owners, "grp").collect()] == [1.27]


def test_nearest_among_many_sees_few_pairs(spark, monkeypatch):
    from dijkstone.operators import geo as G

    r = random.Random(8)
    left = [(i, r.uniform(-900, 900), r.uniform(-900, 900)) for i in range(300)] + [(300, None, 1.0), (301, 5000.0, 0.0), (302, 0.0, 0.0), (303, 0.0, 0.0)]
    right = [(r.uniform(-900, 900), r.uniform(-900, 900)) for _ in range(400)] + [(0.0, 0.0), (None, 1.0), (2000.0, 2000.0), (5000.0, 600.0)] + [(1500 + r.random(), 1500 + r.random()) for _ in range(200)]
    ls, rs = spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "rx double, ry double")
    got = {x.id: x.distance for x in G.nearest_within(ls, rs, 600.0).collect()}
    want = {}
    for i, x, y in left:
        d = [math.sqrt((x - a) ** 2 + (y - b) ** 2) for a, b in right if x is not None and a is not None]
        if d and min(d) <= 600:
            want[i] = min(d)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert G.nearest_within(ls, rs.where("false"), 600.0).count() == 0


def test_cells_are_swept_by_all_tasks(spark):
    r = random.Random(9)
    shapes = [(i, "ab"[i % 2], [square(r.randrange(3000), r.randrange(3000), 50)]) for i in range(400)]
    out = P.dissolve(spark.createDataFrame(rows(shapes), SHAPE), "grp", cell_edges=40)
    assert out.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
