import math
import random

import numpy as np

from dijkstone.operators import simplify as S

SHAPE = "id long, rings array<array<struct<x:double,y:double>>>, w double"


def rows(shapes):
    return [(i, None if rings is None else [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings], w) for i, rings, w in shapes]


def off(p, ring):
    return min(float(S._distance(np.array([p], float), np.array(a, float), np.array(b, float))[0]) for a, b in zip(ring, ring[1:] + ring[:1]))


def test_the_error_is_within_the_tolerance():
    r = random.Random(1)
    for n, tolerance in ((3, 1.0), (200, 3.0), (5000, 10.0)):
        ring = [((100 + 5 * r.random()) * math.cos(2 * math.pi * i / n), (100 + 5 * r.random()) * math.sin(2 * math.pi * i / n)) for i in range(n)]
        got = S.simpler(np.array(ring), tolerance)
        assert 3 <= len(got) <= n and {tuple(p) for p in got.tolist()} <= set(ring)
        assert max(off(p, got.tolist()) for p in ring[:: max(1, n // 100)]) <= tolerance + 1e-9
    assert len(got) < 30
    line = np.array([(i, 0.001 * (i % 2)) for i in range(20_000)], float)  # deeper than a call stack
    assert S.kept_points(line, 1e-4).sum() > 10_000


def test_odd_polygons(spark):
    flat = [(0, 0), (5, 0), (9, 0)]
    square = [(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10)]
    df = spark.createDataFrame(rows([(1, [square, flat], 1.0), (2, None, 1.0), (3, [[(0, 0), (0.1, 0), (0, 0.1)]], 1.0), (4, [], 1.0), (5, [square], None)]), SHAPE)
    got = {x.id: [len(r) for r in x.rings] for x in S.generalise(df, 1.0).collect()}
    assert got == {1: [4], 5: [4]}
    got = {x.id: (x.rings if x.rings is None else [len(r) for r in x.rings], x.tolerance) for x in S.within_budget(df, "w", budget=60).collect()}
    assert got == {1: ([4], 0.5), 2: (None, None), 3: ([], 0.5), 4: ([], 0.5), 5: ([5], None)}
    assert S.generalise(df.limit(0), 1.0).collect() == []


def test_only_changed_sources_are_made_again(spark):
    square, other = [(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10)], [(0, 0), (20, 0), (20, 20), (0, 20)]
    old = spark.createDataFrame(rows([(1, [square], 1.0), (2, [square], 1.0), (3, [square], 1.0)]), SHAPE)
    stored = S.refreshed(old.selectExpr("id", "cast(null as string) source_hash", "rings").limit(0), old, "id", 1.0)
    marked = stored.withColumn("rings", S.F.when(S.F.col("id") == 1, S.F.array().cast(S._POINTS)).otherwise(S.F.col("rings")))  # to be recognised
    new = spark.createDataFrame(rows([(1, [square], 1.0), (2, [other], 1.0), (4, [square], 1.0)]), SHAPE)
    assert {x.id: [len(r) for r in x.rings] for x in S.refreshed(marked, new, "id", 1.0).collect()} == {1: [], 2: [4], 4: [4]}


def test_one_split_is_drawn_in_many_tasks(spark):
    from pyspark.sql import functions as F

    from dijkstone.operators import simplify as S

    ring = [{"x": 0.0, "y": 0.0}, {"x": 100.0, "y": 0.0}, {"x": 100.0, "y": 100.0}, {"x": 0.0, "y": 100.0}]
    df = spark.createDataFrame([(i, 1.0, [ring]) for i in range(64)], "id long, pixel double, rings array<array<struct<x:double,y:double>>>").coalesce(1)
    for out in (S.within_budget(df, "pixel"), S.generalise(df, 1.0)):
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and out.count() == 64
