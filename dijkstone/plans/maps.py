"""Geometry over points and polygons that are derived from keys of the tables."""

from pyspark.sql import functions as F

from dijkstone.operators import geo as G
from dijkstone.operators import polygons as P
from dijkstone.operators import simplify as S
from dijkstone.plans.registry import query
from dijkstone.sources.tables import scattered

#: Places of customers and boxes of nations, as both engines compute them.
POINTS_SQL = "points AS (SELECT c_custkey, c_nationkey, (c_custkey * 7919 % 10007)::DOUBLE AS x, (c_custkey * 104729 % 10009)::DOUBLE AS y FROM customer)"
AREAS_SQL = "areas AS (SELECT n_nationkey, (n_nationkey * 613 % 8000)::DOUBLE AS x0, (n_nationkey * 1453 % 8000)::DOUBLE AS y0, (600 + n_nationkey * 40)::DOUBLE AS w FROM nation)"


def points(t):
    return t.customer.select("c_custkey", "c_nationkey", (F.col("c_custkey") * 7919 % 10007).cast("double").alias("x"), (F.col("c_custkey") * 104729 % 10009).cast("double").alias("y"))


def _square(a, b):
    """A part of the square from (x0, y0) of width w, from a to b of the width both ways."""
    lo_x, lo_y, hi_x, hi_y = F.col("x0") + F.col("w") * a, F.col("y0") + F.col("w") * a, F.col("x0") + F.col("w") * b, F.col("y0") + F.col("w") * b
    return F.array(*[F.struct(p.alias("x"), q.alias("y")) for p, q in ((lo_x, lo_y), (hi_x, lo_y), (hi_x, hi_y), (lo_x, hi_y))])


def areas(t):
    """Squares with a square hole in the middle third."""
    n = t.nation.select("n_nationkey", (F.col("n_nationkey") * 613 % 8000).cast("double").alias("x0"), (F.col("n_nationkey") * 1453 % 8000).cast("double").alias("y0"), (600 + F.col("n_nationkey") * 40).cast("double").alias("w"))
    return n.withColumn("rings", F.array(_square(0.0, 1.0), _square(0.25, 0.5)))


#: Plots of suppliers: squares with a square hole, of which many overlap.
PLOTS_SQL = "plots AS (SELECT s_suppkey, s_nationkey AS g, (s_suppkey * 7919 % 5003)::DOUBLE AS x0, (s_suppkey * 104729 % 5009)::DOUBLE AS y0, (200 + s_suppkey % 8 * 100)::DOUBLE AS w FROM supplier)"


def plots(t):
    k = F.col("s_suppkey")
    s = scattered(t.supplier.select("s_suppkey", "s_nationkey")).select("s_suppkey", F.col("s_nationkey").alias("g"), (k * 7919 % 5003).cast("double").alias("x0"), (k * 104729 % 5009).cast("double").alias("y0"), (200 + k % 8 * 100).cast("double").alias("w"))
    return s.withColumn("rings", F.array(_square(0.0, 1.0), _square(0.25, 0.5)))


def _union_sql(parts):
    """The area that any of the squares with holes in ``parts`` (g, x0, y0, w) covers, by the cells between all their borders."""
    lines = lambda c: " UNION ".join(f"SELECT g, {c} + {k} * w AS v FROM {parts}" for k in (0, 0.25, 0.5, 1))
    inside = "x BETWEEN p.x0 AND p.x0 + p.w AND y BETWEEN p.y0 AND p.y0 + p.w AND NOT (x BETWEEN p.x0 + 0.25 * p.w AND p.x0 + 0.5 * p.w AND y BETWEEN p.y0 + 0.25 * p.w AND p.y0 + 0.5 * p.w)"
    return f"""xs AS (SELECT g, v AS a, lead(v) OVER (PARTITION BY g ORDER BY v) AS b FROM ({lines("x0")})), ys AS (SELECT g, v AS a, lead(v) OVER (PARTITION BY g ORDER BY v) AS b FROM ({lines("y0")})),
  fields AS (SELECT xs.g, (xs.a + xs.b) / 2 AS x, (ys.a + ys.b) / 2 AS y, (xs.b - xs.a) * (ys.b - ys.a) AS area FROM xs JOIN ys ON xs.g = ys.g WHERE xs.b IS NOT NULL AND ys.b IS NOT NULL),
  unions AS (SELECT g, sum(area) AS area FROM fields f WHERE EXISTS (SELECT 1 FROM {parts} p WHERE p.g = f.g AND {inside}) GROUP BY g)"""


IN = "x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + w AND NOT (x > x0 + w * 0.25 AND x < x0 + w * 0.5 AND y > y0 + w * 0.25 AND y < y0 + w * 0.5)"


@query("geo01_point_in_polygon", f"WITH {POINTS_SQL}, {AREAS_SQL} SELECT c_custkey, n_nationkey FROM points, areas WHERE {IN}")
def _(t):
    return P.holders(points(t), areas(t).select("n_nationkey", "rings")).select("c_custkey", "n_nationkey")


@query(
    "geo01_strictly_inside",
    f"WITH {POINTS_SQL}, {AREAS_SQL} SELECT c_custkey, n_nationkey FROM points, areas WHERE x > x0 AND x < x0 + w AND y > y0 AND y < y0 + w AND NOT (x >= x0 + w * 0.25 AND x <= x0 + w * 0.5 AND y >= y0 + w * 0.25 AND y <= y0 + w * 0.5)",
)
def _(t):
    return P.holders(points(t), areas(t).select("n_nationkey", "rings"), boundary=False).select("c_custkey", "n_nationkey")


@query(
    "geo01_mixed_sizes",
    f"""WITH {POINTS_SQL}, {AREAS_SQL}, s AS (SELECT 'tiny' AS kind, s_suppkey AS id, (s_suppkey * 7919 % 10007 - 1)::DOUBLE AS x0, (s_suppkey * 104729 % 10009 - 1)::DOUBLE AS y0, 2.0 AS w FROM supplier
        UNION ALL SELECT 'huge', r_regionkey, r_regionkey * 1000.0, -150000.0, 300000.0 FROM region UNION ALL SELECT 'area', * FROM areas)
        SELECT c_custkey, kind, id FROM points JOIN s ON x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + w AND (kind <> 'area' OR NOT (x > x0 + w * 0.25 AND x < x0 + w * 0.5 AND y > y0 + w * 0.25 AND y < y0 + w * 0.5))""",
)
def _(t):
    """Polygons from 2 metres to 300 kilometres wide in one join."""
    k, shape = F.col("s_suppkey"), lambda d: d.select("kind", "id", F.array(_square(0.0, 1.0)).alias("rings"))
    tiny = t.supplier.select(F.lit("tiny").alias("kind"), k.cast("long").alias("id"), (k * 7919 % 10007 - 1).cast("double").alias("x0"), (k * 104729 % 10009 - 1).cast("double").alias("y0"), F.lit(2.0).alias("w"))
    huge = t.region.select(F.lit("huge").alias("kind"), F.col("r_regionkey").cast("long").alias("id"), (F.col("r_regionkey") * 1000.0).alias("x0"), F.lit(-150000.0).alias("y0"), F.lit(300000.0).alias("w"))
    some = areas(t).select(F.lit("area").alias("kind"), F.col("n_nationkey").cast("long").alias("id"), "rings")
    return P.holders(points(t), shape(tiny).union(shape(huge)).union(some)).select("c_custkey", "kind", "id")


CORNERS = 720
GEAR_SQL = f"SELECT s_suppkey, i, (40 + (i * 37 + s_suppkey) % 50) * cos(2 * pi() * i / {CORNERS}) AS x, (40 + (i * 37 + s_suppkey) % 50) * sin(2 * pi() * i / {CORNERS}) AS y FROM supplier, range({CORNERS}) r(i)"


@query(
    "geo02_subdivided",
    f"""WITH p AS ({GEAR_SQL}), n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM p WINDOW w AS (PARTITION BY s_suppkey ORDER BY i))
        SELECT s_suppkey, round(abs(sum(x * y2 - x2 * y)) / 2, 3) AS area, true AS small FROM n GROUP BY 1""",
)
def _(t):
    """Polygons of 720 corners in pieces of 256 at most, whose areas sum to theirs."""
    far = lambda i: 40 + (i * 37 + F.col("s_suppkey")) % 50
    at = lambda i: F.struct((far(i) * F.cos(2 * F.pi() * i / CORNERS)).alias("x"), (far(i) * F.sin(2 * F.pi() * i / CORNERS)).alias("y"))
    gears = scattered(t.supplier.select("s_suppkey")).select("s_suppkey", F.array(F.transform(F.sequence(F.lit(0), F.lit(CORNERS - 1)), at)).alias("rings"))
    area = F.aggregate("rings", F.lit(0.0), lambda s, r: s + G.area(r))
    pieces = P.subdivide(gears).select("s_suppkey", area.alias("area"), F.aggregate("rings", F.lit(0), lambda s, r: s + F.size(r)).alias("n"))
    return pieces.groupBy("s_suppkey").agg(F.round(F.sum("area"), 3).alias("area"), (F.max("n") <= P.MAX_VERTICES).alias("small"))


@query("geo02_cell_cover", f"WITH {AREAS_SQL} SELECT n_nationkey, cx::INTEGER AS cx, cy::INTEGER AS cy FROM areas, range(0, 20) a(cx), range(0, 20) b(cy) WHERE cx BETWEEN floor(x0 / 500) AND floor((x0 + w) / 500) AND cy BETWEEN floor(y0 / 500) AND floor((y0 + w) / 500)")
def _(t):
    return G.cover(G.with_box(areas(t), "rings"), 500.0).select("n_nationkey", "cx", "cy")


@query("geo03_box_overlap", f"WITH {AREAS_SQL} SELECT n_nationkey FROM areas WHERE x0 <= 4000 AND x0 + w >= 1000 AND y0 <= 5000 AND y0 + w >= 2000")
def _(t):
    from dijkstone.operators.predicates import Box

    return G.with_box(areas(t), "rings").where(Box(1000, 2000, 4000, 5000).overlaps("min_x", "min_y", "max_x", "max_y")).select("n_nationkey")


@query(
    "geo04_nearest_within",
    f"""WITH {POINTS_SQL}, s AS (SELECT s_suppkey, (s_suppkey * 7919 % 9973)::DOUBLE AS rx, (s_suppkey * 6997 % 9967)::DOUBLE AS ry FROM supplier),
        d AS (SELECT c_custkey, min(sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry))) AS distance FROM points, s WHERE sqrt((x - rx) * (x - rx) + (y - ry) * (y - ry)) <= 600 GROUP BY 1)
        SELECT c_custkey, round(distance, 6) AS distance, CASE WHEN distance = 0 THEN 'inside' WHEN distance <= 250 THEN 'stop' ELSE 'warn' END AS band FROM d""",
)
def _(t):
    s = t.supplier.select("s_suppkey", (F.col("s_suppkey") * 7919 % 9973).cast("double").alias("rx"), (F.col("s_suppkey") * 6997 % 9967).cast("double").alias("ry"))
    return G.nearest_band(G.nearest_within(points(t), s, 600.0), "c_custkey").withColumn("distance", F.round("distance", 6))


@query(
    "geo05_share_of_area",
    f"WITH {PLOTS_SQL}, {_union_sql('plots')} SELECT n_nationkey, count(s_suppkey) AS n_parts, round(coalesce(any_value(area), 0), 2) AS part_area, round(100 * coalesce(any_value(area), 0) / 25e6, 2) AS pct FROM nation LEFT JOIN plots ON plots.g = n_nationkey LEFT JOIN unions ON unions.g = n_nationkey GROUP BY 1",
)
def _(t):
    """Plots of a nation overlap; what several cover counts once."""
    owners = t.nation.select(F.col("n_nationkey").alias("g"), F.lit(25e6).alias("area"))
    return P.shares(plots(t), owners, "g").select(F.col("g").alias("n_nationkey"), "n_parts", F.round("part_area", 2).alias("part_area"), "pct")


@query("geo06_group_geometry", f"WITH {PLOTS_SQL}, {_union_sql('plots')} SELECT g, round(any_value(area), 2) AS area, min(x0) AS min_x, min(y0) AS min_y, max(x0 + w) AS max_x, max(y0 + w) AS max_y FROM plots JOIN unions USING (g) GROUP BY g")
def _(t):
    """The dissolved geometry of each group: pieces without overlap."""
    box = [f(c).alias(name) for name, f, c in (("min_x", F.min, F.least("left0", "left1")), ("min_y", F.min, F.col("y0")), ("max_x", F.max, F.greatest("right0", "right1")), ("max_y", F.max, F.col("y1")))]
    return P.dissolve(plots(t), "g").groupBy("g").agg(F.round(F.sum("area"), 2).alias("area"), *box)


@query("src23_group_geometry", f"WITH {PLOTS_SQL}, {_union_sql('plots')} SELECT n_nationkey AS g, round(CASE WHEN n_nationkey % 3 = 0 THEN area ELSE power(600 + n_nationkey * 40, 2) * 15 / 16 END, 2) AS area FROM nation LEFT JOIN unions ON g = n_nationkey WHERE n_nationkey % 3 <> 0 OR area IS NOT NULL")
def _(t):
    """Groups keep the geometry that they have; where it is still unknown, their members' union takes its place."""
    k = F.col("n_nationkey")
    groups = areas(t).select(k.alias("g"), F.when(k % 3 != 0, F.col("rings")).alias("rings"))
    piece = G.area(F.col("rings")[0]) - F.coalesce(G.area(F.get("rings", F.lit(1))), F.lit(0.0))
    return P.group_geometry(groups, plots(t), "g").groupBy("g").agg(F.round(F.sum(piece), 2).alias("area"))


@query(
    "mv08_area_statistics",
    f"""WITH {PLOTS_SQL}, {AREAS_SQL}, c AS (SELECT *, x0 + w * (0.5 - 0.375 / 16) / (15 / 16.0) AS cx, y0 + w * (0.5 - 0.375 / 16) / (15 / 16.0) AS cy FROM plots),
        held AS (SELECT a.n_nationkey AS g, s_suppkey, c.x0, c.y0, c.w FROM areas a JOIN c ON cx > a.x0 AND cx < a.x0 + a.w AND cy > a.y0 AND cy < a.y0 + a.w), {_union_sql('held')}
        SELECT n_nationkey, w * w AS area, (SELECT count(*) FROM held WHERE held.g = n_nationkey) AS n_parts, round(coalesce(unions.area, 0), 2) AS part_area, round(coalesce(unions.area, 0) / (w * w) * 100, 2) AS pct FROM areas LEFT JOIN unions ON unions.g = n_nationkey""",
)
def _(t):
    """Of each municipality the number, the united area and the share of the plots whose centroid lies in it."""
    towns = areas(t).select("n_nationkey", F.array(F.col("rings")[0]).alias("rings"), (F.col("w") * F.col("w")).alias("area"))
    centred = plots(t).withColumn("c", P.centroid_of(F.col("rings"))).select("s_suppkey", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
    held = P.holders(centred, towns.select("n_nationkey", "rings"), boundary=False).select("n_nationkey", "s_suppkey").join(plots(t).select("s_suppkey", "rings"), "s_suppkey")
    return P.shares(held, towns.select("n_nationkey", "area"), "n_nationkey").select("n_nationkey", "area", "n_parts", F.round("part_area", 2).alias("part_area"), "pct")


@query("geo07_extent", f"WITH {POINTS_SQL} SELECT c_nationkey, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM points GROUP BY 1")
def _(t):
    return points(t).groupBy("c_nationkey").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


@query(
    "geo08_tiles",
    f"""WITH {POINTS_SQL}, p AS (SELECT *, c_custkey % 15 AS z, 3440.640 * 256 / power(2.0, c_custkey % 15) AS width FROM points)
        SELECT c_custkey, floor((x + 100000 - -285401.92) / width)::INTEGER AS tx, floor((903401.92 - y - 400000) / width)::INTEGER AS ty, CASE WHEN z <= 6 THEN 6 WHEN z <= 8 THEN 8 WHEN z <= 10 THEN 10 END::INTEGER AS level,
        round(-285401.92 + floor((x + 100000 - -285401.92) / width) * width, 4) AS min_x FROM p""",
)
def _(t):
    p = points(t).withColumn("z", (F.col("c_custkey") % 15).cast("int")).withColumn("tile", G.tile_of(F.col("z"), F.col("x") + 100000, F.col("y") + 400000))
    box = G.tile_envelope(F.col("z"), F.col("tile.tx"), F.col("tile.ty"))
    return p.select("c_custkey", "tile.tx", "tile.ty", G.level_for_zoom(F.col("z")).alias("level"), F.round(box["min_x"], 4).alias("min_x"))


def _rough(t):
    """Plots with 40 points an edge, off the line by less than 1; every third plot has a notch 50 deep in its first edge."""
    k, w, x0, y0 = F.col("s_suppkey"), F.col("w"), F.col("x0"), F.col("y0")

    def at(i):
        edge, j = F.floor(i / 40), i % 40
        notch = F.when(k % 3 == 0, 50 * (1 - F.abs(j - 20) / 20)).otherwise(0.0)
        off = F.when(j == 0, 0.0).when(edge == 0, notch).otherwise(((j * 7 + k) % 10) / 10)
        along = j / 40 * w
        x = F.when(edge == 0, x0 + along).when(edge == 1, x0 + w - off).when(edge == 2, x0 + w - along).otherwise(x0 + off)
        y = F.when(edge == 0, y0 + off).when(edge == 1, y0 + along).when(edge == 2, y0 + w - off).otherwise(y0 + w - along)
        return F.struct(x.alias("x"), y.alias("y"))

    return plots(t).withColumn("rings", F.array(F.transform(F.sequence(F.lit(0), F.lit(159)), at)))


SIMPLE_SQL = "(4 + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END)::INTEGER AS n_points, round(w * w - CASE WHEN s_suppkey % 3 = 0 THEN 25 * w ELSE 0 END, 3) AS area"


def _told(df, *more):
    return df.select("s_suppkey", F.size(F.col("rings")[0]).alias("n_points"), F.round(G.area(F.col("rings")[0]), 3).alias("area"), *more)


@query("geo09_generalised", f"WITH {PLOTS_SQL} SELECT s_suppkey, {SIMPLE_SQL} FROM plots WHERE w >= 300")
def _(t):
    """Rings without the points that move a line by less than the tolerance; small plots aren't to be seen."""
    rough = _rough(t)
    return _told(S.generalise(rough.where("w >= 300").union(rough.where("w < 300").withColumn("rings", F.transform("rings", lambda r: F.slice(r, 1, 1)))), 1.0))


@query("geo07_within_budget", f"WITH {PLOTS_SQL} SELECT s_suppkey, {SIMPLE_SQL}, CASE WHEN w >= 400 THEN 2.0 ELSE 8.0 END::DOUBLE AS tolerance FROM plots")
def _(t):
    """The finest step of the ladder that draws a plot, 800 pixels wide, in 72 characters."""
    return _told(S.within_budget(_rough(t).withColumn("pixel", F.col("w") / 800), "pixel", budget=72), "tolerance")


@query("geo09_visible", f"WITH {AREAS_SQL} SELECT n_nationkey, 4::INTEGER AS n_points FROM areas WHERE w >= 900")
def _(t):
    seen = G.visible_at(G.with_box(areas(t), "rings"), 900.0)
    return seen.select("n_nationkey", F.size(G.simplify(F.col("rings")[0], 10.0)).alias("n_points"))


def _seconds(k):
    return " + ".join(f"({c}) * power((x + 100000 - 155000) / 1e5, {p}) * power((y + 400000 - 463000) / 1e5, {q})" for (p, q), c in k.items())


@query("geo11_degrees", f"WITH {POINTS_SQL} SELECT c_custkey, round(5.38720621 + ({_seconds(G.DEGREES_EAST)}) / 3600, 7)::DOUBLE AS lon, round(52.1551744 + ({_seconds(G.DEGREES_NORTH)}) / 3600, 7)::DOUBLE AS lat FROM points")
def _(t):
    p = points(t).withColumn("d", G.to_degrees(F.col("x") + 100000, F.col("y") + 400000))
    return p.select("c_custkey", F.round("d.lon", 7).alias("lon"), F.round("d.lat", 7).alias("lat"))


@query("geo12_wkt_centres", f"WITH {POINTS_SQL} SELECT c_custkey, x + 1 AS mx, y + 1 AS my FROM points")
def _(t):
    at = lambda c, d: (F.col(c) + d).cast("string")
    wkt = F.concat(F.lit("POLYGON(("), at("x", 0), F.lit(" "), at("y", 0), F.lit(", "), at("x", 2), F.lit(" "), at("y", 0), F.lit(", "), at("x", 2), F.lit(" "), at("y", 2), F.lit(", "), at("x", 0), F.lit(" "), at("y", 2), F.lit(", "), at("x", 0), F.lit(" "), at("y", 0), F.lit("))"))
    return points(t).withColumn("c", G.centroid(G.parse_wkt(wkt))).select("c_custkey", F.col("c.x").alias("mx"), F.col("c.y").alias("my"))


@query("geo13_candidates")
def _(t):
    """Objects are customers, their candidates the places of all their orders, in order of the key."""
    k = F.col("o_orderkey")
    kind = F.when(k % 13 == 0, "Adres").when(k % 2 == 0, "Vlak").otherwise("Punt")
    candidate = F.struct(k, kind.alias("kind"), (k * 7919 % 10007).cast("double").alias("x"), (k * 104729 % 10009).cast("double").alias("y"))
    c = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(candidate)).alias("all"))
    of = points(t).select("c_custkey", "c_nationkey").join(G.median_centre(points(t), "c_nationkey"), "c_nationkey")
    return c.join(of, "c_custkey").select("c_custkey", G.choose_candidate(F.col("all"), F.struct(F.col("mx").alias("x"), F.col("my").alias("y")))["o_orderkey"].alias("chosen"))


@query("geo14_median_centres", f"WITH {POINTS_SQL} SELECT c_nationkey, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM points GROUP BY 1")
def _(t):
    return G.median_centre(points(t), "c_nationkey")


@query(
    "geo15_raster_sample",
    f"""WITH {POINTS_SQL}, raster AS (SELECT p_partkey % 101 AS gx, p_partkey // 101 AS gy, CASE WHEN p_size < 10 THEN -9999.0 ELSE p_retailprice END AS v FROM part)
        SELECT c_custkey, CASE WHEN v >= 0 THEN v END AS v FROM points LEFT JOIN raster ON round_even(x / 100, 0) = gx AND round_even(y / 100, 0) = gy""",
)
def _(t):
    raster = t.part.select((F.col("p_partkey") % 101).cast("int").alias("gx"), F.expr("cast(p_partkey div 101 as int)").alias("gy"), F.when(F.col("p_size") < 10, -9999.0).otherwise(F.col("p_retailprice")).alias("v"))
    return G.raster_sample(points(t), raster, "v").select("c_custkey", "v")
