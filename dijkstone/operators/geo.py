"""Planar geometry of single rows: rings as arrays of struct<x,y>, exact tests, grid cells as join keys of points.

Joins with polygons, their pieces and their unions are in ``polygons``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dijkstone.sources.storage import materialize

#: Fixed values of the national tile pyramid: origin (top left), resolution at zoom 0, pixels of a tile, deepest zoom.
TILE_MIN_X, TILE_MAX_Y, TILE_RESOLUTION, TILE_PIXELS, TILE_MAX_ZOOM = -285401.92, 903401.92, 3440.640, 256, 14


def ring(points: list[tuple[float, float]]) -> Column:
    """A literal ring."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def _zipped(r: Column, f) -> Column:
    shifted = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, shifted, f)


def on_boundary(rings: Column, x: Column, y: Column) -> Column:
    """The point lies on an edge of one of the rings."""

    def on(a, b):
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(F.flatten(F.transform(rings, lambda r: _zipped(r, on))), lambda t: t)


def inside(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd test, so holes are rings like others; points on the boundary are undefined here."""

    def crosses(a, b):
        above = (a["y"] > y) != (b["y"] > y)
        return F.when(above & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    hits = F.aggregate(F.flatten(F.transform(rings, lambda r: _zipped(r, crosses))), F.lit(0), lambda s, v: s + v)
    return hits % 2 == 1


def intersects(rings: Column, x: Column, y: Column) -> Column:
    """Inside or on the boundary."""
    return on_boundary(rings, x, y) | inside(rings, x, y)


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Inside and not on the boundary."""
    return ~on_boundary(rings, x, y) & inside(rings, x, y)


def with_box(df: DataFrame, rings: str) -> DataFrame:
    """``df`` with min_x, min_y, max_x, max_y of its rings."""
    flat = F.flatten(rings)
    get = lambda f, k: f(F.transform(flat, lambda p: p[k]))
    return df.withColumns({"min_x": get(F.array_min, "x"), "min_y": get(F.array_min, "y"), "max_x": get(F.array_max, "x"), "max_y": get(F.array_max, "y")})


def cover(df: DataFrame, cell: float) -> DataFrame:
    """One row for each grid cell that the box of a row touches: columns cx, cy (needs with_box)."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("int"), F.floor(F.col(b) / cell).cast("int")))
    return df.withColumn("cx", span("min_x", "max_x")).withColumn("cy", span("min_y", "max_y"))


def within_distance(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Pairs of points at most ``radius`` apart, with the distance: an equi-join on cells of that width and their neighbours."""
    home = left.withColumns({"cx": F.floor(F.col(lx) / radius).cast("int"), "cy": F.floor(F.col(ly) / radius).cast("int")})
    at = F.array(*[F.struct((F.floor(F.col(rx) / radius) + i).cast("int").alias("cx"), (F.floor(F.col(ry) / radius) + j).cast("int").alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = right.withColumn("__c", F.explode(at)).select("*", "__c.cx", "__c.cy").drop("__c")
    d = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    return home.join(spread, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("cx", "cy")


#: Halvings of the radius at most, and points of a cell in use, on average, at which halving ends.
NEAREST_LEVELS, NEAREST_MEAN = 16, 2


def nearest_within(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """Rows of ``left`` with a point of ``right`` at most ``radius`` away, and the distance of the nearest.

    Each place asks the points around it within a narrow width first, halvings of the radius at which few points share a cell,
    and the next wider one only if none was that near. So pairs grow with the places, not with the points within the radius;
    where many points crowd together, places that are farther from them than the width see all of the crowd.
    """
    stops = materialize(right.select(F.col(rx).alias("__rx"), F.col(ry).alias("__ry")).where("__rx is not null and __ry is not null").distinct(), "stops")
    cell = lambda c, w: F.floor(F.col(c) / w).cast("long")
    used = stops.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(NEAREST_LEVELS)))).withColumn("w", radius / F.pow(F.lit(2.0), F.col("level")))
    cells = {r.level: r.n for r in used.select("level", cell("__rx", F.col("w")).alias("cx"), cell("__ry", F.col("w")).alias("cy")).distinct().groupBy("level").agg(F.count("*").alias("n")).collect()}
    total = stops.count()
    finest = next((k for k in range(NEAREST_LEVELS) if total <= NEAREST_MEAN * cells.get(k, 0)), NEAREST_LEVELS if total else 0)
    todo, done = left.select(F.col(lx).alias("__x"), F.col(ly).alias("__y")).where("__x is not null and __y is not null").distinct(), []
    near = F.sqrt(F.pow(F.col("__x") - F.col("__rx"), 2) + F.pow(F.col("__y") - F.col("__ry"), 2))
    for level in range(finest, -1, -1):
        width = radius / 2.0**level
        at = F.array(*[F.struct((cell("__rx", width) + i).alias("cx"), (cell("__ry", width) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        spread = stops.withColumn("__c", F.explode(at)).select("__rx", "__ry", "__c.cx", "__c.cy")
        asked = todo.withColumns({"cx": cell("__x", width), "cy": cell("__y", width)}).join(spread, ["cx", "cy"], "left")
        step = materialize(asked.groupBy("__x", "__y").agg(F.min(F.when(near <= width, near)).alias("distance")), "nearest")
        done.append(step.where("distance is not null"))
        todo = step.where("distance is null").select("__x", "__y")
        if todo.isEmpty():
            break
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    return left.join(found, (F.col(lx) == F.col("__x")) & (F.col(ly) == F.col("__y"))).drop("__x", "__y")


def nearest_band(pairs: DataFrame, key: str, stop: float = 250.0) -> DataFrame:
    """Per key the least distance and its band: 0 inside, up to ``stop`` stop, else warn."""
    d = F.col("distance")
    return pairs.groupBy(key).agg(F.min("distance").alias("distance")).withColumn("band", F.when(d == 0, "inside").when(d <= stop, "stop").otherwise("warn"))


def area(r: Column) -> Column:
    """Area of one ring (shoelace)."""
    twice = F.aggregate(_zipped(r, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
    return F.abs(twice) / 2


def centroid(points: Column) -> Column:
    """Mean of the distinct points of an outer ring."""
    p = F.array_distinct(points)
    mean = lambda k: F.aggregate(p, F.lit(0.0), lambda s, v: s + v[k]) / F.size(p)
    return F.when(F.size(p) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def parse_wkt(text: Column) -> Column:
    """Points of the outer ring of a WKT polygon, or the one of a WKT point; null if neither."""
    body = F.regexp_extract(text, r"(?i)^\s*(?:POINT\s*\(|POLYGON\s*\(\()([^()]*)\)", 1)
    pair = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.struct(F.split(p, r"\s+")[0].try_cast("double").alias("x"), F.get(F.split(p, r"\s+"), F.lit(1)).try_cast("double").alias("y")))
    return F.when(body != "", pair)


def tile_envelope(z: Column, x: Column, y: Column) -> Column:
    """Box of a tile; y counts from the top."""
    width = F.lit(TILE_RESOLUTION * TILE_PIXELS) / F.pow(F.lit(2.0), z)
    min_x, max_y = F.lit(TILE_MIN_X) + x * width, F.lit(TILE_MAX_Y) - y * width
    return F.struct(min_x.alias("min_x"), (max_y - width).alias("min_y"), (min_x + width).alias("max_x"), max_y.alias("max_y"))


def tile_of(z: Column, x: Column, y: Column) -> Column:
    """The tile in which a point lies."""
    width = F.lit(TILE_RESOLUTION * TILE_PIXELS) / F.pow(F.lit(2.0), z)
    return F.struct(F.floor((x - TILE_MIN_X) / width).cast("int").alias("tx"), F.floor((F.lit(TILE_MAX_Y) - y) / width).cast("int").alias("ty"))


def level_for_zoom(z: Column) -> Column:
    """The generalisation level that serves a zoom; null means the source itself."""
    return F.when(z <= 6, 6).when(z <= 8, 8).when(z <= 10, 10)


def visible_at(df: DataFrame, tolerance: float) -> DataFrame:
    """Drop what is smaller than ``tolerance`` both ways (needs with_box)."""
    return df.where((F.col("max_x") - F.col("min_x") >= tolerance) | (F.col("max_y") - F.col("min_y") >= tolerance))


def simplify(points: Column, tolerance: float) -> Column:
    """Thin out a line: a point stays if it is ``tolerance`` or more from the last one kept; the ends stay."""
    kept = F.aggregate(
        points,
        F.slice(points, 1, 1),
        lambda acc, p: F.when(F.pow(p["x"] - F.element_at(acc, -1)["x"], 2) + F.pow(p["y"] - F.element_at(acc, -1)["y"], 2) >= tolerance * tolerance, F.concat(acc, F.array(p))).otherwise(acc),
    )
    return F.when(F.element_at(kept, -1) == F.element_at(points, -1), kept).otherwise(F.concat(kept, F.slice(points, -1, 1)))


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def choose_candidate(candidates: Column, median: Column, spread: float = 1000.0) -> Column:
    """The best of several geometries (struct with kind, x, y): all near together: the first; else an address; else the one
    nearest to the municipal median, areas before others at one distance; else the medoid of three or more; else the first
    area; else the first. Quadratic in the candidates, which are those of one object (a notice has some 16 at most)."""
    far = F.aggregate(F.flatten(F.transform(candidates, lambda a: F.transform(candidates, lambda b: _distance(a, b)))), F.lit(0.0), lambda s, v: F.greatest(s, v))
    address = F.get(F.filter(candidates, lambda c: c["kind"] == "Adres"), F.lit(0))
    nearest = F.array_min(F.transform(candidates, lambda c, i: F.struct(_distance(c, median).alias("d"), F.when(c["kind"] == "Vlak", 0).otherwise(1).alias("k"), i.alias("i"))))
    medoid = F.array_min(F.transform(candidates, lambda a, i: F.struct(F.aggregate(candidates, F.lit(0.0), lambda s, b: s + _distance(a, b)).alias("d"), i.alias("i"))))
    first = F.get(candidates, F.lit(0))
    return (
        F.when(far < spread, first)
        .when(address.isNotNull(), address)
        .when(median.isNotNull(), F.get(candidates, nearest["i"]))
        .when(F.size(candidates) >= 3, F.get(candidates, medoid["i"]))
        .otherwise(F.coalesce(F.get(F.filter(candidates, lambda c: c["kind"] == "Vlak"), F.lit(0)), first))
    )


def median_centre(df: DataFrame, group: str, x: str = "x", y: str = "y") -> DataFrame:
    """Median centre per group."""
    return df.groupBy(group).agg(F.percentile(x, 0.5).alias("mx"), F.percentile(y, 0.5).alias("my"))


def raster_sample(points: DataFrame, raster: DataFrame, value: str, x: str = "x", y: str = "y", step: float = 100.0) -> DataFrame:
    """Value of the raster cell of each point (cells by half-even rounding); negative values mean no data."""
    keyed = points.withColumns({"gx": F.bround(F.col(x) / step).cast("int"), "gy": F.bround(F.col(y) / step).cast("int")})
    return keyed.join(raster, ["gx", "gy"], "left").withColumn(value, F.when(F.col(value) >= 0, F.col(value)))


#: Published coefficients of the national grid's polynomial in seconds of arc, by powers of dx and dy (100 km).
DEGREES_NORTH = {(0, 1): 3235.65389, (2, 0): -32.58297, (0, 2): -0.2475, (2, 1): -0.84978, (0, 3): -0.0655, (2, 2): -0.01709, (1, 0): -0.00738, (4, 0): 0.0053, (2, 3): -0.00039, (4, 1): 0.00033, (1, 1): -0.00012}
DEGREES_EAST = {(1, 0): 5260.52916, (1, 1): 105.94684, (1, 2): 2.45656, (3, 0): -0.81885, (1, 3): 0.05594, (3, 1): -0.05607, (0, 1): 0.01199, (3, 2): -0.00256, (1, 4): 0.00128, (0, 2): 0.00022, (2, 0): -0.00022, (5, 0): 0.00026}
GRID_ORIGIN, DEGREES_ORIGIN = (155000.0, 463000.0), (5.38720621, 52.1551744)


def to_degrees(x: Column, y: Column) -> Column:
    """Struct (lon, lat) of metres in the national grid, by its polynomial (within a metre)."""
    dx, dy = (x - GRID_ORIGIN[0]) / 100000.0, (y - GRID_ORIGIN[1]) / 100000.0
    total = lambda k: sum((c * F.pow(dx, F.lit(p)) * F.pow(dy, F.lit(q)) for (p, q), c in k.items()), F.lit(0.0)) / 3600.0
    return F.struct((DEGREES_ORIGIN[0] + total(DEGREES_EAST)).alias("lon"), (DEGREES_ORIGIN[1] + total(DEGREES_NORTH)).alias("lat"))
