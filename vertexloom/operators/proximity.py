"""Points near other points, or inside rectangles, by grid-cell equi-joins with exact verification.

Near pairs: cells a few radii wide; a point is filed in its own cell and looked up from the at most four cells its search square touches,
then great-circle distance decides. Rectangles: filed in at most 3 x 3 cells of a grid fitted to their longer side; a point looks up one cell
per grid in use, then comparison decides. Polygons: as rectangles by their boxes, then the parity of edges decides. Cells holding too many points for one task are salted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vertexloom.common import key_salts, salted_join, stored
from vertexloom.functions.geometry import contains_point, geometry_bbox
from vertexloom.functions.projection import geometry_between

EARTH_M = 6_371_008.8  # mean radius, for distances
MERCATOR_M = 6_378_137.0  # radius of spherical Web Mercator
BROADCAST_RECTS = 50_000  # up to so many rectangles (<= 9 cells each, about 50 bytes a cell) are broadcast


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(MERCATOR_M))


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(MERCATOR_M))) - F.lit(math.pi / 2))


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres of points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def usable(lon: Column, lat: Column) -> Column:
    """A position on the globe other than exactly (0, 0); null and NaN are none."""
    ok = lon.between(-180.0, 180.0) & lat.between(-90.0, 90.0) & ~F.isnan(lon) & ~F.isnan(lat) & ~((lon == 0.0) & (lat == 0.0))
    return F.coalesce(ok, F.lit(False))


def metric_files(file_header: DataFrame) -> DataFrame:
    """(file_id, metric): the files whose coordinates are Web Mercator metres."""
    return file_header.where(F.col("crs.code") == 3857).select("file_id", F.lit(True).alias("metric")).where(F.col("file_id").isNotNull()).distinct()


def locations(vertices: DataFrame, stations: DataFrame, file_header: DataFrame) -> DataFrame:
    """(fid, file_id, lon, lat) of the Points of vertices and stations (``file_id`` null), once per ``fid``, in degrees.

    Unusable positions (see ``usable``; also null geometries and fewer than two ordinates) are no locations. Should the rows of one
    ``fid`` disagree, the smallest (file, longitude, latitude) holds. Rows with a null ``fid`` are left out.
    """
    xy = lambda i: F.try_element_at("geom.xy", F.lit(i))
    point = (F.col("geom.type") == 1) & F.col("fid").isNotNull()
    v = vertices.where(point).select("fid", "file_id", xy(1).alias("x"), xy(2).alias("y")).join(metric_files(file_header), "file_id", "left")
    v = v.select(
        "fid", "file_id",
        F.when(F.col("metric"), mercator_lon(F.col("x"))).otherwise(F.col("x")).alias("lon"),
        F.when(F.col("metric"), mercator_lat(F.col("y"))).otherwise(F.col("y")).alias("lat"),
    )
    s = stations.where(point).select("fid", F.lit(None).cast("bigint").alias("file_id"), xy(1).alias("lon"), xy(2).alias("lat"))
    both = v.unionByName(s).where(usable(F.col("lon"), F.col("lat")))
    return both.groupBy("fid").agg(F.min(F.struct("file_id", "lon", "lat")).alias("p")).select("fid", "p.file_id", "p.lon", "p.lat")


class _Grid:
    """Latitude bands of ``CELL`` radii; each band has as many cells as fit, none narrower than ``CELL`` radii."""

    CELL = 4.0

    def __init__(self, radius_m: float):
        self.r = math.degrees(radius_m / EARTH_M) * (1 + 1e-9) + 1e-12  # a touch wide: the exact test follows
        self.h = max(self.CELL * self.r, 1e-5)

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / F.lit(self.h)).cast("bigint")

    def n_cells(self, band: Column) -> Column:
        low, high = band * F.lit(self.h) - 90.0, (band + 1) * F.lit(self.h) - 90.0
        edge = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
        return F.greatest(F.lit(1), F.floor(F.lit(360.0 / self.h) * F.cos(F.radians(edge)))).cast("bigint")

    @staticmethod
    def key(band: Column, n: Column, column: Column) -> Column:
        return F.shiftleft(band, 32) + F.pmod(column, n)

    def home(self, lon: Column, lat: Column) -> Column:
        n = self.n_cells(self.band(lat))
        return self.key(self.band(lat), n, F.floor((lon + 180.0) / 360.0 * n).cast("bigint"))

    def reached(self, lon: Column, lat: Column) -> Column:
        """All cells that the square of the radius around a point touches, each once."""
        polar = F.abs(lat) + self.r >= 90.0
        dlon = F.when(polar, F.lit(180.0)).otherwise(
            F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(self.r))) / F.cos(F.radians(lat))))) * (1 + 1e-9)
        )

        def row(band: Column) -> Column:
            n = self.n_cells(band)
            first, last = F.floor((lon - dlon + 180.0) / 360.0 * n).cast("bigint"), F.floor((lon + dlon + 180.0) / 360.0 * n).cast("bigint")
            return F.transform(F.sequence(first, F.least(last, first + n - 1)), lambda c: self.key(band, n, c))

        top = F.lit(math.floor(180.0 / self.h)).cast("bigint")
        bands = F.sequence(F.greatest(self.band(lat - self.r), F.lit(0).cast("bigint")), F.least(self.band(lat + self.r), top))
        return F.array_distinct(F.flatten(F.transform(bands, row)))


def location_classes(points: DataFrame) -> DataFrame:
    """(rep, lon, lat, n): one row per distinct position with its smallest ``fid`` and the number of points there."""
    return points.groupBy("lon", "lat").agg(F.min("fid").alias("rep"), F.count(F.lit(1)).alias("n"))


def _place(lon: Column, lat: Column) -> Column:
    """A position as one key; the two zeros are one."""
    return F.concat_ws(" ", (lon + 0.0).cast("string"), (lat + 0.0).cast("string"))


def membership(points: DataFrame, classes: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """(rep, fid): the class of every point, the smallest ``fid`` at its position. Positions with many points are salted; ``rows`` is the number of points if it is known."""
    classes = location_classes(points) if classes is None else classes
    place = _place(F.col("lon"), F.col("lat"))
    return salted_join(points.select("fid", place.alias("_place")), classes.select("rep", place.alias("_place")), "_place", F.col("fid"), rows=rows).select("rep", "fid")


def near_classes(points: DataFrame, radius_m: float, classes: DataFrame | None = None) -> DataFrame:
    """(rep_a, rep_b, metres): pairs of different positions at most ``radius_m`` apart, each once, as their smallest ``fid``s.

    ``points`` has unique ``fid`` and usable ``lon``, ``lat``; ``classes`` are their ``location_classes`` if they are known. Copies of one position count as one class, so a pile of them makes no
    pairs here. The date line and the poles are handled. An empty input gives no rows.
    """
    grid = _Grid(radius_m)
    reps = (stored(location_classes(points), "classes") if classes is None else classes).select("rep", "lon", "lat")
    here = reps.select(grid.home(F.col("lon"), F.col("lat")).alias("cell"), F.col("rep").alias("rep_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"))
    there = reps.select(F.explode(grid.reached(F.col("lon"), F.col("lat"))).alias("cell"), F.col("rep").alias("rep_b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"))
    met = salted_join(here, there, "cell", F.col("rep_a"), rows=reps.count()).where(F.col("rep_a") < F.col("rep_b"))
    metres = great_circle_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))
    return met.withColumn("metres", metres).where(F.col("metres") <= radius_m).select("rep_a", "rep_b", "metres")


def near_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """(fid_a, fid_b): every pair of points at most ``radius_m`` apart, smaller ``fid`` first, copies of one position included.

    Pairs of classes are spread over their members, classes of many members salted; ``near_classes`` with ``membership`` says the same in less.
    """
    classes = stored(location_classes(points), "classes")
    of = stored(membership(points, classes, points.count()), "membership")
    hot = key_salts(of, "rep", of.count())
    renamed = lambda r, f: of.toDF(r, f)
    near = near_classes(points, radius_m, classes).select("rep_a", "rep_b")
    half = salted_join(renamed("rep_a", "p"), near, "rep_a", F.col("p"), salts=hot).select("p", "rep_b")
    spread = salted_join(renamed("rep_b", "q"), half, "rep_b", F.col("q"), salts=hot).select("p", "q")
    several = classes.where("n > 1").select("rep")
    piles = salted_join(of, several, "rep", F.col("fid"), "left_semi", salts=hot)
    same = salted_join(piles.toDF("rep", "p"), piles.toDF("rep", "q"), "rep", F.col("p"), salts=hot).where(F.col("p") < F.col("q")).select("p", "q")
    return spread.unionByName(same).select(F.least("p", "q").alias("fid_a"), F.greatest("p", "q").alias("fid_b"))


def valid_rects(rects: DataFrame) -> DataFrame:
    """(rect_id, own, minx, maxx, miny, maxy) without the date line: rectangles with minx > maxx become the parts on either side of it.

    Rectangles with a null or NaN bound, or miny > maxy, hold nothing. Bounds are cut to the globe. ``rects`` has ``rect_id``, the four bounds and
    ``own`` (null, or a group whose points don't count).
    """
    b = ["minx", "miny", "maxx", "maxy"]
    ok = None
    for c in b:
        one = F.col(c).isNotNull() & ~F.isnan(c)
        ok = one if ok is None else ok & one
    part = lambda lo, hi: F.struct(lo.cast("double").alias("minx"), hi.cast("double").alias("maxx"))
    x0, x1 = F.col("minx"), F.col("maxx")
    parts = F.when(x0 > x1, F.array(part(x0, F.lit(180.0)), part(F.lit(-180.0), x1))).otherwise(F.array(part(x0, x1)))
    out = rects.where(ok & (F.col("miny") <= F.col("maxy"))).select("rect_id", "own", F.explode(parts).alias("p"), "miny", "maxy")
    out = out.select(
        "rect_id", "own",
        F.greatest(F.col("p.minx"), F.lit(-180.0)).alias("minx"), F.least(F.col("p.maxx"), F.lit(180.0)).alias("maxx"),
        F.greatest("miny", F.lit(-90.0)).alias("miny"), F.least("maxy", F.lit(90.0)).alias("maxy"),
    )
    return out.where((F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")))


_LEVELS = 10  # cells of 360 / 4 ** level degrees


def _level(width: Column) -> Column:
    """The finest level at which a span of this width touches at most three cells."""
    k = F.floor(F.log(F.lit(720.0) / F.greatest(width, F.lit(1e-9))) / F.lit(math.log(4.0)))
    return F.greatest(F.lit(0), F.least(k, F.lit(_LEVELS - 1))).cast("int")


def _cell(v: Column, level: Column) -> Column:
    return F.floor((v + 180.0) * F.pow(F.lit(4.0), level) / 360.0).cast("bigint")


def _cell_key(k: Column, ix: Column, iy: Column) -> Column:
    return F.shiftleft(k.cast("bigint"), 48) + F.shiftleft(ix, 24) + iy


def _used(rects: DataFrame) -> dict[int, int]:
    """Level -> number of rectangles with it: at most ``_LEVELS`` rows."""
    return {r.k: r.n for r in rects.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}


def points_in_rects(points: DataFrame, rects: DataFrame) -> DataFrame:
    """(rect_id, fid): every point inside a closed rectangle, except points whose ``file_id`` is the rectangle's ``own``.

    See ``valid_rects`` for odd rectangles. Each rectangle is filed in the grid of its longer side; the grids in use (at most 10) and the number of rectangles are counted first. A point looks up one
    cell per grid in use. Up to ``BROADCAST_RECTS`` rectangles their cells are broadcast and nothing else moves; beyond, both sides are joined on the cell, hot cells salted.
    Points have unique ``fid``.
    """
    return _points_in(points, valid_rects(rects)).select("rect_id", "fid")


def _points_in(points: DataFrame, valid: DataFrame) -> DataFrame:
    r = valid.withColumn("k", _box_level(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")))
    used = _used(r)
    if not used:
        return points.select(F.lit(None).cast(valid.schema["rect_id"].dataType).alias("rect_id"), "fid", "lon", "lat").where("false")
    cells = r.withColumn("c", F.explode(_box_cells(F.col("k"))))
    cells = cells.select(_cell_key(F.col("k"), F.col("c.ix"), F.col("c.iy")).alias("cell"), "rect_id", "own", "minx", "maxx", "miny", "maxy")
    lookups = F.array(*(_cell_key(F.lit(k), _cell(F.col("lon"), F.lit(k)), _cell(F.col("lat"), F.lit(k))) for k in sorted(used)))
    looking = points.select("fid", "file_id", "lon", "lat", F.explode(lookups).alias("cell"))
    if sum(used.values()) <= BROADCAST_RECTS:
        met = looking.join(F.broadcast(cells), "cell")
    else:
        met = salted_join(looking, cells, "cell", F.col("fid"))
    inside = F.col("lon").between(F.col("minx"), F.col("maxx")) & F.col("lat").between(F.col("miny"), F.col("maxy"))
    foreign = F.col("own").isNull() | F.col("file_id").isNull() | (F.col("own") != F.col("file_id"))
    return met.where(inside & foreign).select("rect_id", "fid", "lon", "lat")


def polygons(vertices: DataFrame, file_header: DataFrame) -> DataFrame:
    """(poly_id, geom): the polygons and multi-polygons of vertices in degrees, once per ``fid`` (of unequal rows the smallest geometry)."""
    rows = vertices.where(F.col("geom.type").isin(3, 6) & F.col("fid").isNotNull()).select("fid", "file_id", "geom")
    rows = rows.groupBy("fid").agg(F.min(F.struct("file_id", "geom")).alias("r")).select(F.col("fid").alias("poly_id"), "r.*")
    rows = rows.join(metric_files(file_header), "file_id", "left")
    return rows.select("poly_id", F.when(F.col("metric"), geometry_between(F.col("geom"), 3857, 4326)).otherwise(F.col("geom")).alias("geom"))


def points_in_polygons(points: DataFrame, polys: DataFrame) -> DataFrame:
    """(poly_id, fid): every point inside a polygon or multi-polygon (poly_id, geom), holes aside; see ``geometry.contains_point`` for points on an edge.

    Polygons are filed by their boxes as rectangles are; points in a box are then joined with the shape, polygons with many of them salted, and tested exactly. Rings across the date line are taken as
    they are written. Polygons without coordinates, or with a coordinate that is no number, hold nothing.
    """
    parts = F.coalesce(F.flatten(F.transform(F.col("geom.parts"), lambda p: F.coalesce(p["xy"], F.array().cast("array<double>")))), F.array().cast("array<double>"))
    odd = F.exists(F.concat(F.coalesce("geom.xy", F.array().cast("array<double>")), parts), lambda v: v.isNull() | F.isnan(v))
    shaped = polys.where(~odd & F.col("poly_id").isNotNull()).withColumn("b", geometry_bbox(F.col("geom")))
    rects = shaped.where("b IS NOT NULL").select(F.col("poly_id").alias("rect_id"), F.lit(None).cast("bigint").alias("own"), "b.minx", "b.miny", "b.maxx", "b.maxy")
    near = stored(_points_in(points, valid_rects(rects)).withColumnRenamed("rect_id", "poly_id"), "near")
    met = salted_join(near, shaped.select("poly_id", "geom"), "poly_id", F.col("fid"), rows=near.count())
    return met.where(contains_point(F.col("geom"), F.col("lon"), F.col("lat"))).select("poly_id", "fid")


def envelopes(file_header: DataFrame) -> DataFrame:
    """The rectangles of file headers in degrees, once per file (of repeated rows the smallest envelope). Only envelopes of four numbers."""
    e = lambda i: F.try_element_at("envelope", F.lit(i))
    once = (
        file_header.where((F.size("envelope") == 4) & F.col("file_id").isNotNull())
        .groupBy("file_id")
        .agg(F.min(F.struct(e(1).alias("a"), e(2).alias("b"), e(3).alias("c"), e(4).alias("d"), F.coalesce(F.col("crs.code") == 3857, F.lit(False)).alias("metric"))).alias("e"))
    )
    lon = lambda c: F.when(F.col("e.metric"), mercator_lon(F.col(c))).otherwise(F.col(c))
    lat = lambda c: F.when(F.col("e.metric"), mercator_lat(F.col(c))).otherwise(F.col(c))
    return once.select(
        F.col("file_id").alias("rect_id"), F.col("file_id").alias("own"),
        lon("e.a").alias("minx"), lat("e.b").alias("miny"), lon("e.c").alias("maxx"), lat("e.d").alias("maxy"),
    )


def region_rects(regions: DataFrame) -> DataFrame:
    """The rectangles of a region table, repeated rows once, null ids left out."""
    return regions.where(F.col("region_id").isNotNull()).select(
        F.col("region_id").alias("rect_id"), F.lit(None).cast("bigint").alias("own"), "minx", "miny", "maxx", "maxy"
    ).distinct()


def _box_level(w: Column, h: Column) -> Column:
    return _level(F.greatest(w, h))


def _box_cells(k: Column) -> Column:
    """The cells of level ``k`` that the row's box touches; at most 3 x 3 if the box has that level or a finer one."""
    ix = F.sequence(_cell(F.col("minx"), k), _cell(F.col("maxx"), k))
    iy = F.sequence(_cell(F.col("miny"), k), _cell(F.col("maxy"), k))
    return F.flatten(F.transform(ix, lambda x: F.transform(iy, lambda y: F.struct(x.alias("ix"), y.alias("iy")))))


def boxes_meet(boxes: DataFrame, rects: DataFrame) -> DataFrame:
    """(rect_id, box_id): boxes and rectangles that meet, touching included, each pair once.

    ``boxes`` has box_id, ``rects`` rect_id, both minx, miny, maxx, maxy within the globe; a null or NaN bound, or a minimum above its maximum, meets nothing. Each box belongs to the
    grid fitted to its size. A pair meets in the coarser of its two grids: one side is filed in its own grid, the other looked up there. A pair with several common cells is
    kept in the one that holds the lower left corner of the overlap. Hot cells are salted.
    """
    sides = []
    for df, name in ((boxes, "box_id"), (rects, "rect_id")):
        ok = (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy")) & ~F.isnan("maxx") & ~F.isnan("maxy") & F.col("minx").between(-180.0, 180.0) & F.col("miny").between(-180.0, 180.0)
        rows = df.where(ok).select(F.col(name).alias("id"), *(F.col(c).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")))
        rows = rows.withColumn("maxx", F.least("maxx", F.lit(180.0))).withColumn("maxy", F.least("maxy", F.lit(180.0)))
        sides.append(stored(rows.withColumn("k", _box_level(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"))), name))
    name_cell = lambda df: df.withColumn("cell", _cell_key(F.col("g"), F.col("c.ix"), F.col("c.iy"))).drop("c")

    def own(df: DataFrame) -> DataFrame:
        return name_cell(df.withColumn("g", F.col("k")).withColumn("c", F.explode(_box_cells(F.col("k")))))

    def up(df: DataFrame, strictly: bool, levels: list[int]) -> DataFrame:
        top = F.col("k") - (1 if strictly else 0)
        rows = df.withColumn("g", F.explode(F.filter(F.array(*(F.lit(k) for k in levels)), lambda g: g <= top)))
        return name_cell(rows.withColumn("c", F.explode(_box_cells(F.col("g")))))

    def pair(filed: DataFrame, looked: DataFrame, names: tuple[str, str], most: int) -> DataFrame:
        a = filed.select("cell", F.col("id").alias(names[0]), *(F.col(c).alias(f"a_{c}") for c in ("minx", "miny", "maxx", "maxy")))
        b = looked.select("cell", "g", F.col("id").alias(names[1]), *(F.col(c).alias(f"b_{c}") for c in ("minx", "miny", "maxx", "maxy")))
        met = salted_join(b, a, "cell", F.col(names[1]), rows=most)
        x, y = F.greatest("a_minx", "b_minx"), F.greatest("a_miny", "b_miny")
        meet = (x <= F.least("a_maxx", "b_maxx")) & (y <= F.least("a_maxy", "b_maxy"))
        return met.where(meet & (F.col("cell") == _cell_key(F.col("g"), _cell(x, F.col("g")), _cell(y, F.col("g"))))).select("rect_id", "box_id")

    b, r = sides
    in_b, in_r = sorted(_used(b)), sorted(_used(r))  # only grids that the other side is filed in are looked up
    if not in_b or not in_r:
        return boxes.sparkSession.createDataFrame([], T.StructType([T.StructField("rect_id", r.schema["id"].dataType), T.StructField("box_id", b.schema["id"].dataType)]))
    cells = lambda df, levels: 9 * df.count() * len(levels)
    return pair(own(r), up(b, False, in_r), ("rect_id", "box_id"), cells(b, in_r)).unionByName(pair(own(b), up(r, True, in_b), ("box_id", "rect_id"), cells(r, in_b)))
