"""Geometry functions and helpers against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from test_container import chain, geom
from vertexloom import common
from vertexloom.functions import geometry as G
from vertexloom.functions import projection as P
from vertexloom.operators import graph, proximity
from vertexloom.sources import bytes as B
from vertexloom.sources import codec, graphs, rtree
from vertexloom.types import GEOMETRY, Rect


def frame(spark, shapes):
    return spark.createDataFrame(list(enumerate(shapes)), f"i int, geom {GEOMETRY}")


SQUARE = [0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0, 0.0, 0.0]
HOLE = [2.0, 2.0, 4.0, 2.0, 4.0, 4.0, 2.0, 4.0, 2.0, 2.0]
PART = {"type": 3, "xy": SQUARE, "z": None, "m": None, "ends": None}


def inside(rings, x, y):
    odd = False
    for ring in rings:
        n = len(ring) // 2
        for i in range(n):
            j = (i + 1) % n
            x1, y1, x2, y2 = ring[2 * i], ring[2 * i + 1], ring[2 * j], ring[2 * j + 1]
            if (y1 <= y < y2 or y2 <= y < y1) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) < x:
                odd = not odd
    return odd


def test_points_in_polygons_equal_brute_force(spark):
    rnd = random.Random(5)
    ring = lambda: [v for a in sorted(rnd.uniform(0, 6.28) for _ in range(7)) for v in (rnd.uniform(-170, 170) * 0 + 20 * math.cos(a) + rnd.choice((0, 40)), rnd.uniform(5, 20) * math.sin(a))]
    shapes = [geom(3, SQUARE + HOLE, ends=[5, 10]), geom(6, parts=[PART, {**PART, "xy": [v + 30 for v in HOLE]}]), geom(3, []), geom(3), None, geom(3, [0.0, math.nan, 1.0, 1.0, 2.0, 0.0]), geom(1, [1.0, 1.0])]
    rings = [[SQUARE, HOLE], [SQUARE, [v + 30 for v in HOLE]], [], [], [], [], []]
    for _ in range(12):
        r = ring()
        shapes.append(geom(3, r))
        rings.append([r])
    points = [(i, None, rnd.uniform(-30, 70), rnd.uniform(-25, 45)) for i in range(400)] + [(1000, 3, 5.0, 5.0), (1001, 3, 3.0, 3.0), (1002, 3, 0.0, 5.0)]
    df = spark.createDataFrame(points, "fid bigint, file_id bigint, lon double, lat double")
    got = sorted(tuple(r) for r in proximity.points_in_polygons(df, frame(spark, shapes).withColumnRenamed("i", "poly_id")).collect())
    assert got == sorted((k, p[0]) for k, rs in enumerate(rings) for p in points if inside(rs, p[2], p[3])) and len(got) > 50
    assert proximity.points_in_polygons(df, frame(spark, []).withColumnRenamed("i", "poly_id")).count() == 0


def test_layouts_there_and_back(spark):
    shapes = [
        geom(1, [1.0, 2.0]), geom(2, [1.0, 2.0, 3.0, 4.0], z=[5.0, 6.0]), geom(2, [1.0, 2.0, 3.0, 4.0], m=[7.0, 8.0]), geom(3, SQUARE + HOLE, [0.5] * 10, [0.25] * 10, [5, 10]), geom(6, parts=[PART]), geom(7, parts=[PART]),
        geom(2, []), None, geom(3),
    ]
    rows = {r.i: r.g for r in frame(spark, shapes).select("i", G.laid_out(F.col("geom")).alias("g")).collect()}
    assert (rows[0].layout, rows[0].flat, rows[0].ends) == ("XY", [1.0, 2.0], None)
    assert rows[1].layout == "XYZ" and rows[1].flat == [1.0, 2.0, 5.0, 3.0, 4.0, 6.0] and rows[2].layout == "XYM"
    assert rows[3].layout == "XYZM" and rows[3].ends == [20, 40] and rows[3].flat[:4] == [0.0, 0.0, 0.5, 0.25]
    assert rows[4].type == "MultiPolygon" and [(p.flat, p.ends) for p in rows[4].polygons] == [(SQUARE, [10])]
    assert rows[5] is None and rows[6].flat == [] and rows[7] is None and rows[8] is None
    back = frame(spark, shapes).select("i", "geom", G.laid_out(F.col("geom")).alias("g")).where("i < 4").select("i", "geom", G.split_layout(F.col("g.flat"), F.col("g.layout"), F.col("g.ends")).alias("s"))
    for r in back.collect():
        assert (r.s.xy, r.s.z, r.s.m) == (r.geom.xy, r.geom.z, r.geom.m) and (r.s.ends == r.geom.ends)


def test_rendering(spark):
    shapes = [geom(6, parts=[PART, {**PART, "xy": HOLE}]), geom(2, [1.0, 2.0, 3.0, 4.0], z=[5.0, 6.0]), geom(7, parts=[PART]), geom(3), None]
    rows = [r.r for r in frame(spark, shapes).orderBy("i").select(G.render_feature(F.col("geom"), strict=False).alias("r")).collect()]
    assert tuple(rows[0]) == ("Polygon", SQUARE + HOLE, [20], 2) and tuple(rows[1]) == ("LineString", [1.0, 2.0, 5.0, 3.0, 4.0, 6.0], [6], 3) and rows[2:] == [None] * 3
    for i in (2, 3):
        with pytest.raises(Exception, match="can't be drawn"):
            frame(spark, shapes).where(F.col("i") == i).select(G.render_feature(F.col("geom"))).collect()


def test_loading_strategies(spark, tmp_path):
    p = str(tmp_path / "g.bin")
    graphs.write_graph(chain(spark, 30), None, p, 4326, 4)
    tiles = lambda r: [Rect(2, 2, 4, 4), Rect(4, 4, 5, 5), Rect(20, 20, 21, 21)]
    assert sorted(r.fid for r in graphs.load_extent(spark, p, Rect(0, 0, 9, 9), 4326, 4326, tiles).collect()) == [2, 3, 4, 5, 20, 21]
    assert graphs.load_extent(spark, p, Rect(0, 0, 9, 9), 4326, 4326, lambda r: []).count() == 0
    drawn = graphs.load_extent(spark, p, Rect(3, 3, 3, 3), 4326, 4326, render=True).collect()
    assert [(tuple(r.render), r.name) for r in drawn] == [(("Point", [3.0, 3.0], [2], 2), "node-3")]
    with pytest.raises(Exception, match="minimum is above"):
        graphs.read_vertices(spark, p, Rect(5, 0, 1, 9)).count()


def test_known_finite_boxes_are_pushed_to_the_scan(spark, tmp_path):
    boxes = spark.range(100).select("id", F.struct(*(F.col("id").cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy"))).alias("bbox"))
    boxes.write.parquet(str(tmp_path / "b"))
    rows = spark.read.parquet(str(tmp_path / "b"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = rows.where(G.meets(F.col("bbox"), 10, 10, 20, 20, finite=True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(f"{op}(bbox.{c}," in plan.split("PushedFilters")[1] for op, c in (("LessThanOrEqual", "minx"), ("GreaterThanOrEqual", "maxy")))
    assert found.count() == rows.where(G.meets(F.col("bbox"), 10, 10, 20, 20)).count() == 11


def test_null_and_nan_bounds_give_null(spark):
    df = spark.createDataFrame([(0.0, 1.0, 2.0, 3.0), (math.nan, 1.0, 2.0, 3.0), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    rows = df.select(G.rect_polygon(*(F.col(c) for c in "abcd")).alias("p"), P.extent_between(*(F.col(c) for c in "abcd"), 4326, 4326).alias("e")).collect()
    assert [r.p is None for r in rows] == [r.e is None for r in rows] == [False, True, True] and tuple(rows[0].e) == (0.0, 1.0, 2.0, 3.0)


def test_hot_keys_get_salts_by_partition(spark, monkeypatch):
    df = spark.range(1000).select(F.when(F.col("id") < 500, 1).when(F.col("id") < 640, 2).otherwise(F.col("id")).alias("k"))
    assert common.key_salts(df, "k") == {4: [1], 2: [2]}  # of 4 partitions: 500 of 1000 rows are 4 halves of 125, 140 two
    monkeypatch.setattr(common, "TASK_ROWS", 1000)
    assert common.key_salts(df, "k") == {}


def test_neighbour_pages(spark):
    edges = spark.range(3000).selectExpr("CASE WHEN id < 2500 THEN 1 ELSE id END AS src", "id % 2100 AS dst").union(spark.createDataFrame([(None, 1), (2, None)], "src bigint, dst bigint"))
    rows = graph.adjacency(edges, 500).collect()
    hot = [r for r in rows if r.fid == 1]
    assert len(hot) == 5 and sorted(v for r in hot for v in r.neighbours) == list(range(2100)) and all(r.neighbours == sorted(r.neighbours) for r in rows)
    assert {(r.fid, r.n_neighbours) for r in graph.neighbour_counts(edges).collect()} == {(f, sum(len(r.neighbours) for r in rows if r.fid == f)) for f in {r.fid for r in rows}}


def test_http_answers_that_are_short(monkeypatch):
    data = bytes(range(200))

    class Answer:
        status = 206

        def __init__(self, a, b):
            self.data, self.headers = data[a : min(b + 1, a + limit, len(data))], {"Content-Range": f"bytes {a}-{b}/{len(data)}"}

        def __enter__(self):
            return self

        def __exit__(self, *x):
            pass

        def read(self):
            return self.data

    monkeypatch.setattr(B.urllib.request, "urlopen", lambda r: Answer(*map(int, r.headers["Range"][6:].split("-"))))
    limit = 7
    source = B.HttpBytes("http://x/y")
    assert source.read(10, 30) == data[10:40] and source.read(190, 50) == data[190:] and source.requests > 5
    limit = 0
    with pytest.raises(codec.ContainerError, match="gives 0 of 5"):
        source.read(3, 5)


def test_neighbours_on_the_curve_are_neighbours():
    import numpy as np

    x, y = np.meshgrid(np.arange(32), np.arange(32))
    d = rtree.hilbert(x.ravel() * 2048, y.ravel() * 2048)  # a grid of the curve of order 5
    order = np.argsort(d)
    steps = np.abs(np.diff(x.ravel()[order])) + np.abs(np.diff(y.ravel()[order]))
    assert (steps == 1).all() and len(set(d.tolist())) == 1024
    tree = np.zeros(1000, rtree.NODE)
    tree["minx"] = tree["maxx"] = tree["miny"] = tree["maxy"] = np.arange(1000)
    reads = []
    nodes = rtree.build(tree, 4)
    found = rtree.search(1000, 4, (10, 10, 900, 900), lambda a, b: reads.append((a, b)) or nodes[a:b], gap=10_000)
    assert len(found) == 891 and len(reads) == len(rtree.level_sizes(1000, 4))
