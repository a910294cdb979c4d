import json
import os
import re

import pytest
from pyspark.sql import functions as F

from vertexloom.functions import geometry as G
from vertexloom.plans import graph_queries
from vertexloom.sources import geojson
from vertexloom.types import GEOMETRY, GEOMETRY_TYPES

DATA = "/root/testdata/sf0.001"
POINT, LINE = {"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}
FEATURE = {"type": "Feature", "geometry": LINE, "properties": {}}


def test_features_in_every_wrapping(spark):
    nested = {"type": "GeometryCollection", "geometries": [POINT, {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 5], [5, 5]]]]}]}]}
    texts = [
        json.dumps(FEATURE), json.dumps(json.dumps(FEATURE)), json.dumps({"type": "FeatureCollection", "features": [FEATURE, {**FEATURE, "geometry": json.dumps(POINT)}, {**FEATURE, "geometry": None}, 5]}),
        json.dumps(POINT), json.dumps(nested), json.dumps([FEATURE]), '{"type": "FeatureCollection", "features": []}', None, "", "{", "null", '{"type": "Feature", "geometry": {"type": "Point"}}',
        '{"type": "GeometryCollection", "geometries": [' * 400 + json.dumps(POINT) + "]}" * 400,
    ]
    rows = geojson.payload_geometries(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect()
    got = sorted((r.id, r.position, r.state, r.geom and r.geom.type, r.geom and r.geom.xy, r.geom and r.geom.parts and len(r.geom.parts)) for r in rows)
    line, point = (2, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0], None)
    assert got == [
        (0, 0, "geometry", *line), (1, 0, "geometry", *line), (2, 0, "geometry", *line), (2, 1, "geometry", *point), (2, 2, "none", None, None, None), (2, 3, "broken", None, None, None),
        (3, 0, "geometry", *point), (4, 0, "geometry", 7, None, 5), (5, 0, "geometry", *line), (6, 0, "none", None, None, None), *((i, 0, "broken", None, None, None) for i in range(7, 12)), (12, 0, "geometry", 7, None, 400),
    ]
    held = {r.id: r.geom.within for r in rows if r.geom}
    assert held[4] == [-1, -1, 1, 2, 2] and held[3] is None and held[12] == list(range(-1, 399))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_only_broken_payloads_have_no_geometry(spark):
    want = {}
    for r in spark.read.parquet(f"{DATA}/raw_features.parquet").collect():
        try:
            value = json.loads(r.payload)
            value = json.loads(value) if isinstance(value, str) else value
        except (ValueError, TypeError):
            value = None
        for i, f in enumerate(value["features"] if value and "features" in value else [value]):
            g = (f["geometry"] if "geometry" in f else f) if f else None
            want[r.raw_id, i] = json.loads(g) if isinstance(g, str) else g
    rows = graph_queries.geojson_parse(spark, DATA).collect()
    assert sorted((r.raw_id, r.position) for r in rows) == sorted(want) and sum(r.type is not None for r in rows) > len(rows) * 0.9
    for r in rows:
        g = want[r.raw_id, r.position]
        if r.type is None:
            assert not re.search(r"\[-?\d", json.dumps(g)), g
        else:
            assert r.type == GEOMETRY_TYPES[g["type"]]


def test_members_of_dirty_collections(spark):
    hull = lambda members: json.dumps({"type": "GeometryCollection", "geometries": members})
    texts = [hull([POINT, None, LINE]), hull(POINT), hull([POINT, {"type": "Polygon", "coordinates": None}]), hull(None), hull([])]
    got = [next(geojson.geometries_of(t)) for t in texts]
    assert [(g and len(g["parts"]), s) for _, g, s in got] == [(2, "geometry"), (1, "geometry"), (1, "partial"), (None, "broken"), (0, "geometry")]


def test_same_shape_sees_every_difference(spark):
    square = "{'type': 3, 'xy': [0.0, 0.0, 1.0, 0.0], 'ends': [1, 2]}"
    shapes = ["{'type': 2, 'xy': [1.0, 2.0, 3.0, 4.0]}", "{'type': 2, 'xy': [3.0, 4.0, 1.0, 2.0]}", "{'type': 2, 'xy': [1.0, 2.0, 3.0, 4.0], 'z': ['NaN', 5.0]}", square, square.replace("[1, 2]", "[2, 2]")]
    shapes += [f"{{'type': 6, 'parts': [{p}]}}" for p in (square, square + "," + square, square.replace("1.0", "2.0"), "")]
    rows = spark.createDataFrame([(i, s.replace("'", '"')) for i, s in enumerate(shapes)], "i int, t string").select("i", F.from_json("t", GEOMETRY).alias("g"))
    both = rows.toDF("i", "a").crossJoin(rows.toDF("j", "b"))
    assert sorted(tuple(r) for r in both.where(G.same_shape(F.col("a"), F.col("b"))).select("i", "j").collect()) == [(i, i) for i in range(len(shapes))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_the_round_trip_counts_no_changed_geometry(spark, monkeypatch):
    whole, real = graph_queries.geojson_roundtrip(spark, DATA), G.from_geojson
    kinds = spark.read.parquet(f"{DATA}/vertices.parquet").where("geom IS NOT NULL AND NOT coalesce(size(geom.xy) > 2, false) AND NOT coalesce(size(geom.parts) > 1, false)").count()
    total = whole.agg(F.sum("n_rows").alias("n")).collect()[0].n

    def reversed_(text):
        g = real(text)
        return g.withField("xy", F.reverse(g["xy"])).withField("parts", F.slice(g["parts"], 1, 1))

    monkeypatch.setattr(G, "from_geojson", reversed_)
    changed = graph_queries.geojson_roundtrip(spark, DATA).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")).collect()[0].n
    assert changed <= kinds < total
