import http.server
import os
import threading
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertexloom.functions import geometry as G
from vertexloom.plans import graph_queries
from vertexloom.sources import codec, graphs, rtree
from vertexloom.sources.flat import Reader
from vertexloom.types import COLUMN_TYPES, GEOMETRY, Column, GraphMeta, Meta, Rect, column_for


def geom(kind, xy=None, z=None, m=None, ends=None, parts=None):
    return {"type": kind, "xy": xy, "z": z, "m": m, "ends": ends, "parts": parts}


ALL = [Column(n, i) for i, n in enumerate(COLUMN_TYPES)]
VALUES = [-5, 250, True, -300, 60000, -70000, 4_000_000_000, -(2**62) - 1, Decimal(2**64 - 1), 0.5, 1.1, "é", '{"a": 1}', "2024-01-01T00:00:00Z", b"test"]


def test_all_column_types_round_trip():
    assert codec.decode_properties(codec.encode_properties(VALUES, ALL), ALL) == VALUES
    nothing = [None] * len(ALL)
    assert codec.encode_properties(nothing, ALL) == b"" and codec.decode_properties(None, ALL) == nothing
    with pytest.raises(codec.ContainerError):
        codec.encode_properties([300], [Column("b", 0)])
    with pytest.raises(codec.ContainerError):
        codec.encode_properties([1], [Column("b", 99)])


def test_unknown_column_ends_a_record():
    data = codec.encode_properties([1, 2, 3], [Column(n, 5) for n in "abc"])
    assert codec.decode_properties(data, [Column("a", 5)]) == [1]


def test_documented_edge_bytes():
    head = codec.encode_graph_header(GraphMeta(1, [Column("weight", 10)]))
    assert head == bytes.fromhex("0F000000 01000000 0100 0600 776569676874 0A")
    edge = codec.encode_edge(0, 1, codec.encode_properties([1.5], [Column("weight", 10)]))
    assert edge == bytes.fromhex("12000000 00000000 01000000 0000 000000000000F83F")
    assert codec.decode_edge(edge, 0)[:2] == (0, 1) and codec.decode_graph_header(head)[0].columns[0].name == "weight"


doubles = st.floats(allow_nan=False, width=64)
flat = st.builds(lambda k, pts, z: geom(k, [v for p in pts for v in p], [float(i) for i in range(len(pts))] if z else None), st.integers(1, 5), st.lists(st.tuples(doubles, doubles), max_size=5), st.booleans())


@settings(max_examples=60, deadline=None)
@given(st.recursive(flat, lambda g: st.builds(lambda ps: geom(7, parts=ps), st.lists(g, max_size=3)), max_leaves=6), st.binary(max_size=40))
def test_feature_round_trip(g, props):
    data = codec.encode_feature(g, props)
    assert len(data) % 8 == 0 and int.from_bytes(data[:4], "little") == len(data) - 4
    back, raw = codec.decode_feature(data, 0)
    blank = lambda x: {**x, "xy": x["xy"] if x["parts"] is None else None, "z": x["z"] or None, "parts": None if x["parts"] is None else [blank(p) for p in x["parts"]]}
    assert blank(back) == blank(g) and (raw or b"") == props


def test_doubles_are_aligned_and_header_round_trip():
    data = codec.encode_feature(geom(1, [1.0, 2.0]), b"abc")
    g = Reader.prefixed(data).table(0)
    assert (g._refers(1) + 4) % 8 == 0
    meta = Meta(3, 1, 16, [Column("a", 11, "T", "D", 1, 2, 3, False, True, True)], [0.0, 1.0, 2.0, 3.0], "n", {"org": "EPSG", "code": 4326, "name": "x", "description": None, "wkt": None, "code_string": None}, "t", "d", "m")
    assert codec.decode_header(codec.encode_header(meta)) == meta
    with pytest.raises(codec.ContainerError):
        codec.check_magic(b"abcdefgh")
    with pytest.raises(codec.ContainerError):
        codec.check_header_size(4)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
@pytest.mark.parametrize("s", [2, 16])
def test_tree(n, s):
    assert rtree.tree_bytes(n, s) == 40 * sum(rtree.level_sizes(n, s)) and rtree.level_bounds(n, s)[-1] == (0, 1)
    rnd = np.random.default_rng(n)
    leaves = np.zeros(n, rtree.NODE)
    leaves["minx"], leaves["miny"] = rnd.uniform(-100, 100, (2, n))
    leaves["maxx"], leaves["maxy"] = leaves["minx"] + 5, leaves["miny"] + 5
    leaves["offset"] = np.arange(n) * 8
    leaves["minx"][n // 2] = np.nan
    tree = rtree.build(leaves, s)
    for rect in ((-20, -20, 20, 20), (0, 0, 0, 0), (500, 500, 600, 600), (-1e9, -1e9, 1e9, 1e9)):
        got = rtree.search(n, s, rect, lambda a, b: tree[a:b])
        want = [i for i, x in enumerate(leaves) if not (rect[2] < x["minx"] or rect[3] < x["miny"] or rect[0] > x["maxx"] or rect[1] > x["maxy"])]
        assert got["item"].tolist() == want and got["offset"].tolist() == [8 * i for i in want]


def test_tree_errors():
    for n, s in ((5, 1), (0, 16)):
        with pytest.raises(ValueError):
            rtree.level_bounds(n, s)
    assert rtree.tree_bytes(0, 16) == 0


def chain(spark, n):
    rows = [(i, geom(1, [float(i), float(i)]), f"node-{i}") for i in range(n)]
    return spark.createDataFrame(rows, f"fid bigint, geom {GEOMETRY}, name string")


def test_graph_round_trip_and_sections(spark, tmp_path):
    p = str(tmp_path / "g.bin")
    edges = spark.createDataFrame([(0, 0, 1, 1.5, "edge-01"), (1, 1, 2, None, None), (2, 1, 2, 2.0, "again")], "eid bigint, src bigint, dst bigint, weight double, name string")
    graphs.write_graph(chain(spark, 3), edges, p, crs_code=4326)
    seen = []
    g = graphs.read_graph(spark, p, meta_fn=lambda m, gm: seen.append((m.features_count, m.geometry_type, gm.edge_count)))
    assert seen == [(3, 1, 3)] and g.meta.crs["code"] == 4326 and g.meta.name == "L1"
    assert [(r.fid, r.name, r.bbox.minx) for r in g.vertices.orderBy("fid").collect()] == [(0, "node-0", 0.0), (1, "node-1", 1.0), (2, "node-2", 2.0)]
    assert [tuple(r) for r in g.edges.orderBy("eid").collect()] == [tuple(r) for r in edges.orderBy("eid").collect()]
    assert graphs.read_vertices(spark, p, columns=["name"]).schema.names == ["fid", "bbox", "geom", "name"]
    assert graphs.read_vertices(spark, p, splitRecords=1).count() == 3 and graphs.read_edges(spark, p, splitRecords=2).count() == 3
    assert graphs.require_columns(g.edges, ["weight"]) is g.edges
    with pytest.raises(ValueError, match="speed"):
        graphs.require_columns(g.edges, ["speed"])


def test_absent_and_empty_edges_differ(spark, tmp_path):
    a, b = str(tmp_path / "a.bin"), str(tmp_path / "b.bin")
    none = spark.createDataFrame([], "eid bigint, src bigint, dst bigint")
    graphs.write_graph(chain(spark, 2), None, a)
    graphs.write_graph(chain(spark, 2), none, b)
    assert graphs.read_graph(spark, a).edges is None and graphs.read_edges(spark, a).count() == 0
    g = graphs.read_graph(spark, b)
    assert g.graph_meta == GraphMeta(0, None) and g.edges.count() == 0


@pytest.mark.parametrize("edge,what", [((5, 1), "source out of range"), ((0, 10), "target out of range"), ((-1, 0), "source out of range"), ((0, 0), "itself"), ((None, 0), "source out of range")])
def test_bad_edges(spark, tmp_path, edge, what):
    edges = spark.createDataFrame([edge], "src bigint, dst bigint")
    with pytest.raises(codec.ContainerError, match=what):
        graphs.write_graph(chain(spark, 2), edges, str(tmp_path / "x.bin"))
    with pytest.raises(codec.ContainerError, match=what):
        graphs.check_edges(edges, 2)
    assert os.listdir(tmp_path) == []


def test_empty_vertices(spark, tmp_path):
    with pytest.raises(codec.ContainerError, match="geometry type"):
        graphs.write_graph(chain(spark, 0), None, str(tmp_path / "x.bin"))
    graphs.write_graph(chain(spark, 0), None, str(tmp_path / "y.bin"), allow_empty=True)
    assert graphs.read_vertices(spark, str(tmp_path / "y.bin")).count() == 0


def test_odd_geometries_and_clashing_names(spark, tmp_path):
    p = str(tmp_path / "g.bin")
    shapes = [None, geom(1, []), geom(3, [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 0.0, 1.0, 1.0, 2.0, 1.0, 2.0, 2.0, 1.0, 1.0], ends=[4, 8]), geom(6, parts=[{k: v for k, v in geom(3, [0.0, 0.0, 1.0, 1.0]).items() if k != "parts"}]), geom(2, [0.0, 1.0, 2.0, 3.0], [5.0, 6.0], [7.0, 8.0]), geom(1, [float("nan"), 1.0])]
    rows = [(10 * i, g, i, "z" * 10_240, b"test") for i, g in enumerate(shapes)]
    df = spark.createDataFrame(rows, f"key bigint, geom {GEOMETRY}, FID int, long string, raw binary")
    graphs.write_graph(df, None, p, id_column="key", index_node_size=2)
    back = graphs.read_vertices(spark, p)
    assert back.schema.names == ["fid", "bbox", "geom", "FID_1", "long", "raw"]
    got = {r.FID_1: r for r in back.collect()}
    assert got[0].geom is None and got[0].bbox is None and got[1].bbox is None and got[5].bbox is None
    assert got[2].geom.ends == [4, 8] and got[3].geom.parts[0].xy == [0.0, 0.0, 1.0, 1.0] and got[4].geom.m == [7.0, 8.0] and got[4].raw == b"test" and len(got[4].long) == 10_240
    assert {r.FID_1 for r in graphs.read_vertices(spark, p, Rect(0.5, 0.5, 0.6, 0.6)).collect()} == {2, 3}


def test_index_reads_only_the_window_and_edges_follow(spark, tmp_path):
    p, q = str(tmp_path / "i.bin"), str(tmp_path / "u.bin")
    edges = spark.createDataFrame([(i, i % 100, (i + 1) % 100, float(i)) for i in range(1000)], "eid bigint, src bigint, dst bigint, id double")
    graphs.write_graph(chain(spark, 100), edges, p, index_node_size=4)
    graphs.write_graph(chain(spark, 100), edges, q)
    for path in (p, q):
        for rect, n in ((Rect(10, 10, 20, 20), 11), (Rect(99, 0, 200, 99), 1), (Rect(3.5, 3.5, 3.6, 3.6), 0), (Rect(200, 200, 300, 300), 0)):
            assert graphs.read_vertices(spark, path, rect).count() == n
        g = graphs.read_graph(spark, path)
        names = g.vertices.select("fid", "name")
        ends = g.edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst")
        assert ends.where(F.col("b") == F.concat(F.lit("node-"), ((F.substring("a", 6, 9).cast("int") + 1) % 100).cast("string"))).count() == 1000
    assert graphs.read_section(spark, p, "index").where("level = 0").count() == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert graphs.read_vertices(spark, p, pushdown=True).where("bbox.minx <= 20 AND bbox.maxx >= 10 AND NOT (bbox.maxy < 10) AND bbox.miny <= 20").count() == 11
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


class Ranges(http.server.SimpleHTTPRequestHandler):
    def do_GET(self):
        data = open(self.server.file, "rb").read()
        span = self.headers.get("Range")
        if span and self.server.ranges:
            a, b = map(int, span[6:].split("-"))
            part = data[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(data)}")
            data = part
        else:
            self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.mark.parametrize("ranges", [True, False])
def test_http(spark, tmp_path, ranges):
    p = str(tmp_path / "i.bin")
    graphs.write_graph(chain(spark, 50), spark.createDataFrame([(0, 49)], "src bigint, dst bigint"), p, index_node_size=4)
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Ranges)
    server.file, server.ranges = p, ranges
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/i.bin"
        assert graphs.read_metadata(url, **graphs.http_options({"X-A": "b"}, True)).features_count == 50
        assert graphs.read_vertices(spark, url, Rect(47, 47, 99, 99)).count() == 3 and graphs.read_edges(spark, url).count() == 1
    finally:
        server.shutdown()


def test_directory_of_containers_with_differing_columns(spark, tmp_path):
    graphs.write_graph(chain(spark, 2), None, str(tmp_path / "a.bin"))
    graphs.write_graph(chain(spark, 3).withColumnRenamed("name", "other"), None, str(tmp_path / "b.bin"))
    df = graphs.read_vertices(spark, str(tmp_path))
    assert df.schema.names == ["fid", "bbox", "geom", "name", "other"] and df.count() == 5 and df.where("other IS NULL").count() == 2


def test_stream_and_counts(spark, tmp_path):
    from vertexloom import streaming

    p = str(tmp_path / "g.bin")
    graphs.write_graph(chain(spark, 20), None, p)
    assert streaming.drain(streaming.stream_section(spark, p, "vertices", splitRecords=6)).count() == 20


def test_write_by_format(spark, tmp_path):
    from vertexloom.sources.container import FORMAT, register

    register(spark)
    p = str(tmp_path / "w.bin")
    df = chain(spark, 12).coalesce(2).selectExpr("fid", "geom", "name", "timestamp_ntz'2024-01-02 03:04:05' AS at", "array(1, 2) AS tags", "cast(2.5 AS decimal(9,1)) AS d")
    df.write.format(FORMAT).option("crs", "4326").option("indexNodeSize", "4").mode("overwrite").save(p)
    assert sorted(os.listdir(tmp_path)) == ["_w.bin.layout", "w.bin"]
    rows = graphs.read_vertices(spark, p).orderBy("fid").collect()
    assert [r.name for r in rows] == [f"node-{i}" for i in range(12)] and rows[0].at == "2024-01-02T03:04:05" and rows[0].tags == "[1, 2]" and rows[0].d == "2.5"
    assert graphs.read_vertices(spark, p, Rect(3, 3, 4, 4)).count() == 2 and graphs.read_metadata(p).crs["code"] == 4326


def test_geojson_files(spark, tmp_path):
    import json

    from vertexloom.sources import geojson

    for name, feats in (("a", [{"type": "Feature", "id": 9, "properties": {"n": 1, "s": "x", "j": {"k": [1]}, "b": True}, "geometry": SHAPES[0]}, {"type": "Feature", "properties": None, "geometry": None}]), ("b", [{"type": "Feature", "properties": {"late": 2.5, "n": "text"}, "geometry": SHAPES[4]}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    every, first = geojson.read_geojson(spark, str(tmp_path)), geojson.read_geojson(spark, str(tmp_path), "sample-first")
    assert {f.name: f.dataType.simpleString() for f in every.schema.fields[2:]} == {"n": "string", "s": "string", "j": "string", "b": "boolean", "late": "double"}
    assert [(r.fid, r.n, r.late) for r in every.orderBy("fid").collect()] == [(0, "1", None), (1, None, None), (2, "text", 2.5)]
    assert first.schema.names == ["fid", "geom", "n", "s", "j", "b"] and [r.n for r in first.orderBy("fid").collect()] == [1.0, None, None]
    out = [json.loads(r.feature) for r in geojson.to_features(every).orderBy("fid").collect()]
    assert out[0]["properties"] == {"n": "1", "s": "x", "b": True, "j": {"k": [1]}} and out[2]["geometry"] == SHAPES[4] and out[1]["geometry"] is None


def test_column_for_types(spark):
    df = spark.sql("SELECT true AS b, 1 AS i, timestamp'2024-01-01 00:00:00' AS t, array(1) AS a, 1.5BD AS d, interval 1 day AS x")
    assert [column_for(f).type for f in df.schema.fields[:5]] == [2, 5, 13, 12, 11]
    with pytest.raises(ValueError, match="no column type"):
        column_for(df.schema["x"])


SHAPES = [
    {"type": "Point", "coordinates": [1.5, 2.5]}, {"type": "Point", "coordinates": [1.5, 2.5, 3.5]}, {"type": "MultiPoint", "coordinates": [[1.0, 2.0], [3.0, 4.0]]},
    {"type": "LineString", "coordinates": [[1.0, 2.0, 9.0], [3.0, 4.0, 8.0]]}, {"type": "Polygon", "coordinates": [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]]},
    {"type": "MultiLineString", "coordinates": [[[0.0, 0.0], [4.0, 0.0]]]}, {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]], [[[9.0, 9.0], [9.0, 8.0], [8.0, 8.0], [9.0, 9.0]]]]},
    {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "GeometryCollection", "geometries": [{"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}]}]},
]


@pytest.mark.parametrize("shape", SHAPES)
def test_geojson_round_trip(shape):
    g, _ = codec.decode_feature(codec.encode_feature(G.from_geojson_object(shape), b""), 0)
    assert G.to_geojson_object(g) == shape


def test_a_hot_end_is_spread_when_a_graph_is_written(spark, tmp_path, monkeypatch):
    salted, keys = graphs.salted_join, []

    def watched(left, right, key, *args, **kw):
        out = salted(left, right, key, *args, **kw)
        keys.append((key, "_salt" in out._jdf.queryExecution().analyzed().toString()))
        return out

    monkeypatch.setattr(graphs, "salted_join", watched)
    monkeypatch.setattr(graphs, "BROADCAST_POSITIONS", 0)
    point = F.from_json(F.lit('{"type":1,"xy":[1.0,2.0]}'), GEOMETRY)
    vertices = spark.range(50).select((F.col("id") * 3).alias("fid"), point.alias("geom"))
    edges = spark.range(400).select("id", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 48 * 3 + 3).alias("src"), F.when(F.col("id") < 200, F.col("id") % 48 * 3 + 3).otherwise(0).cast("bigint").alias("dst"))
    path = str(tmp_path / "hot.bin")
    graphs.write_graph(vertices, edges.withColumnRenamed("id", "eid").withColumn("n", F.col("eid")), path)
    assert keys == [("_src", True), ("_dst", True)]
    got = sorted((r.n, r.src, r.dst) for r in graphs.read_edges(spark, path).collect())
    assert got == sorted((r.id, r.src // 3, r.dst // 3) for r in edges.collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no data")
def test_the_whole_graph_holds_edges_of_stations(spark):
    d = "/root/testdata/sf0.001"
    read = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    fids = {r.fid for name in ("vertices", "stations") for r in read(name).select("fid").collect()} - {None}
    ends = {r.eid: (r.src, r.dst) for r in read("edges").where("eid IS NOT NULL").collect()}
    want = {eid for eid, (a, b) in ends.items() if a != b and a in fids and b in fids}
    assert {r.eid for r in graph_queries.whole_edges(spark, d).collect()} == want > {r.eid for r in graph_queries.graph_edges(spark, d).collect()}
    assert sorted(r.fid for r in graph_queries.whole_vertices(spark, d).collect()) == sorted(fids)
