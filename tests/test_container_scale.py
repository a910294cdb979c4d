"""Containers at scale: layouts, slices, directories, blocks, nested geometries."""

import json
import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_container import SHAPES, chain, geom
from vertexloom.functions import geometry as G
from vertexloom.sources import codec, container, graphs, layouts
from vertexloom.sources import columns as blocks
from vertexloom.types import COLUMN_TYPES, GEOMETRY, Column, Rect

NESTED = {
    "type": "GeometryCollection",
    "geometries": [
        {"type": "MultiPolygon", "coordinates": [[[[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]], [[[5.0, 5.0], [6.0, 5.0], [5.0, 5.0]]]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1.0, 2.0]}, {"type": "GeometryCollection", "geometries": []}]},
    ],
}


@pytest.mark.parametrize("index", [0, 2])
def test_a_truncated_file_is_an_error(spark, tmp_path, index):
    p = str(tmp_path / "g.bin")
    graphs.write_graph(chain(spark, 3), spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint"), p, index_node_size=index)
    data = open(p, "rb").read()
    open(p, "wb").write(data[:-5])
    assert graphs.read_vertices(spark, p).count() == 3
    with pytest.raises(Exception, match="cut short"):
        graphs.read_edges(spark, p).count()
    for lost in (data[:-60], data[:-200]):
        open(p, "wb").write(lost)
        with pytest.raises(Exception, match="cut short|beyond"):
            graphs.read_vertices(spark, p).count()
    open(p, "wb").write(codec.MAGIC + struct.pack("<I", 3))
    with pytest.raises(Exception, match="header cannot have 3"):
        graphs.read_vertices(spark, p).count()


def test_nested_collections_keep_types_and_places(spark, tmp_path):
    shapes = [*SHAPES, NESTED]
    for s in shapes:
        g, _ = codec.decode_feature(codec.encode_feature(G.from_geojson_object(s), b""), 0)
        assert G.to_geojson_object(codec.nested_parts(codec.flat_parts(g))) == s
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)], "fid bigint, text string").withColumn("geom", G.from_geojson(F.col("text")))
    assert [json.loads(r.t) for r in df.orderBy("fid").select(G.to_geojson(F.col("geom")).alias("t")).collect()] == shapes
    path = str(tmp_path / "n.bin")
    graphs.write_graph(df, None, path)
    back = graphs.read_vertices(spark, path).select("fid", F.col("geom").alias("back"), G.to_geojson(F.col("geom")).alias("t")).join(df, "fid")
    assert {json.dumps(json.loads(r.t)) for r in back.collect()} == {json.dumps(s) for s in shapes}
    assert back.where(G.same_shape(F.col("geom"), F.col("back"), True)).count() == len(shapes)


def test_broken_geojson_is_null(spark):
    texts = [None, "", "{", "5", '{"type":"Point"}', '{"type":"Point","coordinates":[1%s,2]}' % ("0" * 400), '{"type":"Nope","coordinates":[1,2]}', '{"type":"Point","coordinates":["x",2]}', '{"type":"GeometryCollection","geometries":' + "[" * 5000 + "]" * 5000 + "}"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(G.from_geojson(F.col("t")).alias("g")).collect()
    assert [r.g for r in rows] == [None] * len(texts)


def test_empty_and_missing_arrays_stay_apart(spark, tmp_path):
    shapes = [geom(1), geom(1, []), geom(2, [1.0, 2.0], [], None, []), geom(3, [0.0, 0.0], None, [1.0]), geom(6, parts=[])]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(shapes)], f"fid bigint, geom {GEOMETRY}")
    path = str(tmp_path / "e.bin")
    graphs.write_graph(df, None, path)
    back = {r.fid: r.geom.asDict() for r in graphs.read_vertices(spark, path).collect()}
    assert [{k: back[i][k] for k in ("type", "xy", "z", "m", "ends", "parts")} for i in range(5)] == shapes


def test_null_ordinates_are_not_numbers(spark, tmp_path):
    shapes = [geom(1, [None, 2.0]), geom(2, [1.0, 2.0, None, None], z=[None, 3.0]), geom(1, [5.0])]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(shapes)], f"fid bigint, geom {GEOMETRY}")
    path = str(tmp_path / "n.bin")
    graphs.write_graph(df, None, path, index_node_size=2)
    rows = {r.fid: r for r in graphs.read_vertices(spark, path).collect()}
    found = sorted((str(r.geom.xy), str(r.geom.z), r.bbox and tuple(r.bbox)) for r in rows.values())
    assert found == [("[1.0, 2.0, nan, nan]", "[nan, 3.0]", (1.0, 2.0, 1.0, 2.0)), ("[5.0]", "None", None), ("[nan, 2.0]", "None", None)]


def test_tasks_read_their_slice_and_the_header_only(spark, tmp_path, monkeypatch):
    edges = spark.range(12_000).selectExpr("id % 100 AS src", "(id + 1) % 100 AS dst", "id AS n")
    p = str(tmp_path / "i.bin")
    graphs.write_graph(chain(spark, 12_000), edges, p)
    monkeypatch.setattr(container.Walker, "hop", lambda *a: pytest.fail("a walk over records"))
    head = container.Container(p).source.fetched
    real = container.open_bytes
    for section in ("vertices", "edges"):
        source = container.GeoContainer({"path": p, "section": section, "splitrecords": "5000"})
        reader = container.ContainerReader(source, source.schema())
        slices = reader.partitions()
        assert sum(s.count for s in slices) == 12_000 and len(slices) > 1
        for s in slices:
            opened = []
            monkeypatch.setattr(container, "open_bytes", lambda *a: opened.append(real(*a)) or opened[-1])
            rows = sum(b.num_rows for b in reader.read(s))
            monkeypatch.setattr(container, "open_bytes", real)
            assert rows == s.count and sum(o.fetched for o in opened) <= s.stop - s.start + head


def test_files_from_elsewhere_have_no_layout(spark, tmp_path):
    edges = spark.range(300).selectExpr("id AS eid", "id % 50 AS src", "(id + 7) % 50 AS dst")
    for name, index in (("a", 0), ("b", 4)):
        (tmp_path / name).mkdir()
        p = str(tmp_path / name / "g.bin")
        graphs.write_graph(chain(spark, 50), edges, p, index_node_size=index)

        def read(p=p):
            return sorted(map(str, graphs.read_vertices(spark, p, splitRecords=7).collect())), sorted(map(str, graphs.read_edges(spark, p, splitRecords=7).collect()))

        want = read()
        os.remove(layouts.layout_path(p))
        assert read() == want
        assert graphs.write_layouts(spark, str(tmp_path / name)) == 1 and graphs.write_layouts(spark, str(tmp_path / name)) == 0
        assert read() == want
        open(layouts.layout_path(p), "w").write('{"size": 1}')
        assert read() == want


@pytest.mark.parametrize("index", [0, 4])
def test_a_directory_is_one_graph(spark, tmp_path, index):
    folder = str(tmp_path / "d")
    edges = spark.range(900).selectExpr("id AS eid", "CASE WHEN id % 3 = 0 THEN 5 ELSE id % 100 END AS src", "(id * 7 + 1) % 100 AS dst", "concat('e', id) AS tag").where("src <> dst")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that there are several files
    try:
        manifest = graphs.write_graph_directory(chain(spark, 100), edges, folder, 4326, index)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(manifest.files) > 1 and manifest.n_vertices == 100 and manifest.n_edges == edges.count()
    g = graphs.read_graph(spark, folder)
    assert g.meta.features_count == 100 and g.graph_meta.edge_count == manifest.n_edges and [c.name for c in g.graph_meta.columns] == ["tag"]
    assert sorted(r.fid for r in g.vertices.collect()) == list(range(100)) and sorted(r.eid for r in g.edges.collect()) == list(range(manifest.n_edges))
    names = g.vertices.select("fid", "name")
    got = g.edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select("tag", "a", "b")
    want = edges.selectExpr("tag", "concat('node-', src)", "concat('node-', dst)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(r.name for r in graphs.read_vertices(spark, folder, Rect(10, 10, 12, 12)).collect()) == ["node-10", "node-11", "node-12"]
    assert graphs.read_section(spark, folder, "header").count() == len(manifest.files)
    with pytest.raises(ValueError, match="already"):
        graphs.write_graph_directory(chain(spark, 2), None, folder)


def test_bad_edges_leave_no_directory(spark, tmp_path):
    for edge, what in (((0, 9), "target out of range"), ((1, 1), "itself")):
        with pytest.raises(codec.ContainerError, match=what):
            graphs.write_graph_directory(chain(spark, 3), spark.createDataFrame([edge], "src bigint, dst bigint"), str(tmp_path / "d"))
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []


VALUES = (st.integers(-128, 127), st.integers(0, 255), st.booleans(), st.integers(0, 2**64 - 1), st.floats(allow_nan=False), st.text(max_size=5), st.binary(max_size=5))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*(st.one_of(st.none(), s) for s in VALUES)), max_size=8))
def test_blocks_decode_as_single_records(rows):
    columns = [Column(n, COLUMN_TYPES[n]) for n in ("Byte", "UByte", "Bool", "ULong", "Double", "String", "Binary")]
    records = [codec.encode_edge(i, i + 1, codec.encode_properties(r, columns)) for i, r in enumerate(rows)]
    data = b"".join(records)
    starts = blocks.record_starts(data)
    buf, src, _, begin, end = blocks.edges(data, starts)
    values = blocks.properties(buf, begin, end, columns, set(range(7)))
    assert src.tolist() == list(range(len(rows)))
    assert [list(x) for x in zip(*(values[i].to_pylist() for i in range(7)))] == [codec.decode_properties(codec.decode_edge(r, 0)[2], columns) for r in records]
