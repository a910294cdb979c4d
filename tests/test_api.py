from vertexloom import api, streaming
from vertexloom.types import GEOMETRY


def test_verbs(spark, tmp_path):
    p = str(tmp_path / "g.bin")
    rows = [(i, {"type": 1, "xy": [float(i), float(i)]}, f"n{i}") for i in range(10)]
    vertices = spark.createDataFrame([(a, (g["type"], g["xy"], None, None, None, None, None), n) for a, g, n in rows], f"fid bigint, geom {GEOMETRY}, name string")
    assert api.serialize(vertices, p, spark.createDataFrame([(0, 1)], "src bigint, dst bigint"), 4326, index_node_size=4).edge_count == 1
    assert api.deserialize(spark, p).vertices.count() == 10 and api.deserialize_edges(spark, p).count() == 1 and api.read_metadata(p).features_count == 10
    seen = []
    near = api.deserialize_filtered(spark, p, api.Rect(3, 3, 5, 5), seen.append, feature_crs=3857)
    assert sorted(r.name for r in near.collect()) == ["n3", "n4", "n5"] and seen[0].features_count == 10 and max(r.geom.xy[0] for r in near.collect()) > 500_000
    assert streaming.drain(api.deserialize_stream(spark, p, api.Rect(3, 3, 5, 5))).count() == 3
    folder = str(tmp_path / "d")
    assert api.serialize_directory(vertices, folder, spark.createDataFrame([(0, 1)], "src bigint, dst bigint"), 4326).n_vertices == 10 and api.deserialize_edges(spark, folder).count() == 1
    world = api.load_tile(spark, p, 0, 0, 0)
    assert world.count() == 10 and api.load_extent(spark, p, api.Rect(0, 0, 1, 1), 4326, 4326, "all").count() == 10
