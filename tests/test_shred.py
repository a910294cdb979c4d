import json
import os

import pytest
from pyspark.sql import functions as F

from vertexloom.operators import shred
from vertexloom.plans import problems


def below_root(df):
    entities = shred.entity_rows(shred.shred(shred.keyed(df, "id").where(shred.may_nest("text")), "t", "id", "text", list_scalars=False))
    return entities.where("node > 0").collect()


def paths(spark, *texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "id bigint, text string, node string, record_id int")
    return sorted((r.record_id, r.path, r.parent_path) for r in below_root(df))


def test_paths_of_objects(spark):
    got = paths(spark, '{"a": [null, {"b": {"c": 1}}], "d": {}}')
    assert got == [(0, "$/a/1", "$"), (0, "$/a/1/b", "$/a/1"), (0, "$/d", "$")]


def test_list_root_has_no_enclosing_object(spark):
    assert paths(spark, '[{"x": [{}]}, 5]') == [(0, "$/0", ""), (0, "$/0/x/0", "$/0")]


def test_strings_holding_json_stand_for_it(spark):
    inner = json.dumps({"b": json.dumps([{"c": 1}])})
    assert paths(spark, json.dumps({"a": inner}), json.dumps(inner)) == [(0, "$/a", "$"), (0, "$/a/b/0", "$/a"), (1, "$/b/0", "$")]
    assert paths(spark, json.dumps({"a": "{see below"}), json.dumps({"a": '"{}"'})) == []
    assert paths(spark, '"\\u007b\\"a\\": \\u007b}}"') == [(0, "$/a", "$")]


def test_broken_null_empty_and_repeated(spark):
    assert paths(spark, None, "", "{", "null", "5", '"x"', '{"a": {}} x', " \n{}") == []
    df = spark.createDataFrame([(1, '{"a": {}}'), (1, '{"a": {}}'), (None, '{"a": {}}')], "id bigint, text string")
    assert sorted(max(r.record_id, 0) for r in below_root(df)) == [0, 1]
    assert below_root(df.where("false")) == []


def test_very_deep_and_very_long(spark):
    assert shred.parse("[" * 100_000 + "]" * 100_000)[0]
    assert len(paths(spark, '{"a":' * 300 + "{}" + "}" * 300)) == 300
    assert len(paths(spark, json.dumps([{"x": "y" * 100}] * 5000))) == 5000


def test_own_parser_equals_json():
    for text in ('{"a": [1, -2.5e3, true, false, null, "\\u00e9x"], "b": {}, "c": []}', "[[[]]]", ' [ ] ', '"s"', "12", '{"a":{"b":[{"c":"d"}]}}'):
        assert shred._parse_deep(text) == json.loads(text)
    for text in ("", "{", "[1,]", '{"a"}', "[1 2]", "{}x", '{"a":1,}', "nul", "["):
        with pytest.raises(ValueError):
            shred._parse_deep(text)
    n = 200_000
    value = shred._parse_deep("[" * n + "]" * n)
    depth = 0
    while value:
        value, depth = value[0], depth + 1
    assert depth == n - 1


def test_entity_table_links_children_to_parents(spark):
    text = '{"type": "G", "parts": [{"type": "P", "n": 1}, {"type": "L", "n": "x"}, {"q": 1}]}'
    adjacency = shred.shred(spark.createDataFrame([(7, text)], "id bigint, text string"), "t", "id", "text")
    rows = shred.entity_table(shred.entity_rows(adjacency), "parts", {"type": "string", "n": "int"}).orderBy("node").collect()
    root = adjacency.where("path = '$'").collect()[0].node
    assert [(r.object_parent, r.path, r.type, r.n) for r in rows] == [(root, "$/parts/0", "P", 1), (root, "$/parts/1", "L", None), (root, "$/parts/2", None, None)]


def test_keys_that_look_like_positions_or_paths(spark):
    text = '{"0": {"a": 1}, "x/y": {"b": 2}, "l": [{"c": 3}]}'
    entities = shred.entity_rows(shred.shred(spark.createDataFrame([(1, text)], "id bigint, text string"), "t", "id", "text"))
    assert sorted((r.entity, r.fields) for r in entities.where("node > 0").collect()) == [("0", {"a": "1"}), ("l", {"c": "3"}), ("x/y", {"b": "2"})]


def test_numbers_of_any_length_and_not_a_number(spark):
    digits = "9" * 10_000
    for text in (f'{{"p": {{"n": {digits}}}}}', '{"d":' * 5_000 + f'{{"p": {{"n": {digits}}}}}' + "}" * 5_000):
        df = spark.createDataFrame([(1, text)], "id bigint, text string")
        assert [r.fields for r in below_root(df) if r.entity == "p"] == [{"n": digits}]
    assert shred.parse("[NaN, -Infinity]")[0] and str(shred._parse_deep("[NaN, -Infinity, Infinity, -1]")) == "[nan, -inf, inf, -1]"


def test_coordinates_keep_ring_and_position(spark):
    text = '{"geometries": [{"coordinates": [1, "2", 3]}, {"coordinates": [[[0, 0], [1, 0]], [[5, 5], [null, 6]]]}], "coordinates": []}'
    adjacency = shred.shred(spark.createDataFrame([(1, text)], "id bigint, text string"), "t", "id", "text")
    nodes = {r.path: r.node for r in adjacency.where("kind = 'object'").collect()}
    got = sorted((r.geometry, r.polygon, r.ring, r.position, r.x, r.y, r.z) for r in shred.coordinate_table(adjacency).fillna(-1, ["polygon", "ring", "position"]).collect())
    a, b = nodes["$/geometries/0"], nodes["$/geometries/1"]
    assert got == [(a, -1, -1, -1, 1.0, 2.0, 3.0), (b, -1, 0, 0, 0.0, 0.0, None), (b, -1, 0, 1, 1.0, 0.0, None), (b, -1, 1, 0, 5.0, 5.0, None)]


def test_adjacency_has_every_value(spark):
    adjacency = shred.shred(spark.createDataFrame([(1, '{"a": [1, "x", true, null]}')], "id bigint, text string"), "t", "id", "text")
    rows = {(r.path, r.label, r.kind, r.scalar, r.ordinal) for r in adjacency.collect()}
    assert rows == {("$", None, "object", None, None), ("$/a", "a", "list", None, None), (None, "0", "number", "1", 0), (None, "1", "string", "x", 1), (None, "2", "boolean", "true", 2), (None, "3", "null", None, 3)}
    assert adjacency.where(F.col("parent").isNull()).count() == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no data")
def test_entities_hold_every_object_and_scalar_of_both_tables(spark):
    d = "/root/testdata/sf0.001"
    want, labels = {}, set()
    for name, key, text in (("edges", "eid", "properties"), ("raw_features", "raw_id", "payload")):
        for r in spark.read.parquet(f"{d}/{name}.parquet").select(key, text).collect():
            rows = shred._Rows()
            shred.walk(0, r[1], frozenset(problems._FIELDS), False, rows)
            found = list(zip(rows.nodes, rows.parents, rows.objects, rows.labels, rows.ordinals, rows.kinds, rows.scalars, rows.paths))
            want |= {(name, r[0], x[0]): (x[2], x[7], {}) for x in found if x[5] == "object"}
            for _, parent, _, label, ordinal, kind, scalar, *_ in found:
                if ordinal is None and label is not None and kind in ("string", "number", "boolean"):
                    want[name, r[0], parent][2][label] = scalar
                    labels.add(label)
    out = problems.p1_entities(spark, d)
    fields = sorted(labels)
    assert len(out.columns) == 6 + len(fields) and len({c.lower() for c in out.columns}) == len(out.columns)
    rows = [tuple(r) for r in out.collect()]
    got = {r[:3]: (r[3], r[4], {k: v for k, v in zip(fields, r[6:]) if v is not None}) for r in rows}
    assert got == want and len(rows) == len(got)
    assert {r[5] for r in rows if r[0] == "edges"} > {"$", "towers", "spans"} and {r[5] for r in rows if r[0] == "raw_features"} > {"$", "properties", "contact", "hours"}


def test_records_without_an_id_stay_apart(spark, tmp_path):
    d = str(tmp_path)
    rows = [(1, '{"a": 1}'), (1, '{"a": 1}'), (None, '{"a": 2, "p": {"b": "x"}}'), (None, '{"a": 3, "p": {"b": "y"}}'), (None, '{"a": 3, "p": {"b": "y"}}')]
    spark.createDataFrame(rows, "eid bigint, properties string").write.parquet(f"{d}/edges.parquet")
    spark.createDataFrame([(5, '{"type": "Point"}'), (None, '{"geometry": {"type": "Point"}}'), (None, '{"geometry": {"type": "LineString"}}')], "raw_id bigint, payload string").write.parquet(f"{d}/raw_features.parquet")
    got = problems.p1_entities(spark, d).collect()
    assert len({(r.record_table, r.record_id, r.node) for r in got}) == len(got)
    assert sorted((r.path, r.a or r.b) for r in got if r.record_table == "edges") == [("$", "1"), ("$", "2"), ("$", "3"), ("$", "3"), ("$/p", "x"), ("$/p", "y"), ("$/p", "y")]
    assert sorted((r.path, r.type) for r in problems.p1_geometry_entities(spark, d).collect()) == [("$", "Point"), ("$/geometry", "LineString"), ("$/geometry", "Point")]
    assert {r.kind: r.n_nodes for r in problems.p1_node_kinds(spark, d).collect()} == {"object": 7, "number": 4, "string": 3}
