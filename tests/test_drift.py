import json
import os
from datetime import datetime as D

import pytest

from vertexloom.operators import drift
from vertexloom.operators.shred import parse, unwrap
from vertexloom.plans import problems

COL = "array<struct<name:string,type:tinyint,title:string,description:string>>"


def tables(spark, lists, features=None, props=()):
    h = spark.createDataFrame([(i, ds, D(2024, 1, day), (features or {}).get(i)) for i, ds, day, _ in lists], f"file_id bigint, dataset_id string, written_at timestamp_ntz, feature_columns {COL}")
    g = spark.createDataFrame([(i, cols) for i, _, _, cols in lists], f"file_id bigint, edge_columns {COL}")
    rows = [(n, f, 1, 2, p, D(2024, 1, 1)) for n, (f, p) in enumerate(props)]
    e = spark.createDataFrame(rows, "eid bigint, file_id bigint, src bigint, dst bigint, properties string, recorded_at timestamp_ntz")
    return h, g, e


def changes(spark, *args, **kw):
    return sorted(tuple(r) for r in drift.schema_changes(*tables(spark, *args, **kw)).collect())


def c(name, type_=11, title=None, description=None):
    return (name, type_, title, description)


def test_changes_between_versions(spark):
    lists = [
        (1, "d", 1, [c("a"), c("speed_limit", 10), c("w", 10, "Weight"), c("gone"), c("t", 5)]),
        (2, "d", 2, None),
        (3, "d", 3, [c("t", 10), c("a", title="A"), c("speedLimit", 10), c("mass", 5, "Weight (rev.)"), c("new")]),
        (4, "other", 2, [c("x")]),
        (5, "d", 4, []),
    ]
    got = changes(spark, lists)
    assert [x for x in got if x[0] == 3] == [(3, "edge", "added", "new"), (3, "edge", "removed", "gone"), (3, "edge", "renamed", "mass"), (3, "edge", "renamed", "speedLimit"), (3, "edge", "retyped", "mass"), (3, "edge", "retyped", "t")]
    assert [x[3] for x in got if x[0] == 5] == ["a", "mass", "new", "speedLimit", "t"] and {x[2] for x in got if x[0] == 5} == {"removed"}
    assert {x[0] for x in got} == {3, 5}


def test_islands(spark):
    lists = [(i, "d", i, [c("k")] + ([c("x")] if i in (1, 3, 4) else [])) for i in range(1, 6)]
    assert [(f, ch) for f, _, ch, name in changes(spark, lists)] == [(2, "removed"), (3, "added"), (5, "removed")]


def test_values(spark):
    props = [(1, json.dumps({"b": True, "n": 1, "s": "x", "j": {}, "extra": 1, "d": None})), (1, json.dumps({"b": 1, "n": "1", "s": ["x"], "j": "{}", "d": 5})), (1, None), (1, "{"), (1, "[1]"), (2, '{"z": 1}'), (9, '{"z": 1}'), (None, '{"z": 1}'), (1, json.dumps(json.dumps({"more": 1})))]
    lists = [(1, "d", 1, [c("b", 2), c("n", 10), c("s"), c("j", 12), c("d", 13), c("never", 14)]), (2, "d", 2, None)]
    got = changes(spark, lists, props=props)
    assert [(x[2], x[3]) for x in got] == [("mistyped", n) for n in "bdjns"] + [("undeclared", "extra"), ("undeclared", "more")]
    assert changes(spark, []) == []


def test_values_of_a_file_without_history(spark):
    h, g, e = tables(spark, [(1, "d", 1, [c("a")])], props=[(1, '{"a": 1, "b": 2}')])
    assert sorted(tuple(r) for r in drift.schema_changes(h.where("false"), g, e).collect()) == [(1, "edge", "mistyped", "a"), (1, "edge", "undeclared", "b")]


@pytest.mark.parametrize("a,b,kin", [("speed_limit", "speedLimit", True), ("weight", "edge_weight", True), ("flightNumber", "flight_number", True), ("w", "weight", False), ("Kind", "kind", True), ("id", "uid", False), ("___", "__", False)])
def test_kindred(a, b, kin):
    assert drift.kindred(a, b) is kin


def test_pairing_takes_the_best_evidence_once():
    m = lambda n, t=None, d=None, k=11: {"column_name": n, "title": t, "description": d, "type": k}
    assert drift.pair_renames([m("a_x", "T"), m("a_y")], [m("a_z"), m("q", "T *")]) == [("a_x", "q"), ("a_y", "a_z")]
    assert drift.pair_renames([m("p")], [m("q")]) == [] and drift.pair_renames([], [m("q")]) == []


def test_consistent_table(spark):
    lists = [(1, "d", 1, [c("w", 5, "Weight"), c("r")]), (2, "d", 2, [c("mass", 10, "Weight"), c("r")]), (3, "d", 3, [c("kg", 10, "Weight")]), (4, "e", 1, [c("kg", 11)])]
    props = [(1, '{"w": 3, "r": "a"}'), (2, '{"mass": 2.5}'), (3, '{"kg": 1e1}'), (3, '{"kg": "heavy"}'), (4, '{"kg": "x"}'), (9, '{"w": 7}'), (1, None), (1, '"{\\"w\\": 4}"')]
    h, g, e = tables(spark, lists, props=props)
    rows = sorted((r.eid, r.w, r.r, r.kg) for r in drift.consistent_edges(e.union(e), h, g, ["w", "r", "kg"]).collect())
    assert rows == [(0, "3.0", "a", None), (1, "2.5", None, None), (2, "10.0", None, None), (3, None, None, None), (4, None, None, "x"), (5, "7", None, None), (6, None, None, None), (7, "4.0", None, None)]


def test_consistent_table_keeps_every_value(spark):
    lists = [(1, "d", 1, [c("grade", 5, "G"), c("eid"), c("old", 5, "O")]), (2, "d", 2, [c("steep", 5, "G"), c("eid"), c("new", 5, "O")]), (3, "e", 1, [c("Grade")])]
    props = [(1, '{"grade": 3, "eid": "own"}'), (2, '{"steep": 4, "extra": {"a": 1}, "none": null}'), (2, '{"steep": "x", "grade": 7, "old": 1, "new": 2}'), (3, '{"Grade": "g"}'), (1, '{"grade": 1, "grade": 2}')]
    h, g, e = tables(spark, lists, props=props)
    out = drift.consistent_edges(e.union(e), h, g)
    assert out.columns[6:] == ["Grade", "eid_", "grade_", "old", "other"]
    assert sorted((r.eid, r.Grade, r.eid_, r.grade_, r.old, r.other) for r in out.collect()) == [
        (0, None, "own", "3", None, None), (1, None, None, "4", None, {"extra": '{"a":1}'}), (2, None, None, "7", "2", {"steep": "x", "old": "1"}), (3, "g", None, None, None, None), (4, None, None, "2", None, None),
    ]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no data")
def test_consistent_table_of_the_test_tables_loses_nothing(spark):
    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/edges.parquet").where("eid IS NOT NULL").select("eid", "properties").collect():
        value = unwrap(parse(r.properties)[1])
        want[r.eid] = sum(v is not None for v in value.values()) if isinstance(value, dict) else 0
    rows = problems.p5_table(spark, d).collect()
    got = {r.eid: sum(v is not None for v in r[6:-1]) + len(r.other or {}) for r in rows}
    assert got == want and len(rows) == len(got) and sum(len(r.other or {}) for r in rows) < sum(got.values()) / 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no data")
def test_nothing_needs_to_be_broadcast(spark):
    d = "/root/testdata/sf0.001"
    want = sorted(map(tuple, problems.p5_found(spark, d).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = problems.p5_found(spark, d)
        assert sorted(map(tuple, df.collect())) == want and "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_field_that_changes_its_type_has_two_islands(spark):
    h, g, _ = tables(spark, [(1, "d", 1, [c("a", 5)]), (2, "d", 2, [c("a", 10)]), (3, "d", 3, [c("a", 10)]), (4, "d", 4, [c("a", None)])])
    catalogue = drift.lifespans(drift.versions(drift.column_lists(h, g)))
    got = sorted((r.version, r.type, r.starts, r.ends) for r in catalogue.where("section = 'edge'").fillna(-1, ["type"]).collect())
    assert got == [(1, 5, False, True), (2, 10, True, False), (3, 10, False, True), (4, -1, True, False)]
    assert [(r.version, r.change, r.old_type, r.new_type) for r in drift.declared_changes(catalogue).collect()] == [(2, "retyped", 5, 10)]


def test_feature_table_under_old_names(spark, tmp_path):
    d = str(tmp_path)
    feats = {1: [c("w", 5, "Weight")], 2: [c("mass", 10, "Weight")]}
    h, g, _ = tables(spark, [(1, "d", 1, None), (2, "d", 2, None)], feats)
    feature = lambda p: {"type": "Feature", "geometry": None, "properties": p}
    raw = [(1, 1, json.dumps(feature({"w": 3, "x": [1]}))), (2, 2, json.dumps({"features": [feature({"mass": 2.5}), feature(None), feature(json.dumps({"mass": "heavy"}))]})), (3, 2, None), (4, 9, json.dumps(feature({"w": 1})))]
    h.write.parquet(f"{d}/file_header.parquet"), g.write.parquet(f"{d}/graph_header.parquet")
    spark.createDataFrame(raw, "raw_id bigint, file_id bigint, payload string").write.parquet(f"{d}/raw_features.parquet")
    out = problems.p5_feature_table(spark, d)
    assert out.columns == ["raw_id", "position", "file_id", "dataset_id", "w", "other"]
    assert sorted((r.raw_id, r.position, r.w, r.other) for r in out.collect()) == [(1, 0, "3.0", {"x": "[1]"}), (2, 0, "2.5", None), (2, 1, None, None), (2, 2, None, {"mass": "heavy"}), (3, 0, None, None), (4, 0, "1", None)]
