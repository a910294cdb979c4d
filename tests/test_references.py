from datetime import datetime as D

from vertexloom.operators import references as R

E = "eid bigint, src bigint, dst bigint, recorded_at timestamp_ntz, ingested_at timestamp_ntz, ref_key string"
V = "fid bigint, file_id bigint, ingested_at timestamp_ntz, deleted_at timestamp_ntz, known string"
H = "file_id bigint, features_count bigint, written_at timestamp_ntz, have int"


def t(day, month=1):
    return D(2024, month, day)


def test_reasons(spark):
    v = spark.createDataFrame([(1, 9, t(1), None, "x"), (2, 9, t(1), t(5), "x"), (3, 9, t(20), None, "x"), (3, 9, t(8), None, "x"), (4, 9, None, t(9), "x"), (None, 9, t(1), None, "x")], V)
    e = spark.createDataFrame(
        [
            (10, 1, 7, t(2), t(3), "k"), (10, 1, 7, t(2), t(4), "k"),  # repeated: once
            (11, 2, 2, t(5), t(6), "k"), (12, 2, 1, t(4), t(5), "k"),  # deleted on the day, not before
            (13, 3, 3, t(1, 2), t(7), "k"), (14, 3, 3, t(1), t(8), "k"),  # late only if strictly after
            (15, None, 1, t(1), t(1), "k"), (16, 4, 4, None, None, "k"), (None, 7, 7, t(1), t(1), "k"),
        ],
        E,
    )
    rows = sorted((r.ref_id, r.ref_field, r.reason, r.period) for r in R.orphan_edges(e, v).collect())
    assert rows == [
        (10, "dst", "missing", "2024-01"), (11, "dst", "deleted", "2024-01"), (11, "src", "deleted", "2024-01"), (13, "dst", "late", "2024-02"), (13, "src", "late", "2024-02"),
    ]
    report = {(r.reason, r.period): r.n_refs for r in R.orphan_report(R.orphan_edges(e, v)).collect() if r.ref_field == "src"}
    assert report == {("deleted", "2024-01"): 1, ("late", "2024-02"): 1}


def test_hot_key_and_empty_tables(spark):
    v = spark.createDataFrame([(1, 9, t(1), None, "x")], V)
    e = spark.createDataFrame([(i, 1 if i % 3 else 5, i, t(2), t(3), "k") for i in range(2, 900)], E)
    rows = R.orphan_edges(e, v).collect()
    assert len(rows) == 898 + sum(1 for i in range(2, 900) if i % 3 == 0)
    assert R.orphan_edges(e.where("false"), v).count() == 0
    assert R.orphan_edges(e, v.where("false")).count() == 2 * 898


def test_short_files(spark):
    v = spark.createDataFrame([(1, 1, t(1), None, "x"), (1, 1, t(2), None, "x"), (2, 1, t(1), None, "x"), (3, None, t(1), None, "x"), (None, 1, t(1), None, "x")], V)
    h = spark.createDataFrame([(1, 3, t(1), 0), (1, 3, t(1), 0), (2, 1, t(2), 0), (3, 0, t(1), 0), (4, None, t(1), 0), (None, 5, t(1), 0), (5, 2, None, 0)], H)
    assert sorted((r.ref_id, r.period or "") for r in R.short_files(h, v).collect()) == [(1, "2024-01"), (2, "2024-01"), (5, "")]
