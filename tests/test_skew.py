from pyspark.sql import functions as F

from vertexloom.common import heavy_keys, salted_join
from vertexloom.operators import skew as S

SCHEMA = "src bigint, dst bigint, recorded_at int, n bigint, partner string"


def edges(spark):
    rows = [(1, i, i, 0, "p") for i in range(60)] + [(i, 2, 5, 0, "p") for i in range(100, 139)] + [(None, 3, None, 0, "p")]
    return spark.createDataFrame(rows, SCHEMA)


def test_totals_and_hot_keys(spark):
    totals = {(r.ref_field, r.ref_key): (r.n_edges, r.n_partners, r.last_at) for r in S.key_totals(edges(spark)).collect()}
    assert totals[("src", 1)] == (60, 60, 59) and totals[("dst", 2)] == (40, 40, 5) and totals[("dst", 3)] == (2, 1, 3)
    hot = {(r.ref_field, r.ref_key) for r in S.hot_keys(edges(spark), 0.02).collect()}
    assert hot == {("src", 1), ("dst", 2), ("dst", 3)}  # 2 of 100 rows is just enough
    assert S.hot_keys(edges(spark).where("false")).count() == 0 and S.key_totals(edges(spark).where("false")).count() == 0


def test_eager_join_equals_plain_join(spark):
    left = spark.createDataFrame([(1, "a", 2), (1, "a", 3), (1, "b", None), (2, "a", 5), (None, "a", 7), (4, "c", 1)], "k int, g string, x int")
    right = spark.createDataFrame([(1, "r", 10), (1, "r", 20), (2, "s", 1), (2, None, 2), (None, "s", 9)], "k int, h string, y int")
    spec = [("both", "count", "", "n"), ("left", "sum", "x", "sx"), ("right", "sum", "y", "sy"), ("left", "max", "x", "mx"), ("right", "min", "y", "my")]
    for how in ("inner", "left"):
        got = S.eager_join_aggregate(left, right, ["k"], ["g"], ["h"], spec, how)
        want = left.join(right, "k", how).groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max("x").alias("mx"), F.min("y").alias("my"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_salted_join_keeps_all_rows(spark):
    left = spark.range(1000).select((F.col("id") % 3 * F.when(F.col("id") % 2 == 0, 0).otherwise(1)).alias("k"), F.col("id").alias("a")).unionByName(spark.createDataFrame([(None, -1)], "k bigint, a bigint"))
    right = spark.createDataFrame([(0, "x"), (0, "y"), (1, "z"), (7, "q"), (None, "n")], "k bigint, b string")
    for how in ("inner", "left", "left_anti"):
        got, want = salted_join(left, right, "k", F.col("a"), how), left.join(right, "k", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert [r.k for r in heavy_keys(left, "k", 0.3).collect()] == [0]
    assert heavy_keys(left.where("false"), "k", 0.3).count() == 0
