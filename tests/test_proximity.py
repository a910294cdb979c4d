import math
import random

import pytest

from vertexloom.operators import proximity as P

POINTS = "fid bigint, file_id bigint, lon double, lat double, cell string"


def metres(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * P.EARTH_M * math.asin(min(1, math.sqrt(h)))


def cloud(seed):
    rnd, out = random.Random(seed), []
    for lon, lat in ((0, 0.01), (180, 10), (-180, 10.0001), (20, 89.9995), (-100, -89.9998), (60, 60), (-179.9999, -45)):
        for _ in range(14):
            x = lon + rnd.uniform(-1, 1) * 0.001 / max(math.cos(math.radians(lat)), 1e-4)
            out.append(((x + 180) % 360 - 180, max(-90.0, min(90.0, lat + rnd.uniform(-1, 1) * 0.0008))))
    return out + out[:6] + out[:3]


@pytest.mark.parametrize("radius", [50.0, 5000.0])
def test_near_pairs_equal_brute_force(spark, radius):
    pts = cloud(3)
    df = spark.createDataFrame([(i, None, x, y, "c") for i, (x, y) in enumerate(pts)], POINTS)
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if metres(pts[i], pts[j]) <= radius}
    rows = [(r.fid_a, r.fid_b) for r in P.near_pairs(df, radius).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want and len(want) > 20
    assert P.near_pairs(df.where("false"), radius).count() == 0


def test_a_pile_of_copies_is_one_class(spark):
    df = spark.createDataFrame([(i, None, 1.0, 2.0, "c") for i in range(500)] + [(900, None, 1.0001, 2.0, "c")], POINTS)
    assert [(r.rep_a, r.rep_b) for r in P.near_classes(df, 50.0).collect()] == [(0, 900)]
    assert P.near_pairs(df, 50.0).count() == 500 * 499 // 2 + 500


RECTS = "rect_id bigint, own bigint, minx double, miny double, maxx double, maxy double, cell int"


def inside(r, x, y):
    _, _, x0, y0, x1, y1, _ = r
    if any(v is None or v != v for v in (x0, y0, x1, y1)):
        return False
    return y0 <= y <= y1 and ((x >= x0 or x <= x1) if x0 > x1 else x0 <= x <= x1)


@pytest.mark.parametrize("limit", [P.BROADCAST_RECTS, 0])
def test_rectangles_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_RECTS", limit)
    rnd = random.Random(5)
    rects = [(1, None, -180.0, -90.0, 180.0, 90.0, 0), (2, None, 170.0, -5.0, -170.0, 5.0, 0), (3, None, 200.0, -50.0, -100.0, 50.0, 0), (4, None, None, 0.0, 1.0, 1.0, 0), (5, None, float("nan"), 0.0, 1.0, 1.0, 0), (6, None, 5.0, 5.0, 5.0, 5.0, 0), (7, 1, -20.0, -20.0, 20.0, 20.0, 0), (8, None, 0.0, 9.0, 1.0, 8.0, 0)]
    rects += [(10 + i, i % 3, x, y, x + 10 ** rnd.uniform(-3, 2), y + 10 ** rnd.uniform(-3, 1.5), 0) for i in range(60) for x, y in [(rnd.uniform(-180, 180), rnd.uniform(-90, 80))]]
    pts = [(i, rnd.choice([None, 0, 1, 2]), rnd.uniform(-180, 180), rnd.uniform(-90, 90), "c") for i in range(400)]
    pts += [(1000 + i, 1, r[2], r[5], "c") for i, r in enumerate(rects) if r[2] is not None and -180 <= r[2] <= 180 and r[5] <= 90] + [(2000, 1, 5.0, 5.0, "c"), (2001, None, 180.0, 0.0, "c"), (2002, None, -180.0, 0.0, "c")]
    want = {(r[0], p[0]) for r in rects for p in pts if inside(r, p[2], p[3]) and not (r[1] is not None and r[1] == p[1])}
    got = [(x.rect_id, x.fid) for x in P.points_in_rects(spark.createDataFrame(pts, POINTS), spark.createDataFrame(rects, RECTS)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert P.points_in_rects(spark.createDataFrame(pts, POINTS), spark.createDataFrame([], RECTS)).count() == 0


def test_boxes_meet_equals_brute_force(spark):
    rnd = random.Random(8)
    box = lambda i: (i, *(lambda x, y, w, h: (x, y, min(180.0, x + w), min(90.0, y + h)))(rnd.uniform(-180, 170), rnd.uniform(-90, 80), 10 ** rnd.uniform(-3, 2), 10 ** rnd.uniform(-3, 1.5)))
    a, b = [box(i) for i in range(80)] + [(99, 0.0, 0.0, 0.0, 0.0), (100, None, 0.0, 1.0, 1.0)], [box(i) for i in range(80)] + [(99, 0.0, 0.0, 9.0, 9.0), (98, -9.0, -9.0, 0.0, 0.0)]
    want = {(r[0], x[0]) for x in a for r in b if x[1] is not None and x[1] <= r[3] and x[3] >= r[1] and x[2] <= r[4] and x[4] >= r[2]}
    schema = "{} bigint, minx double, miny double, maxx double, maxy double"
    got = [(r.rect_id, r.box_id) for r in P.boxes_meet(spark.createDataFrame(a, schema.format("box_id")), spark.createDataFrame(b, schema.format("rect_id"))).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 15


def test_locations(spark):
    geom = "struct<type:tinyint,xy:array<double>>"
    nan = float("nan")
    v = spark.createDataFrame(
        [(1, 1, (1, [1.0, 2.0])), (1, 1, (1, [1.0, 2.0])), (2, 1, (1, [])), (3, 1, (1, None)), (4, 1, None), (5, 1, (1, [nan, 1.0])), (6, 1, (1, [0.0, 0.0])), (7, 1, (1, [181.0, 0.0])), (8, 1, (3, [1.0, 1.0])), (9, 2, (1, [111319.49079327358, 0.0])), (None, 1, (1, [1.0, 1.0])), (10, 1, (1, [None, 1.0])), (11, None, (1, [5.0, 5.0]))],
        f"fid bigint, file_id bigint, geom {geom}",
    )
    s = spark.createDataFrame([(50, (1, [3.0, 4.0, 5.0]))], f"fid bigint, geom {geom}")
    h = spark.createDataFrame([(1, (4326,)), (2, (3857,)), (2, (3857,)), (3, None)], "file_id bigint, crs struct<code:int>")
    got = {r.fid: (r.file_id, round(r.lon, 9), round(r.lat, 9)) for r in P.locations(v, s, h).collect()}
    assert got == {1: (1, 1.0, 2.0), 9: (2, 1.0, 0.0), 11: (None, 5.0, 5.0), 50: (None, 3.0, 4.0)}
