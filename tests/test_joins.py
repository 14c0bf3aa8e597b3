import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.operators import joins as J


def km(a, b):
    p, q = np.radians(a), np.radians(b)
    h = np.sin((p[0] - q[0]) / 2) ** 2 + np.cos(p[0]) * np.cos(q[0]) * np.sin((p[1] - q[1]) / 2) ** 2
    return 2 * 6371.0088 * np.arcsin(np.sqrt(min(1, h)))


def points(spark, pts):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "station_id bigint, lat double, lon double")


def network():
    rng = np.random.default_rng(3)
    pts = [(rng.uniform(-89, 89), rng.uniform(-180, 180)) for _ in range(60)]
    return pts + [(10.0, 179.9), (10.1, -179.9), (88.5, 0.0), (88.6, 175.0), (22.0, 90.0), (22.2, 90.1), (-89.9, 10.0)]


@pytest.mark.parametrize("radius", [80.0, 700.0, 2500.0])
def test_pairs_within_matches_brute_force(spark, radius):
    pts = network()
    got = {(r.a, r.b) for r in J.pairs_within(points(spark, pts), radius).collect()}
    rows = J.pairs_within(points(spark, pts), radius).count()
    want = {(i, j) for i in range(len(pts)) for j in range(i + 1, len(pts)) if km(pts[i], pts[j]) <= radius}
    assert got == want and rows == len(want)


def test_nearest_point_matches_brute_force(spark):
    pts = network()
    got = {r.station_id: r.km for r in J.nearest_point(points(spark, pts), points(spark, pts), "station_id", exclude_self=True).collect()}
    assert len(got) == len(pts)
    for i, p in enumerate(pts):
        assert abs(got[i] - min(km(p, q) for j, q in enumerate(pts) if j != i)) < 1e-6


def test_nearest_point_far_away(spark):
    t = points(spark, [(-60.0, -150.0), (21.0, 90.0)])
    got = {r.station_id: round(r.km, 3) for r in J.nearest_point(t, points(spark, [(22.0, 90.0)]), "station_id").collect()}
    assert got == {0: round(km((-60, -150), (22, 90)), 3), 1: round(km((21, 90), (22, 90)), 3)}


def test_polygon_with_hole(spark):
    def ring(i, hole, pts):
        return [(0, i, hole, *map(float, pts[k]), *map(float, pts[(k + 1) % len(pts)])) for k in range(len(pts))]
    e = ring(0, False, [(0, 0), (4, 0), (4, 4), (0, 4)]) + ring(1, True, [(1, 1), (2, 1), (2, 2), (1, 2)])
    edges = spark.createDataFrame(e, "poly_id int, ring_id int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")
    p = points(spark, [(3.0, 3.0), (1.5, 1.5), (5.0, 5.0), (4.01, 2.0)])
    got = {r.station_id: r.inside for r in J.points_in_polygons(p, edges, "station_id").collect()}
    assert got == {0: True, 1: False, 2: False, 3: False}
    assert {r.station_id for r in J.near_polygon_edge(p, edges, "station_id", 0.02).collect()} == {3}


def test_interval_join_keeps_each_pair_once(spark):
    rng = np.random.default_rng(4)
    a = [(i, float(x), float(x + w)) for i, (x, w) in enumerate(zip(rng.uniform(0, 20, 40), rng.uniform(.1, 9, 40)))]
    b = [(i, float(x), float(x + w)) for i, (x, w) in enumerate(zip(rng.uniform(0, 20, 40), rng.uniform(.1, 9, 40)))]
    j = J.interval_join(spark.createDataFrame(a, "a int, lo double, hi double"), spark.createDataFrame(b, "b int, rlo double, rhi double"), "lo", "hi", "rlo", "rhi", 1.0)
    got = sorted((r.a, r.b) for r in j.collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])


def test_bearing_gap_interior_and_edge(spark):
    p = points(spark, [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (60, 60)])
    g = {r.station_id: r.gap_deg for r in J.bearing_gap(p, 6).collect()}
    assert abs(g[0] - 90) < 1e-9 and g[1] >= 180 and g[5] > 300.0
    assert J.bearing_gap(points(spark, [(0, 0)]), 6).first().gap_deg == 360.0


def test_k_nearest_matches_brute_force(spark):
    pts = network()
    c = np.cos(np.radians(np.mean([p[0] for p in pts])))
    got = {}
    for r in J.k_nearest(points(spark, pts), 4).collect():
        got.setdefault(r.station_id, []).append(r.d2)
    for i, p in enumerate(pts):
        want = sorted((q[0] - p[0]) ** 2 + ((q[1] - p[1]) * c) ** 2 for j, q in enumerate(pts) if j != i)[:4]
        assert np.allclose(sorted(got[i]), want)


def test_end_hour_rule(spark):
    d = spark.createDataFrame([(3,), (0,), (24,)], "h int")
    assert [r[0] for r in d.select(J.end_hour_offset("h", 1)).collect()] == [1, 0, 0]
    with pytest.raises(Exception, match="unsupported end hour"):
        spark.createDataFrame([(6,)], "h int").select(J.end_hour_offset("h", 1)).collect()
