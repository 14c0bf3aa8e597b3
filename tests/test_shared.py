"""Shared quantiles, years left out of sorted samples, members as arrays, mergeable replicates, border gauges, blocked baselines."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions import ensemble as EN, order as O
from rainloom.functions.lattice import Lattice
from rainloom.operators import bias as BI, ensembles as E, grid as GR, joins as J, resample as B, stats as ST, update as U, verify as X
from tests.test_jobs import stations, stops


def values(spark, n=4000, seed=1):
    r = np.random.default_rng(seed)
    a = np.round(r.gamma(0.4, 20, n), 1)
    b = -np.exp(r.normal(0, 3, n))
    return a, b, spark.createDataFrame([(float(x) if k % 50 else None, float(y), k % 9, "g" if k % 3 else "h") for k, (x, y) in enumerate(zip(a, b))], "a double, b double, day int, k string").repartition(5)


def test_shared_quantiles_equal_numpy(spark):
    a, b, df = values(spark)
    keep = np.arange(len(a)) % 50 > 0
    for keys, parts in (((), {None: np.ones(len(a), bool)}), (("k",), {"g": np.arange(len(a)) % 3 > 0, "h": np.arange(len(a)) % 3 == 0})):
        hist, detail, q = O.shared_quantiles(df, {"a": [0.0, 0.5, 0.99, 1.0], "b": [0.1]}, keys, groups={"by_day": (F.col("day"), F.col("a"))})
        got = {(r["k"] if keys else None, r["column"], r["prob"]): r["value"] for r in q.collect()}
        for k, rows in parts.items():
            for p in (0.0, 0.5, 0.99, 1.0):
                assert got[k, "a", p] == pytest.approx(np.quantile(a[rows & keep], p), rel=1e-12, abs=1e-12)
            assert got[k, "b", 0.1] == pytest.approx(np.quantile(b[rows], 0.1), rel=1e-12)
        days = hist.where("column = 'by_day'").groupBy("g").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n")).collect()
        assert sum(r.rows for r in days) == len(a) and sum(r.n for r in days) == keep.sum() and len(days) == 9
        assert O.pieces(hist, detail, keys).where("column = 'a'").agg(F.sum("n"), F.sum("total")).first()[0] == keep.sum()


def test_ranks_scan_their_source_twice(spark, tmp_path):
    """The source is read by the two aggregations only: what is returned reads written tables."""
    _, _, df = values(spark)
    df.write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    one = ST.satellite_report(df, "a", "b", "day")
    assert f"{tmp_path}/t" not in "".join(one.inputFiles()) and one.count() == 1
    out = ST.intensity_bins(df.select(F.abs("b").alias("x"), F.col("b").alias("y")), "x", F.col("y"))
    assert f"{tmp_path}/t" not in "".join(out.inputFiles()) and out.agg(F.sum("n")).first()[0] > 0
    assert ST.satellite_report(df.where("false"), "a", "b", "day").first().mean_mm is None
    assert ST.physical_summary(df.where("false"), "a").first().n == 0


def test_left_out_years_equal_separate_fits(spark):
    r = np.random.default_rng(3)
    rows = [("s", 1, 1, y, float(r.gamma(0.5, 9)), float(r.gamma(0.6, 9))) for y in (2001, 2002, 2003) for _ in range(60)] + [("s", 1, 2, 2002, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "stratum string, iy int, ix int, year int, s double, t double")
    got = {(m.holdout, m.ix): m for m in BI.fit_quantile_map(df, "s", "t", n_knots=7, wet_mm=1.0, min_samples=20).collect()}
    assert set(got) == {(y, 1) for y in (2001, 2002, 2003)} | {(2001, 2), (2003, 2)}
    for y in (2001, 2002, 2003):
        m = BI.fit_quantile_map(df.where(f"year <> {y} and ix = 1"), "s", "t", n_knots=7, wet_mm=1.0, min_samples=20, leave_out=False).first()
        assert (m.n, m.cut, m.source_knots, m.target_knots) == tuple(got[y, 1][k] for k in ("n", "cut", "source_knots", "target_knots"))


def test_members_stay_in_arrays(spark):
    g = Lattice(88.0, 20.0, 3, 3, 1.0)
    f = spark.createDataFrame([(1, i, j, [float(i + k * j), None if (i, j) == (0, 0) else 1.0, float(k)]) for k in [2] for i in range(3) for j in range(3)], "day int, iy int, ix int, members array<double>")
    p = spark.createDataFrame([(1, 21.0, 89.0), (2, 20.1, 88.1)], "station_id int, lat double, lon double")
    got = {r.station_id: r.members for r in J.bilinear_members(f, p, g).collect()}
    assert got[1] == pytest.approx([1.5, 0.75, 2.0]) and got[2][1] is None
    inside = {r.station_id: r.members for r in J.bilinear_members(f, p, g, clamp=True).collect()}
    assert inside[1] == got[1] and inside[2] == [0.0, None, 2.0]
    s = ST.member_summaries(f.select("day", EN.col("members")), ["day"]).first()
    assert s.member_max == pytest.approx((6 + 1 + 2) / 3) and s.constant_members == 2


def test_border_gauge_reads_its_whole_weight(spark):
    """Members of 2, 3, 4 mm in a constant field are read as 2, 3, 4 up to and beyond the outermost centres."""
    g = Lattice(88.0, 20.0, 4, 4, 0.5)
    members = [math.log1p(v / 0.1) for v in (2.0, 3.0, 4.0)]
    f = spark.createDataFrame([(1, i, j, members) for i in range(4) for j in range(4)], "day int, iy int, ix int, members array<double>")
    s = stations(spark, [(20.1, 88.9), (19.9, 87.95), (21.9, 91.0), (21.75, 89.75)])
    for r in U.predicted_members(f, s, g).collect():
        assert r.hx == pytest.approx(members, rel=1e-12)
    o = spark.createDataFrame([(k, 1, 9.0 + k) for k in range(4)], "station_id bigint, day int, obs_mm double")
    want = f
    for k in (2, 0, 3, 1):
        want = spark.createDataFrame(U.update_once(want, s.where(f"station_id = {k}"), o.where(f"station_id = {k}"), g, 0.1, 150.0).collect(), f.schema)
    want = {(r.iy, r.ix): r.members for r in want.collect()}
    got = {(r.iy, r.ix): r.members for r in U.update_serial(f, s, o, [2, 0, 3, 1], g, 0.1, 150.0).collect()}
    assert all(got[k] == pytest.approx(want[k], rel=1e-10) for k in want) and got.keys() == want.keys()
    two = f.withColumn("members", F.slice("members", 1, 2))
    stops(U.update_once(two, s.where("station_id = 0"), o, g, 0.1, 150.0), "three members")
    stops(U.update_serial(two, s, o, [0], g, 0.1, 150.0), "three members")


def test_replicates_follow_the_documented_law(spark):
    d = spark.createDataFrame([("c", k, float(k % 5)) for k in range(300)] + [("e", 1, None)], "k string, id long, v double")
    r = B.sample_bootstrap(d.repartition(6), ["k"], "v", "id", 80, 3).collect()
    import hashlib

    def weight(rep, i):
        u = int(hashlib.md5(f"3:c:{rep}:{i}".encode()).hexdigest()[:12], 16) / 16.0 ** 12
        return sum(p <= u for p in B.POISSON)

    w = np.asarray([[weight(rep, i) for i in range(300)] for rep in range(80)])
    e = (w * (np.arange(300) % 5)).sum(1) / w.sum(1)
    assert [x.k for x in r] == ["c"] and r[0].n == 300 and r[0]["mean"] == 2.0
    assert (r[0].ci_low, r[0].ci_high) == pytest.approx((np.quantile(e, .025), np.quantile(e, .975)), rel=1e-9)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05


@pytest.mark.parametrize("block", [1024, 3])
def test_blocked_baseline_equals_all_pairs(spark, block):
    r = np.random.default_rng(2)
    at = [(float(20 + r.random()), float(88 + r.random())) for _ in range(12)]
    s = stations(spark, at)
    obs = {(k, d): float(r.gamma(1, 9)) for k in range(8) for d in (1, 2) if r.random() < 0.8}
    o = spark.createDataFrame([(k, d, v) for (k, d), v in obs.items()] + [(0, 3, None)], "station_id int, date int, precip_mm double")
    got = {(x.station_id, x.date): (x.idw, x.n_gauges) for x in X.idw(o, s.where("station_id >= 8"), s, "precip_mm", block=block).collect()}
    c = math.cos(math.radians(np.mean([p[0] for p in at])))
    assert len(got) == 12
    for k in range(8, 12):
        for d in (1, 2):
            near = [(v, max(math.hypot((at[g][1] - at[k][1]) * c, at[g][0] - at[k][0]), 1e-6) ** -2) for (g, day), v in obs.items() if day == d]
            assert got[k, d][1] == len(near) and got[k, d][0] == pytest.approx(sum(v * w for v, w in near) / sum(w for _, w in near), rel=1e-9)
        assert got[k, 3] == (None, 0)


def test_regrid_and_archive_report_stop_or_count(spark):
    wy = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.5)], "iy int, ty int, weight double")
    wx = spark.createDataFrame([(0, 0, 1.0)], "ix int, tx int, weight double")
    for bad in (None, float("nan"), float("inf")):
        f = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 0, bad)], "day int, iy int, ix int, value double")
        stops(GR.conservative_regrid(f, wy, wx), "non-finite")
    rows = [("Old A", "A b", "2020-02-28", "3.5"), ("a-B", "A b", "2020-02-30", "1"), ("Old A", "A b", "2020-03-01", "-999"), ("a-B", "A b", "2020-03-02", "x7"), ("C", "C", "2020-03-02", "0")]
    d = spark.createDataFrame(rows, "source string, catalogued string, day string, cell string")
    date = F.expr("try_to_date(day, 'yyyy-MM-dd')")
    r = ST.archive_report(d, "cell", date, "source", "catalogued").first()
    assert (r.invalid_calendar_cells, r.date_start, r.date_end, r.stations, r.aliases, r.cells, r.valid, r.sentinels, r.unknown_tokens, r.mean_mm) == (1, dt.date(2020, 2, 28), dt.date(2020, 3, 2), 2, 1, 4, 2, 1, 1, 1.75)
    assert [tuple(x) for x in ST.aliases_used(d, date, "source", "catalogued").collect()] == [("Old A", "A b")]
    assert ST.archive_report(d.where("false"), "cell", date, "source", "catalogued").first().cells == 0


@pytest.mark.parametrize("block", [256, 3])
def test_blocked_variogram_equals_all_pairs(spark, block):
    r = np.random.default_rng(9)
    at = [(float(22 + 0.3 * r.random()), float(89 + 0.3 * r.random())) for _ in range(14)] + [(float(20 + 4 * r.random()), float(88 + 4 * r.random())) for _ in range(10)]
    s = stations(spark, at)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(45)]
    obs = {(k, d): float(r.gamma(0.5, 9)) for k in range(24) for d in days if r.random() < 0.7}
    o = spark.createDataFrame([(k, d, v) for (k, d), v in obs.items()] + [(0, dt.date(2020, 5, 1), None)], "station_id int, date date, precip_mm double")
    edges = [5.0, 40.0, 150.0]
    got = {x.bin: (x.distance_km, x.gamma, x.n_pairs) for x in ST.empirical_variogram(o, s, edges, block=block).collect()}
    sums = np.zeros((2, 3))
    for a in range(24):
        for b in range(a):
            p, q = np.radians(at[a]), np.radians(at[b])
            km = 2 * 6371.0088 * math.asin(math.sqrt(math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2))
            d = np.asarray([obs[a, t] - obs[b, t] for t in days if (a, t) in obs and (b, t) in obs])
            if edges[0] <= km < edges[-1]:
                sums[int(km >= edges[1])] += (d @ d, len(d), km * len(d))
    assert set(got) == {0, 1}
    for k in (0, 1):
        assert got[k] == (pytest.approx(sums[k, 2] / sums[k, 1], rel=1e-9), pytest.approx(sums[k, 0] / 2 / sums[k, 1], rel=1e-9), sums[k, 1])


@pytest.mark.parametrize("block", [4096, 50])
def test_polygon_of_many_edges_splits(spark, block):
    """A star of 1,200 edges with a hole, all in few bands, against the even-odd rule."""
    r = np.random.default_rng(6)

    def ring(k, n, low, high, hole):
        t = np.linspace(0, 2 * np.pi, n, endpoint=False)
        rad = np.where(np.arange(n) % 2, low, high)
        x, y = 88 + rad * np.cos(t), 22 + rad * np.sin(t)
        return [(1, k, hole, float(x[i]), float(y[i]), float(x[(i + 1) % n]), float(y[(i + 1) % n])) for i in range(n)]

    edges = ring(0, 1200, 0.2, 0.24, False) + ring(1, 300, 0.05, 0.08, True)
    at = [(float(22 + 0.5 * (r.random() - 0.5)), float(88 + 0.5 * (r.random() - 0.5))) for _ in range(300)]
    p = stations(spark, at)
    e = spark.createDataFrame(edges, "poly_id int, ring_id int, is_hole boolean, x1 double, y1 double, x2 double, y2 double")

    def odd(k, lat, lon):
        return sum((y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1) for _, q, _, x1, y1, x2, y2 in edges if q == k) % 2

    got = {x.station_id: x.inside for x in J.points_in_polygons(p, e, "station_id", block=block).collect()}
    assert got == {k: bool(odd(0, *v) and not odd(1, *v)) for k, v in enumerate(at)}
    near = {x.station_id for x in J.near_polygon_edge(p, e, "station_id", 0.02, block=block).collect()}

    def gap(lat, lon):
        x1, y1, x2, y2 = np.asarray([q[3:] for q in edges]).T
        t = np.clip(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
        return np.hypot(lon - x1 - t * (x2 - x1), lat - y1 - t * (y2 - y1)).min()

    assert near == {k for k, v in enumerate(at) if gap(*v) <= 0.02}


def test_neighbours_of_a_cluster_split(spark, monkeypatch):
    """Most points in one bucket, a few far away: chunks of a few rows give the pairs and neighbours of all pairs."""
    monkeypatch.setattr(J.blocked_join, "__defaults__", (7,))
    r = np.random.default_rng(12)
    at = [(float(22 + 0.05 * r.random()), float(89 + 0.05 * r.random())) for _ in range(40)] + [(-60.0, 10.0), (70.0, -170.0), (22.5, 89.0)]
    s = stations(spark, at)

    def km(a, b):
        p, q = np.radians(at[a]), np.radians(at[b])
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((q[0] - p[0]) / 2) ** 2 + math.cos(p[0]) * math.cos(q[0]) * math.sin((q[1] - p[1]) / 2) ** 2))

    n = len(at)
    assert {(x.a, x.b) for x in J.pairs_within(s, 3.0).collect()} == {(a, b) for a in range(n) for b in range(n) if a < b and km(a, b) <= 3.0}
    got = {x.station_id: x.km for x in J.nearest_point(s, s, "station_id", exclude_self=True).collect()}
    assert len(got) == n and all(got[a] == pytest.approx(min(km(a, b) for b in range(n) if b != a), rel=1e-9) for a in range(n))
    c = math.cos(math.radians(np.mean([p[0] for p in at])))
    near = {}
    for x in J.k_nearest(s, 3).collect():
        near.setdefault(x.station_id, []).append(x.b)
    for a in range(n):
        d = sorted((((at[b][0] - at[a][0]) ** 2 + ((at[b][1] - at[a][1]) * c) ** 2), b) for b in range(n) if b != a)
        assert near[a] == [b for _, b in d[:3]]
