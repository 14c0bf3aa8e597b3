import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions import scalar as S
from rainloom.functions.lattice import Lattice
from rainloom.operators import checks as C, ensembles as E, resample as B, select as SE, temporal as T, update as U
from rainloom.sources import archive as A, granules as GN
from rainloom.streaming import windows as WN


# ---- windows and inventories ----------------------------------------------

def steps(spark, n=48, rate=0.5):
    """Half hours of one reporting day, two of them at three times the rate."""
    t0 = dt.datetime(2021, 8, 14, 3)
    return spark.createDataFrame([(1, t0 + dt.timedelta(minutes=30 * i), rate * (3 if i in (7, 20) else 1), 0.2) for i in range(n)], "cell int, ts timestamp_ntz, rate double, err double")


def test_reporting_day(spark):
    r = T.accumulate_windows(steps(spark), ["cell"], 48, error="err").first()
    assert r.date == dt.date(2021, 8, 15) and r.precip_mm == 0.25 * 52 and r.error_mm == pytest.approx(0.1 * math.sqrt(48)) and r.n_valid == 48
    short = T.accumulate_windows(steps(spark, 31), ["cell"], 48, error="err").first()
    assert short.precip_mm is None and short.error_mm is None and short.n_valid == 31


def test_half_hour_inventory(spark):
    names = []
    t0 = dt.datetime(2021, 2, 27, 3)
    for i in range(48):
        t = t0 + dt.timedelta(minutes=30 * i)
        e = t + dt.timedelta(minutes=29, seconds=59)
        names.append((f"sat.{t:%Y%m%d}-S{t:%H%M%S}-E{e:%H%M%S}.bin",))
    day = F.lit("2021-02-28").cast("date")
    one = GN.window_status(GN.half_hour_inventory(spark.createDataFrame(names, "file string"), day, day)).first()
    assert (one.missing, one.duplicated) == (0, 0)
    bad = names[:12] + names[13:] + [(names[0][0].replace("-E032959", "-E032958"),), (names[30][0].replace(".bin", ".b2"),)]
    two = GN.window_status(GN.half_hour_inventory(spark.createDataFrame(bad, "file string"), day, day)).first()
    assert (two.missing, two.duplicated) == (1, 1)


def test_daily_inventory_and_counts(spark):
    f = spark.createDataFrame([("a.20200101-S000000-E235959.x",), ("b.20200101-S000000-E235959.x",), ("a.20200103-S000000-E235959.x",)], "file string")
    s = {str(r.day): r.status for r in GN.daily_inventory(f, F.lit("2020-01-01").cast("date"), F.lit("2020-01-03").cast("date")).collect()}
    assert s == {"2020-01-01": "duplicate", "2020-01-02": "missing", "2020-01-03": "ok"}
    d = spark.createDataFrame([(5.0, 1.0, 40), (5.0, 1.0, 39), (-1.0, 1.0, 48), (float("nan"), 1.0, 48)], "precip_mm double, error_mm double, n_valid int")
    assert [r.precip_mm for r in GN.daily_field(d).collect()] == [5.0, None, None, None]


def test_hourly_total_shifts_the_label(spark):
    t0 = dt.datetime(2020, 1, 1, 1)
    d = spark.createDataFrame([(1, t0 + dt.timedelta(hours=i), 0.001) for i in range(24)], "cell int, ts timestamp_ntz, tp double")
    r = T.daily_total(d, ["cell"], "tp").collect()
    assert len(r) == 1 and r[0].date == dt.date(2020, 1, 1) and r[0].tp == pytest.approx(24.0)


def test_runs_and_segments(spark):
    v = [1.0, 1.0, 1.0, None, 1.0, 0.0, 0.0, 0.0, 0.0, 2000.0]
    d = spark.createDataFrame([(1, dt.date(2020, 1, 1) + dt.timedelta(days=i + (5 if i > 6 else 0)), x) for i, x in enumerate(v)], "station_id int, date date, precip_mm double")
    r = T.stuck_runs(d).first()
    assert r.longest_run == 3 and r.n_over_max == 1 and r.suspicious
    assert T.segments(d, ["station_id"]).agg(F.max("segment")).first()[0] == 1


def test_balanced_days_refuse_gaps(spark):
    days = spark.createDataFrame([(dt.date(2020, 6, 1),), (dt.date(2021, 7, 1),)], "date date")
    with pytest.raises(Exception, match="incomplete year-month"):
        T.balanced_days(days, 2, (6, 7)).collect()


def test_lag_peak(spark):
    rng = np.random.default_rng(0)
    a = rng.gamma(1, 5, 200)
    d = spark.createDataFrame([(dt.date(2020, 1, 1) + dt.timedelta(days=i), float(x), float(x + e)) for i, (x, e) in enumerate(zip(a, rng.normal(0, .5, 200)))], "date date, a double, b double")
    c = {r.lag: r.corr for r in T.lag_correlations(d, "a", "b", [-2, -1, 0, 1, 2]).collect()}
    assert max(c, key=c.get) == 0 and c[0] > .95


# ---- resampling -----------------------------------------------------------

def series(spark, shift):
    rng = np.random.default_rng(1)
    return spark.createDataFrame([("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(shift + x), 1) for i, x in enumerate(rng.normal(0, 1, 60))], "k string, date date, num double, den int")


def test_block_bootstrap_brackets_the_mean_and_repeats(spark):
    a = B.block_bootstrap(series(spark, 3.0), ["k"], 3, 200, 1).first()
    assert a.ci_low < a["mean"] < a.ci_high and a.significant and a.n_days == 60
    b = B.block_bootstrap(series(spark, 3.0).repartition(7), ["k"], 3, 200, 1).first()
    assert (b.ci_low, b.ci_high) == pytest.approx((a.ci_low, a.ci_high), rel=1e-12)
    assert not B.block_bootstrap(series(spark, 0.0), ["k"], 3, 200, 1).first().significant


def test_constant_series_has_a_point_interval(spark):
    d = series(spark, 0.0).withColumn("num", F.lit(2.0)).where(F.dayofmonth("date") != 9)
    r = B.block_bootstrap(d, ["k"], 5, 50, 2, segmented=True).first()
    assert r.ci_low == r.ci_high == 2.0 and r.n_segments == 3


def test_sample_bootstrap(spark):
    d = spark.createDataFrame([("c", i, float(i % 5)) for i in range(500)], "k string, id bigint, v double")
    r = B.sample_bootstrap(d, ["k"], "v", "id", 60, 3).first()
    assert r.n == 500 and r["mean"] == 2.0 and r.ci_low < 2.0 < r.ci_high and r.ci_high - r.ci_low < .5


def test_different_truth_is_refused(spark):
    rows = [("a", dt.date(2020, 1, 1), 1, 1.0, [1.0, 2.0]), ("b", dt.date(2020, 1, 1), 1, 2.0, [1.0, 2.0])]
    d = spark.createDataFrame(rows, "method string, date date, station_id int, truth double, members array<double>")
    with pytest.raises(Exception, match="different truth"):
        B.paired_crps(d, "a", "b").collect()


def test_placement_test_finds_a_real_pattern(spark):
    rng = np.random.default_rng(2)
    rows = [(b, o, float(t), float(t + e)) for b in range(40) for o, (t, e) in enumerate(zip(rng.normal(size=4), rng.normal(0, .1, 4)))]
    d = spark.createDataFrame(rows, "b int, o int, t double, c double")
    r = B.placement_test(d, ["b"], "c", "t", "o", 19, 4).first()
    assert r.corr_p == pytest.approx(1 / 20) and r.mse_p == pytest.approx(1 / 20) and r.observed_corr > r.null_corr_mean


# ---- selection ------------------------------------------------------------

def stations(spark, pts):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "station_id bigint, lat double, lon double")


def nine(d):
    """Squared distances to nine digits, as the selection compares them: a regular network has many equal ones."""
    return np.floor(d * 1e9 + 0.5) / 1e9


def greedy(pts, count):
    p = np.array(pts, float)
    x = np.column_stack([p[:, 0], p[:, 1] * np.cos(np.radians(p[:, 0].mean()))])
    sel = [int(np.argmax(nine(((x - x.mean(0)) ** 2).sum(1))))]
    while len(sel) < count:
        d = nine(((x[:, None] - x[sel][None]) ** 2).sum(2)).min(1)
        d[sel] = -np.inf
        sel.append(int(np.argmax(d)))
    return sel, x


def test_spread_holdout_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.uniform([20, 88], [27, 93], (150, 2)).tolist()
    assert SE.spread_holdout(stations(spark, pts), 20) == greedy(pts, 20)[0]
    corners = [(20, 88), (20, 92), (26, 88), (26, 92), (23, 90)]
    assert 4 not in SE.spread_holdout(stations(spark, corners), 4)


def test_farthest_order_matches_brute_force(spark):
    """Clusters, a regular network with ties, and a third of all rows at one place; the first rows agree with the whole order."""
    rng = np.random.default_rng(6)
    pts = [*(rng.normal(0, .02, (40, 2)) + [22, 90]).tolist(), *rng.uniform([20, 88], [27, 93], (40, 2)).tolist(), *[(20 + .5 * i, 88 + .5 * j) for i in range(6) for j in range(6)], *[(24.1, 91.3)] * 55]
    order, x = greedy(pts, 130)
    got = [r.station_id for r in SE.farthest_order(stations(spark, pts)).orderBy("rank").collect()]
    assert got[:100] == order[:100] and sorted(got) == list(range(len(pts)))
    assert [r.station_id for r in SE.farthest_order(stations(spark, pts), 30).orderBy("rank").collect()] == order[:30]
    same = SE.farthest_order(stations(spark, [(24.1, 91.3)] * 5), 4).orderBy("rank").collect()
    assert [(r.station_id, r["rank"]) for r in same] == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert SE.farthest_order(stations(spark, pts).where("false")).count() == 0


def test_spread_folds_match_brute_force(spark):
    pts = [(20 + i, 88 + j + 0.01 * i * j) for i in range(5) for j in range(16)]
    order, x = greedy(pts, len(pts))
    folds = [[] for _ in range(5)]
    for s in order:
        low = min(map(len, folds))
        c = [i for i in range(5) if len(folds[i]) == low]
        score = [math.inf if not folds[i] else nine(((x[folds[i]] - x[s]) ** 2).sum(1)).min() for i in c]
        folds[c[int(np.argmax(score))]].append(s)
    got = {r.station_id: r.fold for r in SE.spread_folds(stations(spark, pts), 5).collect()}
    assert got == {s: i for i, f in enumerate(folds) for s in f}


def test_supported_holdout_keeps_support(spark):
    rng = np.random.default_rng(4)
    pts = [(22 + .4 * i + rng.uniform(-.05, .05), 89 + .4 * j + rng.uniform(-.05, .05)) for i in range(6) for j in range(6)]
    held = SE.supported_holdout(stations(spark, pts), 5)
    assert len(set(held)) == 5
    for h in held:
        d = [111 * math.hypot(pts[h][0] - p[0], (pts[h][1] - p[1]) * math.cos(math.radians(pts[h][0]))) for i, p in enumerate(pts) if i not in held]
        assert min(d) < 76
    with pytest.raises(ValueError, match="qualify"):
        SE.supported_holdout(stations(spark, [(0, 0), (40, 40), (-40, 80)]), 2)


# ---- ensemble update ------------------------------------------------------

def test_update_shrinks_the_innovation_and_spares_remote_cells(spark):
    g = Lattice(88.0, 20.0, 8, 8, 0.5)
    rng = np.random.default_rng(5)
    rows = [(dt.date(2020, 1, 1), i, j, [float(v) for v in np.log1p(rng.gamma(2, 5) * rng.uniform(.5, 2, 6) / .1)]) for i in range(8) for j in range(8)]
    f = spark.createDataFrame(rows, "day date, iy int, ix int, members array<double>")
    s = stations(spark, [(20.75, 88.75), (21.2, 89.3)])
    o = spark.createDataFrame([(0, dt.date(2020, 1, 1), 60.0), (1, dt.date(2020, 1, 1), 40.0)], "station_id bigint, day date, obs_mm double")
    before = U.innovation_rmse(f, s, o, g).first().rmse
    new = U.update_serial(f, s, o, [1, 0], g, 0.1, 120.0).cache()
    assert U.innovation_rmse(new, s, o, g).first().rmse < before
    old = {(r[1], r[2]): r[3] for r in rows}
    for r in new.where("iy >= 5 and ix >= 5").collect():
        assert list(r.members) == old[(r.iy, r.ix)]


def test_serial_update_is_the_fold_of_single_updates(spark):
    g = Lattice(88.0, 20.0, 6, 6, 0.5)
    rng = np.random.default_rng(8)
    days = [dt.date(2020, 1, 1), dt.date(2020, 1, 2)]
    f = spark.createDataFrame([(d, i, j, np.log1p(rng.gamma(2, 5, 5) / .1).tolist()) for d in days for i in range(6) for j in range(6) if (i, j) != (2, 2)], "day date, iy int, ix int, members array<double>")
    s = stations(spark, [(20.75, 88.75), (21.2, 89.3), (21.4, 89.1), (22.9, 90.9), (20.1, 90.2)]).withColumn("turn", F.expr("(station_id * 3 + 1) % 5"))
    o = spark.createDataFrame([(i, d, float(rng.gamma(2, 20))) for i in range(5) for d in days if (i, d) != (2, days[1])], "station_id bigint, day date, obs_mm double")
    want = f
    for k in (3, 0, 2, 4, 1):
        want = spark.createDataFrame(U.update_once(want, s.where(f"station_id = {k}"), o.where(f"station_id = {k}"), g, 0.1, 150.0).collect(), f.schema)
    want = {(r.day, r.iy, r.ix): r.members for r in want.collect()}
    for order in ([3, 0, 2, 4, 1], "turn"):
        got = {(r.day, r.iy, r.ix): r.members for r in U.update_serial(f, s, o, order, g, 0.1, 150.0).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-10) for k in want)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not mounted")
def test_serial_update_query_takes_every_gauge(spark):
    from rainloom.functions.lattice import VIEW_LATTICE as G
    from rainloom.operators import joins as J
    from rainloom.plans import catalog, joins as PJ, views as V

    sf = "/root/testdata/sf0.001"
    seen = J.bilinear_members(PJ.grid_members(spark, sf), V.station(spark, sf), G).groupBy("day").count().collect()
    got = {r.day: r.n_gauges for r in catalog.QUERIES["ens02_serial_update"](spark, sf).collect()}
    assert got == {r.day: r["count"] for r in seen} and max(got.values()) > 3


# ---- archives and sinks ---------------------------------------------------

def test_pack_resumes(spark, tmp_path):
    def days(y, n):
        return [(dt.date(y, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(n)]
    out = str(tmp_path / "pack")
    a = spark.createDataFrame(days(2019, 365) + days(2020, 366), "day date, value double")
    assert A.pack(a, out) == [2019, 2020]
    assert A.pack(a, out) == []
    assert A.pack(a.unionByName(spark.createDataFrame(days(2021, 365), "day date, value double")), out) == [2021]
    assert spark.read.parquet(f"{out}/data").count() == 1096
    with pytest.raises(ValueError, match="2022"):
        A.pack(spark.createDataFrame(days(2022, 10), "day date, value double"), out)


def ens_rows(spark, days):
    return spark.createDataFrame([(m, dt.date(2020, 5, 1) + dt.timedelta(days=d), 0, 0, [0.0, 4.0]) for m in ("a", "b") for d in days], "method string, day date, iy int, ix int, members array<double>")


def test_ensemble_archive(spark, tmp_path):
    p = str(tmp_path / "season")
    A.write_ensemble(ens_rows(spark, range(4)), p, ["a", "b"])
    r = spark.read.parquet(p).first()
    assert r.ensemble_mean == 2.0 and r.ensemble_std == pytest.approx(math.sqrt(8)) and 0.0 in r.members
    with pytest.raises(Exception, match="(?i)exist"):
        A.write_ensemble(ens_rows(spark, range(4)), p, ["a", "b"])
    with pytest.raises(ValueError, match="contiguous"):
        A.write_ensemble(ens_rows(spark, [0, 2]), str(tmp_path / "x"), ["a", "b"])
    with pytest.raises(ValueError, match="method list"):
        A.write_ensemble(ens_rows(spark, [0]), str(tmp_path / "y"), ["a"])


def test_season_union_refuses_overlap(spark):
    assert A.union_seasons([ens_rows(spark, [0, 1]), ens_rows(spark, [2])]).count() == 6
    with pytest.raises(Exception, match="overlapping day"):
        A.union_seasons([ens_rows(spark, [0, 1]), ens_rows(spark, [1])]).collect()


def test_chunk_merge(spark):
    d = spark.createDataFrame([("a", 10, 1.0, 5.0, "mm"), ("a", 30, 2.0, float("nan"), "mm"), ("a", 5, float("nan"), 9.0, "mm")], "arm string, days int, v double, worst double, unit string")
    r = A.merge_chunks(d, ["arm"], ["v"], "days", ["worst"], ["unit"]).first()
    assert r.v == pytest.approx(70 / 40) and r.worst == 9.0 and r.days == 45 and r.unit == "mm"
    with pytest.raises(Exception, match="inconsistent unit"):
        A.merge_chunks(d.withColumn("unit", F.col("days").cast("string")), ["arm"], ["v"], "days", [], ["unit"]).collect()


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("x_1", 1.0, float("nan"))], "name string, v double, w double")
    b = spark.createDataFrame([("y", 2)], "name string, n int")
    A.write_json(a, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    assert json.loads(text) == {"name": "x_1", "v": 1.0, "w": None}
    A.write_csv([a, b], str(tmp_path / "c"))
    assert set(spark.read.csv(str(tmp_path / "c"), header=True).columns) == {"name", "v", "w", "n"}
    assert A.markdown_lines(A.finite_columns(a), ["name", "v", "w"]).first()[0] == "| x_1 | 1.000 | n/a |"
    assert A.latex_lines(A.finite_columns(a), ["name", "v"]).first()[0] == r"x\_1 & 1.000 \\"


def test_guards(spark):
    d = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    with pytest.raises(Exception, match="duplicate a"):
        C.require_unique(d, ["a"]).select("b").collect()
    assert C.require_unique(d, ["b"]).count() == 2


# ---- streaming ------------------------------------------------------------

def test_stream_windows_drop_late_rows_and_repeats(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def row(i, t, v=1.0):
        return (i, t, 1, "view", v, "{}")
    d0 = dt.datetime(2020, 1, 1, 3)
    put("b1", [row(i, d0 + dt.timedelta(minutes=30 * i), 2.0) for i in range(48)] + [row(5, d0 + dt.timedelta(minutes=150), 2.0)])
    s = WN.event_stream(spark, str(tmp_path / "in" / "*"), "*.parquet").select("event_id", F.col("user_id").alias("station_id"), WN.event_time("ts").alias("ts"), F.col("value").alias("rate"))
    w = WN.reporting_windows(s, ["station_id"], 48, granule="event_id")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    WN.run_to_files(w, out, ck)
    put("b2", [row(900, d0 + dt.timedelta(days=1, hours=12)), row(901, d0 + dt.timedelta(days=3))])
    WN.run_to_files(w, out, ck)
    put("b3", [row(902, d0 + dt.timedelta(hours=1), 99.0), row(903, d0 + dt.timedelta(days=5))])
    WN.run_to_files(w, out, ck)
    got = {str(r.date): (r.precip_mm, r.n_valid) for r in spark.read.parquet(out).collect()}
    assert got["2020-01-02"] == (48.0, 48) and got["2020-01-03"] == (None, 1) and got["2020-01-05"] == (None, 1)


def test_running_scores_match_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    for k in range(3):
        rows = [(str(i % 2), float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))]
        spark.createDataFrame(rows, "product string, pred double, obs double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("product string, pred double, obs double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    WN.run_updates(WN.running_scores(s, ["product"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r["product"]: (r.n, round(r.corr, 9), round(r.rmse, 9)) for r in WN.latest_scores(spark, str(tmp_path / "out"), ["product"]).collect()}
    b = spark.read.parquet(str(tmp_path / "in")).groupBy("product").agg(F.count("*").alias("n"), F.corr("pred", "obs").alias("c"), F.sqrt(F.avg((F.col("pred") - F.col("obs")) ** 2)).alias("r"))
    assert got == {r["product"]: (r.n, round(r.c, 9), round(r.r, 9)) for r in b.collect()}


# ---- guards under pruning -------------------------------------------------

def stops(df, match):
    for narrow in (lambda d: d.select(d.columns[0]).collect(), lambda d: d.count()):
        with pytest.raises(Exception, match=match):
            narrow(df)


def test_guards_hold_when_their_columns_are_pruned(spark):
    from rainloom.operators import bias as B, grid as GR, joins as J, resample as RS
    from rainloom.sources import stations as ST

    facts, dim = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), spark.createDataFrame([("a", 7)], "k string, id int")
    stops(J.many_to_one(facts, dim, "k", "id").select("v"), "no match for k=b")
    assert J.many_to_one(facts.where("v = 1"), dim, "k", "id").count() == 1
    stops(GR.require_covered(spark.createDataFrame([(1, 0.5, 0.4)], "t int, weight double, coverage double")).select("t"), "does not cover")
    row = ["x", "2020", "1", *["5"] * 30, "what"]
    stops(ST.month_matrix_long(spark.createDataFrame([row], ["Stati", "Year", "Month", *map(str, range(1, 32))])).select("name"), "unrecognized precipitation token")
    runs = spark.createDataFrame([("2020-01-01", 1, "p", [1.0, 2.0], 1.0), ("2020-01-01", 1, "q", [1.0, 2.0], 2.0)], "date string, station_id int, method string, members array<double>, truth double")
    stops(RS.paired_crps(runs, "p", "q").select("date"), "different truth")
    maps = spark.createDataFrame([(2020, 1, 0, 0, 0.1, [1.0], [1.0])], "holdout int, stratum int, iy int, ix int, cut double, source_knots array<double>, target_knots array<double>")
    obs = spark.createDataFrame([(5.0, 2021, 1, 0, 0)], "v double, year int, stratum int, iy int, ix int")
    stops(B.apply_quantile_map(obs, maps, "v").select("v"), "no map fitted")


def test_distance_to_a_far_false_cell(spark):
    from rainloom.operators import stats as ST

    cells = [(0, k, k > 0) for k in range(9000)]
    got = {r.ix: r.distance for r in ST.distance_to_false(spark.createDataFrame(cells, "iy int, ix int, ok boolean"), "ok", 4).collect()}
    assert got == {k: float(k) for k in range(1, 9000)}
    none = ST.distance_to_false(spark.createDataFrame([(0, 1, True), (3, 3, True)], "iy int, ix int, ok boolean"), "ok").collect()
    assert [r.distance for r in none] == [None, None]


def test_idw_weighs_every_gauge_and_keeps_every_day(spark):
    from rainloom.operators import verify as X

    at = [(1, 20.0, 88.0), (2, 21.0, 88.0), (3, 60.0, 120.0)]
    st = spark.createDataFrame(at, "station_id int, lat double, lon double")
    obs = spark.createDataFrame([(2, "d1", 4.0), (3, "d1", 100.0), (2, "d2", None)], "station_id int, date string, v double")
    got = {r.date: r for r in X.idw(obs, st.where("station_id = 1"), st, "v").collect()}
    c = math.cos(math.radians(sum(a[1] for a in at) / 3))
    w = [1.0, 1 / ((32 * c) ** 2 + 40 ** 2)]
    assert abs(got["d1"].idw - (4 * w[0] + 100 * w[1]) / sum(w)) < 1e-12 and got["d1"].n_gauges == 2
    assert got["d2"].idw is None and got["d2"].n_gauges == 0


def test_cluster_without_a_shared_folder_stops(monkeypatch):
    from rainloom import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_written_tables_are_released(spark):
    from rainloom import session

    df = session.cut_lineage(spark.range(5))
    path = session.WRITTEN[-1]
    assert df.count() == 5 and session.release(spark) > 0 and not os.path.exists(path.removeprefix("file:"))


def test_source_rules_stop(spark):
    from rainloom.functions.lattice import VIEW_LATTICE as G
    from rainloom.sources import archive as A, granules as GN

    day = lambda d: dt.date(2024, 3, d)
    shards = spark.createDataFrame([(day(1), "a", 1.0, "mm/day", 3), (day(1), "b", 2.0, "mm/day", 3), (day(3), "b", 3.0, "inches", 0)], "day date, shard string, v double, units string, hour int")
    with pytest.raises(ValueError, match="2024-03-02"):
        GN.subset_shards(shards, "2024-03-01", "2024-03-03", "shard")
    assert [r.shard for r in GN.subset_shards(shards, "2024-03-01", "2024-03-01", "shard", units="units", end_hour="hour").collect()] == ["a"]
    stops(GN.subset_shards(shards, "2024-03-03", "2024-03-03", "shard", complete=False, units="units").select("v"), "unexpected units")
    stops(GN.subset_shards(shards, "2024-03-03", "2024-03-03", "shard", complete=False, end_hour="hour").select("v"), "ends at hour 0")

    made = shards.where("day < '2024-03-02'").withColumn("made", F.lit("daily")).withColumn("how", F.when(F.col("shard") == "a", "day-shift"))
    window = ("2024-03-01", "2024-03-01", "shard")
    stops(GN.subset_shards(made.where("shard = 'b'"), *window, complete=False, frequency="made", alignment="how").select("v"), "not prepared from half-hourly")
    stops(GN.subset_shards(made.where("shard = 'a'"), *window, complete=False, frequency="made", alignment="how").select("v"), "not allowed")
    assert GN.subset_shards(made.where("shard = 'a'"), *window, frequency="made", alignment="how", allow_day_shift=True).count() == 1
    assert GN.subset_shards(made.withColumn("made", F.lit("half-hourly")), *window, frequency="made").count() == 1

    def field(rows):
        return spark.createDataFrame([(day(d), y, 0, 1.0) for d, y in rows], "day date, iy int, ix int, v double")

    assert GN.concat_products([field([(1, 0), (1, 1)]), field([(2, 0), (2, 1)])]).count() == 4
    stops(GN.concat_products([field([(1, 0)]), field([(1, 0)])]).select("v"), "duplicate")
    stops(GN.concat_products([field([(1, 0), (1, 1)]), field([(2, 0)])]).select("v"), "sources differ")
    one, point = field([(1, 0)]).withColumnRenamed("v", "value"), "station_id int, lat double, lon double"
    with pytest.raises(ValueError, match="no station"):
        GN.at_stations(one, spark.createDataFrame([(1, -80.0, 10.0)], point), G)
    border = spark.createDataFrame([(1, 20.01, 86.01), (2, None, 86.01)], point)
    assert [tuple(r) for r in GN.at_stations(one, border, G).collect()] == [(1, day(1), 1.0, 1.0)]
    asked = spark.createDataFrame([(day(2),), (day(3),)], "date date")
    assert GN.at_stations(one, border, G, requested=asked, offset_days=-1).count() == 1
    with pytest.raises(ValueError, match="matched no day of 2 requested days 2024-03-02..2024-03-03.*covers 2024-03-01..2024-03-01"):
        GN.at_stations(one, border, G, requested=asked)
    with pytest.raises(ValueError, match="matched no day"):
        GN.at_stations(one.where("false"), border, G)


def test_footprints_are_repeated_not_interpolated(spark):
    from rainloom.functions.lattice import VIEW_LATTICE as G
    from rainloom.sources import granules as GN

    rng = np.random.default_rng(5)
    coarse = rng.random((4, 4))
    product = spark.createDataFrame([(dt.date(2024, 3, 1), i, j, float(coarse[i, j])) for i in range(4) for j in range(4) if (i, j) != (2, 2)], "day date, iy int, ix int, value double")
    at = [(20.0 + 8 * float(rng.random()), 86.0 + 8 * float(rng.random())) for _ in range(60)]
    stations = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "station_id int, lat double, lon double")
    got = {r.station_id: r.value for r in GN.at_stations(product, stations, G, factor=4).collect()}
    fine = np.repeat(np.repeat(np.where(np.arange(16).reshape(4, 4) == 10, np.nan, coarse), 4, 0), 4, 1)
    for k, (lat, lon) in enumerate(at):
        y, x = (min(max((v - a) / 0.5, 0), 14.999999) for v, a in ((lat, 20.25), (lon, 86.25)))
        i, j = int(y), int(x)
        w = np.array([[(1 - y + i) * (1 - x + j), (1 - y + i) * (x - j)], [(y - i) * (1 - x + j), (y - i) * (x - j)]])
        cells = fine[i:i + 2, j:j + 2]
        w = np.where(np.isnan(cells), 0, w)
        assert (k in got) == (w.sum() > 0) and (k not in got or got[k] == pytest.approx(np.nansum(w * cells) / w.sum(), rel=1e-9))


def test_more_source_rules_stop(spark):
    from rainloom.sources import archive as A

    day = lambda d: dt.date(2024, 3, d)

    def season(d, methods=("p", "q"), y=0):
        return spark.createDataFrame([(day(d), m, y) for m in methods], "day date, method string, iy int")

    assert A.union_seasons([season(1), season(2)], grid=["iy"]).count() == 4
    stops(A.union_seasons([season(1), season(1)]).select("method"), "overlapping day")
    stops(A.union_seasons([season(1), season(2, ("p",))]).select("day"), "sources differ in method")
    stops(A.union_seasons([season(1), season(2, y=5)], grid=["iy"]).select("day"), "sources differ in iy")

    def dump(d, lat):
        return spark.createDataFrame([(day(d), 1, "m", lat, 88.0)], "date date, station_id int, method string, lat double, lon double")

    assert A.union_dumps({("p", 0): dump(1, 20.0), ("p", 1): dump(2, 20.0)}).count() == 2
    stops(A.union_dumps({("p", 0): dump(1, 20.0), ("p", 1): dump(2, 20.5)}).select("method"), "coordinates differ")
    chunks = spark.createDataFrame([("a", 2, 1.0), ("a", 3, 2.0)], "arm string, days int, v double")
    assert A.merge_chunks(chunks, ["arm"], ["v"], "days", expected=5).first().v == 1.6
    stops(A.merge_chunks(chunks, ["arm"], ["v"], "days", expected=6).select("arm"), "unexpected number of days")
    stops(A.merge_days([chunks, chunks], ["arm", "days"]).select("v"), "duplicate")


def test_random_folds_are_those_of_ntile_without_its_window(spark, capsys):
    from pyspark.sql import Window as W

    from rainloom.functions import draws as D

    for n, folds in ((23, 5), (3, 5), (10, 5)):
        ids = spark.range(n).withColumnRenamed("id", "station_id")
        want = ids.select("station_id", (F.ntile(folds).over(W.orderBy(D.draw(9, "station_id"), "station_id")) - 1).alias("fold"))
        got = SE.random_folds(ids, folds, 9)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got.explain()
    assert "ntile" not in capsys.readouterr().out
