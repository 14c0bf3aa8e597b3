"""Points that share places, sums on a limit, and other inputs of the third review."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.operators import checks as C, ensembles as E, joins as J, resample as B, select as SE, stats as ST, verify as X
from rainloom.plans import decisions, verify, views as V


def stations(spark, at):
    return spark.createDataFrame([(i, float(la), float(lo)) for i, (la, lo) in enumerate(at)], "station_id bigint, lat double, lon double")


def events(spark, folder, rows):
    """Events of (user, day of January, type, value), one row a file, as a table folder."""
    d = spark.createDataFrame([(i, u, f"2024-01-{day:02d} 06:00:00", t, float(v)) for i, (u, day, t, v) in enumerate(rows)], "event_id bigint, user_id bigint, t string, event_type string, value double")
    d.withColumn("ts", F.to_timestamp_ntz("t")).drop("t").repartition(len(rows)).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_holdout_without_candidates_is_empty(spark):
    """where the nearest neighbours of every station share its place, no station has neighbours all around."""
    s = stations(spark, [(22.0 + i % 3, 89.0 + i % 2) for i in range(48)])
    assert SE.supported_holdout(s, 4, radius_km=150.0, max_gap_deg=300.0, fewer=True) == []
    with pytest.raises(ValueError, match="qualify"):
        SE.supported_holdout(s, 4, radius_km=150.0, max_gap_deg=300.0)


def test_holdout_of_crowded_users_is_empty(spark, tmp_path):
    """ids 61 * 47 apart share a place, as in copies with shifted ids; the query and its SQL then return no row."""
    import duckdb
    sf = events(spark, tmp_path, [(u + 61 * 47 * k, 1, "view", 1.0) for u in range(4) for k in range(8)])
    got = decisions.win08(spark, sf)
    assert got.dtypes == [("station_id", "bigint")] and got.collect() == []
    db = duckdb.connect()
    db.execute(f"create view events as select * from read_parquet('{sf}/events.parquet/*.parquet')")
    assert db.execute(decisions.query.__globals__["ORACLES"]["win08_supported_holdout"]).fetchall() == []


def test_holdout_of_fewer_candidates_than_asked_for(spark):
    """only the middle of a line and its eastern end have neighbours on two sides."""
    s = stations(spark, [(22, 89.0)] * 4 + [(22, 89.3), (22, 89.6), (22, 89.6)])
    assert SE.supported_holdout(s, 4, radius_km=150.0, max_gap_deg=300.0, fewer=True) == [4, 5, 6]
    with pytest.raises(ValueError, match="only 3 stations qualify"):
        SE.supported_holdout(s, 4, radius_km=150.0, max_gap_deg=300.0)


def test_correlation_of_values_one_unit_apart(spark):
    """a spread of one unit in the last place is no division by zero."""
    rows = []
    for k, a in enumerate([0.3, 0.1, 5.71, 48.79, 7.3, 9.99]):
        up = math.nextafter(a, math.inf)
        rows += [(2 * k, a, 1.0), (2 * k, up, 2.0), (2 * k + 1, up, 1.0), (2 * k + 1, a, 2.0)]
    d = spark.createDataFrame(rows, "k int, a double, b double").repartition(1, "k").sortWithinPartitions("k", "b")
    got = {r.k: r.c for r in d.groupBy("k").agg(ST.safe_corr("a", "b").alias("c")).collect()}
    assert len(got) == 12 and all(c is None or -1.0 <= c <= 1.0 for c in got.values())
    r = np.random.default_rng(1).normal(size=(50, 2))
    d = spark.createDataFrame([(float(a), float(b)) for a, b in r] + [(1.0, None)], "a double, b double")
    assert d.agg(ST.safe_corr("a", "b")).first()[0] == pytest.approx(np.corrcoef(r.T)[0, 1], rel=1e-12)


def test_differences_on_the_tolerance(spark, tmp_path):
    """98.79 and 48.79 are 50 apart, in whatever order their events are added up."""
    parts = [("view", 5.71), ("purchase", 43.08), ("signup", 19.98), ("error", 8.1), ("signup", 49.74), ("error", 20.97)]
    sf = events(spark, tmp_path, [(u, 12, *parts[(i * (u + 1) + u) % 6]) for u in (0, 4, 6, 10) for i in range(6) if math.gcd(u + 1, 6) == 1] + [(99, 3, "view", 1.0), (98, 3, "view", 1.0), (98, 3, "error", 51.01)])
    assert [(r.station_id, r.value_a, r.value_b) for r in decisions.chk05(spark, sf).orderBy("station_id").collect()] == [(98, 1.0, 51.01), (99, 1.0, None)]


def test_totals_on_a_step(spark, tmp_path):
    """runs whose totals are 40 in any order of their days share their signature."""
    orders = [(13.31, 13.32, 13.37), (13.37, 13.31, 13.32), (13.32, 13.37, 13.31)]
    many = [(u, day + 1, "view", v) for u in range(3) for day, v in enumerate(orders[u])] + [(u, day + 1, "click", v) for u in range(3, 6) for day, v in enumerate((0.1, 0.2, 39.7) if u % 2 else (39.7, 0.2, 0.1))]
    sf = events(spark, tmp_path, many)
    assert [(r.runs, r.n) for r in decisions.win12b(spark, sf).collect()] == [("0=1=2=3=4=5", 6)]


def test_folds_of_a_crowded_network_take_few_passes(spark, monkeypatch):
    """Stations of one place tie at distance zero: they must not cost a pass each."""
    ids = [3 * (k * 7919 % 400) + 1 for k in range(400)]
    at = {s: (20 + s % 5, 88 + s % 3 * 1.5) for s in ids}
    order, folds, sizes = [], {}, [0] * 4
    y, x = np.array([at[s][0] for s in sorted(ids)], float), np.array([at[s][1] for s in sorted(ids)]) * np.cos(np.radians(np.mean([at[s][0] for s in ids])))
    apart = lambda a, b: np.floor(((y - a) ** 2 + (x - b) ** 2) * 1e9 + 0.5) / 1e9
    i = int(np.argmax(apart(y.mean(), x.mean())))
    d, f = apart(y[i], x[i]), np.full((400, 4), np.inf)
    d[i] = np.inf
    for _ in ids:
        i = int(np.argmax(d))
        g = max((j for j in range(4) if sizes[j] == min(sizes)), key=lambda j: (f[i, j], -j))
        sizes[g], folds[sorted(ids)[i]], here = sizes[g] + 1, g, apart(y[i], x[i])
        order.append(i)
        d, f[:, g] = np.minimum(d, here), np.minimum(f[:, g], here)
        d[order] = -1
    passes = []
    cut = SE.cut_lineage
    monkeypatch.setattr(SE, "cut_lineage", lambda df: passes.append(1) or cut(df))
    for front in (SE.FRONT, 64):
        passes.clear()
        monkeypatch.setattr(SE, "FRONT", front)
        got = SE.spread_folds(spark.createDataFrame([(s, *map(float, at[s])) for s in ids], "station_id bigint, lat double, lon double"), 4)
        assert {r.station_id: r.fold for r in got.collect()} == folds
        assert len(passes) <= 20


def test_positions_are_drawn_with_replacement(spark):
    """Every replicate draws as many positions as there are samples, in the order of (id modulo 256, id)."""
    import hashlib
    ids = [k * 37 % 1009 for k in range(600)]
    d = spark.createDataFrame([("c", k, float(k % 7)) for k in ids] + [("e", 1, None)], "k string, id bigint, v double")
    r = B.position_bootstrap(d.repartition(5), ["k"], "v", "id", 40, 3).collect()
    v = np.array([k % 7 for k in sorted(ids, key=lambda k: (k % 256, k))], float)
    e = [np.mean([v[int(hashlib.md5(f"3:c:{rep}:{i}".encode()).hexdigest()[:12], 16) % 600] for i in range(600)]) for rep in range(40)]
    assert [x.k for x in r] == ["c"] and r[0].n == 600 and r[0]["mean"] == pytest.approx(v.mean())
    assert (r[0].ci_low, r[0].ci_high) == pytest.approx((np.quantile(e, .025), np.quantile(e, .975)), rel=1e-12)
    assert "ix.pos=r.p" in decisions.query.__globals__["ORACLES"]["boo04_sample_bootstrap"]


def test_members_are_sorted_once_for_all_their_levels(spark):
    """Ensembles of different sizes are remapped by level; the sorted members are not worked out anew for each."""
    rows = [(0, [4.0, 1.0, 3.0, 2.0]), (1, [9.0, 7.0]), (2, [5.0]), (3, None)]
    knots = [F.array(*[F.lit(v) for v in x]) for x in ([0.0, 0.5, 1.0], [0.0, 0.25, 1.0])]
    d = spark.createDataFrame(rows, "k int, members array<double>").select("k", E.recalibrate("members", *knots).alias("m"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("array_sort") <= 1

    def plain(m):
        at = [round(float(np.interp((k + .5) / len(m), [0, .5, 1], [0, .25, 1])) * len(m) - .5) for k in range(len(m))]
        return [sorted(m)[min(max(i, 0), len(m) - 1)] for i in at]
    assert {r.k: r.m for r in d.collect()} == {k: m and plain(m) for k, m in rows}


def test_baseline_pairs_places_and_not_stations(spark):
    """Gauges and withheld stations of one place meet once: with one row a chunk, six stations on two places give four meetings a day."""
    s = stations(spark, [(20, 88), (20, 88), (20, 88), (21, 89), (20.5, 88), (20.5, 88)])
    o = spark.createDataFrame([(i, 1, float(i + 1)) for i in range(4)] + [(0, 2, 8.0)], "station_id bigint, date int, precip_mm double")
    r = X.idw(o, s.where("station_id > 3"), s, "precip_mm").collect()
    c = math.cos(math.radians((3 * 20 + 21 + 2 * 20.5) / 6))
    near, far = 1 / .25, 1 / (c * c + .25)
    for k in (4, 5):
        got = {x.date: (x.idw, x.n_gauges) for x in r if x.station_id == k}
        assert got[1] == (pytest.approx((6 * near + 4 * far) / (3 * near + far)), 4) and got[2] == (pytest.approx(8.0), 1)
    plan = X.idw(o, s.where("station_id > 3"), s, "precip_mm")._jdf.queryExecution().optimizedPlan().toString()
    assert "_m#" in plan


@pytest.mark.parametrize("block", [256, 2])
def test_variogram_of_stations_that_share_places(spark, block):
    rng = np.random.default_rng(8)
    at = [(22 + k % 4 * .3, 89 + k % 3 * .4) for k in range(40)]
    v = {(k, d): float(rng.gamma(1, 9)) for k in range(40) for d in (1, 2, 3) if rng.random() < .8}
    o = spark.createDataFrame([(k, f"2024-01-0{d}", x) for (k, d), x in v.items()] + [(0, "2024-01-09", None)], "station_id bigint, t string, precip_mm double").select("station_id", F.to_date("t").alias("date"), "precip_mm")
    edges, ss, n = [0.0, 20.0, 60.0, 100.0], np.zeros(3), np.zeros(3, int)
    for i in range(40):
        for j in range(i):
            (la, lo), (lb, lp) = (map(math.radians, at[k]) for k in (i, j))
            km = 2 * 6371.0 * math.asin(math.sqrt(math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - lp) / 2) ** 2))
            for d in (1, 2, 3):
                if km < 100 and (i, d) in v and (j, d) in v:
                    b = int(np.searchsorted(edges, km, side="right")) - 1
                    ss[b], n[b] = ss[b] + (v[i, d] - v[j, d]) ** 2, n[b] + 1
    run = ST._block_sums(edges)
    got = {r.bin: r for r in ST.empirical_variogram(o, stations(spark, at), edges, block=block).collect()}
    assert {b: r.n_pairs for b, r in got.items()} == {b: int(x) for b, x in enumerate(n)}
    assert all(got[b].gamma == pytest.approx(ss[b] / n[b] / 2, rel=1e-9) for b in range(3))
    one = {c: [np.full(31, x)] for c, x in (("ns", 5.0), ("ys", 0.0), ("qs", 2.0))}
    import pandas as pd
    own = run(pd.DataFrame({"p": ["a"], "q": ["a"], "block": ["a"], "lat": [22.0], "lon": [89.0], **one}))
    assert own["n"].tolist() == [310, 0, 0]


def test_equal_values_have_no_correlation(spark):
    """merging the partial means of equal values rounds, which must not pass for a spread."""
    rows = [(k, 0.1 + k / 7, p, float(i)) for k in range(60) for p, n in enumerate((1, 3, 6, 7)) for i in range(n)]
    d = spark.createDataFrame(rows, "k int, a double, p int, b double").repartitionByRange(4, "p")
    assert [r.k for r in d.groupBy("k").agg(ST.safe_corr("a", "b").alias("c"), ST.safe_corr("b", "a").alias("e")).collect() if r.c is not None or r.e is not None] == []


def test_days_of_equal_events_have_no_correlation(spark, tmp_path):
    """days that hold the same events in another order are equal, so their station has no correlation to pool."""
    parts, kinds = [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (0.2, 0.3, 0.1)], ("view", "signup", "error")
    rows = [(u, f"2024-01-{day + 1:02d} 06:00:00", t, v) for u in range(3) for day, p in enumerate(parts) for t in kinds for v in p]
    rows += [(9, f"2024-01-{day + 1:02d} 06:00:00", t, v) for t in kinds for day, v in enumerate((1e300, 2.0, math.inf))]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id bigint, user_id bigint, t string, event_type string, value double")
    d.coalesce(1).withColumn("ts", F.to_timestamp_ntz("t")).drop("t").write.parquet(f"{tmp_path}/events.parquet")
    m = V.multipair(spark, str(tmp_path), steady=True).collect()
    assert {(r.pred, r.obs) for r in m if r.station_id < 9} == {(0.6, 0.6)} and len(m) == 24
    assert sorted({(r.pred, r.obs) for r in m if r.station_id == 9}) == [(2.0, 2.0), (1e300, 1e300), (math.inf, math.inf)]
    spark.read.parquet(f"{tmp_path}/events.parquet").where("user_id < 9").write.parquet(f"{tmp_path}/own/events.parquet")
    got = verify.ver35(spark, f"{tmp_path}/own").collect()
    assert sorted((r["product"], r.n, r.stations, r.station_corr) for r in got) == [("error", 9, 3, None), ("signup", 9, 3, None)]
