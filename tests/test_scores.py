import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions import draws as D, ensemble as EN, order as O, scalar as S
from rainloom.operators import bias as B, ensembles as E, stats as ST, verify as X
from tests.test_grid import rows


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.zeros(700), rng.gamma(0.5, 20, 1200), -rng.random(90), [1e-9, 1e12]])
    d = spark.createDataFrame([(float(x),) for x in v], "v double")
    probs = [0, .01, .1, .33, .5, .9, .99, .999, 1]
    got = {r.prob: r.value for r in O.quantiles(d, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)


def test_keyed_quantiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(x), int(i % 7), i) for k in (1, 2) for i, x in enumerate(np.round(rng.gamma(1, 3, 200), 1) * (rng.random(200) > .4))]
    d = spark.createDataFrame(data, "k int, v double, day int, id int")
    q = {(r.k, r.prob): r.value for r in O.quantiles(d, "v", [.25, .5], ["k"]).collect()}
    for k in (1, 2):
        v = [r[1] for r in data if r[0] == k]
        assert q[(k, .5)] == pytest.approx(np.quantile(v, .5))
    r = O.ordinal_rank(d, "v", "day", "id", "rk", ["k"]).collect()
    for k in (1, 2):
        mine = sorted([x for x in r if x.k == k], key=lambda x: x.rk)
        assert [x.rk for x in mine] == list(range(1, 201))
        assert [(x.v, x.day, x.id) for x in mine] == sorted((x.v, x.day, x.id) for x in mine)


def test_fair_crps(spark):
    rng = np.random.default_rng(2)
    m, y = rng.gamma(1, 3, (30, 5)), rng.gamma(1, 3, 30)
    d = spark.createDataFrame([([float(a) for a in r], float(b)) for r, b in zip(m, y)], "members array<double>, truth double")
    fair = [r[0] for r in d.select(EN.fair_crps("members", "truth")).collect()]
    pair = np.abs(m[:, :, None] - m[:, None, :]).sum((1, 2))
    want = np.abs(m - y[:, None]).mean(1) - pair / (2 * 5 * 4)
    assert np.allclose(fair, want)
    s = E.crps_scores(d).first()
    assert s.fair_crps == pytest.approx(want.mean()) and s.fair_crps < s.plain_crps
    one = spark.createDataFrame([([3.0], 5.0)], "members array<double>, truth double")
    assert one.select(EN.fair_crps("members", "truth")).first()[0] == 2.0


def test_unusable_samples_are_left_out(spark):
    d = spark.createDataFrame([([1.0, 2.0], 1.0), ([1.0, None], 1.0), ([1.0, float("nan")], 1.0), ([1.0, 2.0], None)], "members array<double>, truth double")
    assert E.point_metrics(d).first().n == 1


def test_rank_histogram_and_flatness(spark):
    d = spark.createDataFrame([(i, [1.0, 2.0, 3.0], x) for i, x in enumerate([0.0, 1.5, 2.5, 9.0])], "sample_id int, members array<double>, truth double")
    h = {r["rank"]: r["n"] for r in E.rank_histogram(d, 3).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 1}
    assert E.flatness(E.rank_histogram(d, 3)).first().deviation == 0.0


def test_fss_is_one_against_itself(spark):
    rng = np.random.default_rng(3)
    f = rows(spark, rng.gamma(1, 8, (9, 9))).select("day", "iy", "ix", F.col("value").alias("pred"), F.col("value").alias("obs"))
    for kw in ({}, {"cells": "paired"}, {"edge": "replicate", "cells": "land"}):
        t = X.fss_table(X.fss_days(f, [5.0], [1, 3, 5], 9, 9, **kw)).collect()
        assert len(t) == 3 and all(abs(r.fss - 1) < 1e-12 for r in t)
    assert X.skillful_scale(X.fss_table(X.fss_days(f, [5.0], [1, 3], 9, 9, cells="paired"))).first().skillful_window == 1


def test_power_spectrum_matches_a_whole_field_transform(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(12, 10))
    got = {r.bin: r.power for r in X.power_spectrum(rows(spark, a), 12, 10).collect()}
    w = (a - a.mean()) * np.hanning(12)[:, None] * np.hanning(10)[None]
    p = np.abs(np.fft.fft2(w)) ** 2
    r = np.sqrt(np.fft.fftfreq(12)[:, None] ** 2 + np.fft.fftfreq(10)[None] ** 2)
    edges = np.linspace(1 / 12, .5, 6)
    idx = np.digitize(r.ravel(), edges) - 1
    for b in got:
        assert got[b] == pytest.approx(p.ravel()[idx == b].mean())


def test_effective_resolution_walk(spark):
    d = spark.createDataFrame([("a", 100.0, 1.0), ("a", 50.0, 1.5), ("a", 25.0, 3.0), ("a", 12.0, 1.0), ("b", 100.0, 1.0), ("b", 50.0, 0.9)], "name string, wavelength_km double, power_ratio double")
    got = {r.name: r.effective_resolution_km for r in X.effective_resolution(d).collect()}
    assert got == {"a": 50.0, "b": 50.0}


def test_sal_of_identical_and_shifted_fields(spark):
    a = np.zeros((12, 12))
    a[2:5, 2:5] = 10
    a[8:10, 7:11] = 4
    f = rows(spark, a).select("day", "iy", "ix", F.col("value").alias("pred"), F.col("value").alias("obs"))
    r = X.sal(f, 12, 12).first()
    assert abs(r.structure) < 1e-12 and abs(r.amplitude) < 1e-12 and abs(r.location) < 1e-12
    double = f.withColumn("pred", F.col("obs") * 2)
    assert X.sal(double, 12, 12).first().amplitude == pytest.approx(2 / 3)


def test_objects_are_the_connected_components(spark):
    rng = np.random.default_rng(5)
    a = (rng.random((15, 15)) > 0.6).astype(float)
    got = X.objects(rows(spark, a).withColumn("hit", F.col("value") > 0), "hit").collect()
    seen, comp = {}, 0
    for s in zip(*np.nonzero(a)):
        if s in seen:
            continue
        comp += 1
        stack = [s]
        seen[s] = comp
        while stack:
            y, x = stack.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (y + dy, x + dx)
                    if 0 <= q[0] < 15 and 0 <= q[1] < 15 and a[q] and q not in seen:
                        seen[q] = comp
                        stack.append(q)
    pairs = {(r.label, seen[(r.iy, r.ix)]) for r in got}
    assert len(got) == int(a.sum()) and len(pairs) == comp == len({p[0] for p in pairs})


def planted(spark):
    h = np.array([20.0, 50.0, 90.0, 150.0, 240.0])
    g = 2.0 + 5.0 * (1 - np.exp(-h / 80.0))
    return spark.createDataFrame([(i, float(a), float(b), 100) for i, (a, b) in enumerate(zip(h, g))], "bin int, distance_km double, gamma double, n_pairs bigint")


def test_variogram_fit_recovers_planted_parameters(spark):
    f = ST.block_dispersion(ST.fit_variogram(planted(spark)), 5.0).first()
    assert f.nugget == pytest.approx(2, abs=.05) and f.sill == pytest.approx(5, abs=.1) and f.range_km == pytest.approx(80, rel=.03)
    o = (np.arange(12) + .5) / 12 * 5
    p = np.stack(np.meshgrid(o, o, indexing="ij"), -1).reshape(-1, 2)
    d = np.linalg.norm(p[:, None] - p[None], axis=-1)[np.triu_indices(144, 1)]
    assert f.block_variance == pytest.approx((f.nugget + f.sill * (1 - np.exp(-d / f.range_km))).mean())
    assert ST.fit_variogram(planted(spark).where("bin < 2")).count() == 0


def test_decomposition_flags(spark):
    good = spark.createDataFrame([(n, 3.0 + 10.0 / n) for n in (1, 5, 10, 30)], "window int, mse double")
    r = ST.aggregation_decomposition(good).first()
    assert r.systematic_mse == pytest.approx(3) and r.random_mse == pytest.approx(10) and r.model_is_valid and r.r_squared == pytest.approx(1)
    bad = spark.createDataFrame([(n, 3.0 - 1.0 / n) for n in (1, 5, 10)], "window int, mse double")
    r = ST.aggregation_decomposition(bad).first()
    assert r.error_grows and not r.model_is_valid


def test_distance_to_false(spark):
    a = np.ones((30, 30), bool)
    a[3, 4] = a[25, 28] = False
    d = spark.createDataFrame([(i, j, bool(a[i, j])) for i in range(30) for j in range(30)], "iy int, ix int, ok boolean")
    false = [(3, 4), (25, 28)]
    for r in ST.distance_to_false(d, "ok").collect():
        assert r.distance == pytest.approx(min(np.hypot(r.iy - y, r.ix - x) for y, x in false))


def test_transform_round_trip_and_missing(spark):
    d = spark.createDataFrame([(0.0,), (12.5,), (None,), (-1.0,)], "p double")
    for k in ("log1p", "sqrt", "cbrt", "none"):
        got = [r[0] for r in d.select(S.rain_inverse(S.rain_forward("p", k, 0.1, 1.0, 2.0), k, 0.1, 1.0, 2.0)).collect()]
        assert got[1] == pytest.approx(12.5) and got[2] is None and got[0] == pytest.approx(0, abs=1e-12) and got[3] == pytest.approx(0, abs=1e-12)
    with pytest.raises(ValueError):
        S.stretch(F.col("p"), "sine")


def test_taper_is_compact(spark):
    d = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (150.0,), (None,)], "d double")
    w = [r[0] for r in d.select(S.gaspari_cohn("d", 100.0)).collect()]
    assert w[0] == 1.0 and 0 < w[1] < 1 and w[2] == 0.0 and w[3] == 0.0 and w[4] is None


def test_draws_repeat_and_look_normal(spark):
    d = spark.range(4000)
    a = [r[0] for r in d.select(D.draw_normal(1, "id")).collect()]
    assert a == [r[0] for r in d.repartition(7).orderBy("id").select(D.draw_normal(1, "id")).collect()]
    assert abs(np.mean(a)) < .06 and abs(np.std(a) - 1) < .05


# ---- quantile mapping -----------------------------------------------------

def qsamples(spark, factor=1.0, years=(2019, 2020, 2021)):
    rng = np.random.default_rng(6)
    data = []
    for y in years:
        t = rng.gamma(.6, 12, 120) * (rng.random(120) > .4)
        data += [(y, "JJAS", 0, 0, float(v * factor), float(v)) for v in t]
    return spark.createDataFrame(data, "year int, stratum string, iy int, ix int, source double, target double")


def test_identity_map_when_source_equals_target(spark):
    d = qsamples(spark)
    m = B.fit_quantile_map(d, "source", "target", min_samples=50)
    out = B.apply_quantile_map(d, m, "source")
    # Values below the wet threshold are dried; all others come back close to themselves.
    gap = out.where("source >= 1").agg(F.max(F.abs(F.col("corrected") - F.col("source")) / F.col("source"))).first()[0]
    assert gap < 0.35


def test_wet_bias_is_removed(spark):
    d = qsamples(spark, 1.6)
    out = B.apply_quantile_map(d, B.fit_quantile_map(d, "source", "target", min_samples=50), "source")
    r = B.correction_report(out, "source", "corrected", "target").first()
    assert abs(r.corrected_bias) < abs(r.raw_bias) * .25


def test_ratio_tail_and_missing(spark):
    d = spark.createDataFrame([(300.0,), (None,), (0.5,), (15.0,)], "v double")
    x, y = F.array(F.lit(1.0), F.lit(100.0)), F.array(F.lit(2.0), F.lit(150.0))
    got = [r[0] for r in d.select(B.map_value(F.col("v"), F.lit(1.0), x, y)).collect()]
    assert got[0] == 450.0 and got[1] is None and got[2] == 0.0 and 2 < got[3] < 150


def test_thin_samples_give_identity(spark):
    m = B.fit_quantile_map(qsamples(spark), "source", "target", min_samples=10_000).first()
    assert m.source_knots == [0.0, 1.0] and m.cut == 0.0


def test_map_of_the_same_year_is_refused(spark):
    d = qsamples(spark)
    m = B.fit_quantile_map(d, "source", "target", min_samples=50).where("holdout <> 2020")
    with pytest.raises(Exception, match="no map fitted"):
        B.apply_quantile_map(d, m, "source").agg(F.sum("corrected")).collect()
