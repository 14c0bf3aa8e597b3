import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions.lattice import Lattice
from rainloom.operators import checks as C, grid as GR, joins as J


def rows(spark, a, day="2020-01-01"):
    data = [(day, i, j, None if np.isnan(a[i, j]) else float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(data, "day string, iy int, ix int, value double").withColumn("day", F.col("day").cast("date"))


def test_conservative_regrid_keeps_a_uniform_field(spark):
    src = Lattice(0.0, 20.0, 2, 2, 2.0)
    tgt = Lattice(0.0, 20.0, 4, 4, 1.0)
    ay = spark.createDataFrame([(i, 20.0 + (i + .5) * 2) for i in range(2)], "iy int, lat double")
    ax = spark.createDataFrame([(i, (i + .5) * 2) for i in range(2)], "ix int, lon double")
    ty = spark.createDataFrame([(i, 20.0 + i + .5) for i in range(4)], "ty int, lat double")
    tx = spark.createDataFrame([(i, i + .5) for i in range(4)], "tx int, lon double")
    wy = GR.require_covered(GR.overlap_weights(ay, ty, "iy", "ty", "lat", latitude=True))
    wx = GR.require_covered(GR.overlap_weights(ax, tx, "ix", "tx", "lon"))
    out = GR.conservative_regrid(rows(spark, np.full((2, 2), 7.5)), wy, wx).collect()
    assert len(out) == 16 and all(abs(r.value - 7.5) < 1e-12 for r in out)
    far = spark.createDataFrame([(0, 30.0), (1, 31.0)], "ty int, lat double")
    part = spark.createDataFrame([(0, 23.5), (1, 24.5)], "ty int, lat double")
    with pytest.raises(Exception, match="does not cover"):
        GR.require_covered(GR.overlap_weights(ay, part, "iy", "ty", "lat", latitude=True)).collect()
    assert GR.overlap_weights(ay, far, "iy", "ty", "lat", latitude=True).where("coverage > 0").count() == 0


def test_coverage_interpolation(spark):
    lat = Lattice(0.0, 0.0, 2, 2, 1.0)
    a = np.array([[4.0, 4.0], [4.0, np.nan]])
    b = np.full((2, 2), np.nan)
    f = rows(spark, a).unionByName(rows(spark, b, "2020-01-02"))
    p = spark.createDataFrame([(1, 1.0, 1.0)], "station_id bigint, lat double, lon double")
    got = {str(r.day): (r.value, r.coverage) for r in GR.coverage_interpolate(f, p, lat).collect()}
    assert got == {"2020-01-01": (4.0, 0.75), "2020-01-02": (0.0, 0.0)}


def test_bilinear_variants(spark):
    lat = Lattice(0.0, 0.0, 2, 2, 1.0)
    f = rows(spark, np.array([[2.0, 2.0], [2.0, np.nan]]))
    p = spark.createDataFrame([(1, 1.0, 1.0)], "station_id bigint, lat double, lon double")
    get = lambda m: J.bilinear_sample(f, p, lat, missing=m).first().value
    assert get("zero") == 1.5 and get("renormalise") == 2.0 and get("strict") is None


def test_residual_has_zero_block_mean(spark):
    rng = np.random.default_rng(0)
    d = GR.scale_decompose(rows(spark, rng.gamma(1, 5, (6, 6))), 3)
    m = d.groupBy("by", "bx").agg(F.avg("residual").alias("m")).collect()
    assert max(abs(r.m) for r in m) < 1e-12
    assert d.where(F.abs(F.col("coarse") + F.col("residual") - F.col("value")) > 1e-12).count() == 0


def test_smooth_upsample_conserves_and_is_continuous(spark):
    rng = np.random.default_rng(1)
    a = rng.gamma(1, 8, (8, 8))
    f = rows(spark, a)
    area = F.lit(1.0)
    coarse = GR.area_block_mean(f, 4, area, 0.0).select("day", "by", "bx", "value")
    up = GR.smooth_upsample(coarse, f, 4, area, 2, 2)
    assert C.conservation(up, coarse, ["day", "by", "bx"], area).first().max_error < 1e-9
    flat = GR.smooth_upsample(coarse, f, 4, area, 2, 2, iterations=0)
    assert flat.groupBy("by", "bx").agg(F.countDistinct("value").alias("n")).where("n > 1").count() == 0


def test_smooth_upsample_dry_block_falls_back(spark):
    a = np.zeros((4, 4))
    f = rows(spark, a)
    coarse = GR.area_block_mean(f, 2, F.lit(1.0), 0.0).select("day", "by", "bx", "value")
    assert GR.smooth_upsample(coarse, f, 2, F.lit(1.0), 2, 2).where("value <> 0 or value is null").count() == 0


def test_geometric_factor_matches_all_pairs():
    n, res, corr = 4, 0.1, 40.0
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    y, x = i.ravel() * res * 111.32, j.ravel() * res * 111.32 * np.cos(np.radians(24))
    d = np.hypot(y[:, None] - y[None], x[:, None] - x[None])
    assert abs(GR.geometric_factor(n, res, 24.0, corr) - np.exp(-d / corr).mean()) < 1e-12


def test_lattice_rules():
    g = Lattice(86.0, 20.0, 16, 16, 0.5)
    assert g.coarser(4) == Lattice(86.0, 20.0, 4, 4, 2.0)
    assert Lattice(88.0, 21.0, 8, 10, 0.5).offsets_in(g) == (2, 4)
    with pytest.raises(ValueError):
        g.coarser(3)
    with pytest.raises(ValueError):
        Lattice(80.0, 21.0, 8, 10, 0.5).offsets_in(g)
    with pytest.raises(ValueError):
        GR.replicate_driver(None, Lattice(0, 0, 2, 2, 0.1), None, 0.2)


def test_box_sums_against_brute_force(spark):
    rng = np.random.default_rng(2)
    a = (rng.random((7, 9)) > 0.5).astype(float)
    f = rows(spark, a).withColumn("hit", F.col("value").cast("int"))
    got = GR.box_sums(f, {"n": "hit"}, {"_3": (1, 1), "_4": (2, 1)}).collect()
    for r in got:
        assert r.n_3 == a[max(0, r.iy - 1):r.iy + 2, max(0, r.ix - 1):r.ix + 2].sum()
        assert r.n_4 == a[max(0, r.iy - 2):r.iy + 2, max(0, r.ix - 2):r.ix + 2].sum()
