"""Queries over all of their rows, against their SQL check."""

import datetime as dt
import os

import numpy as np
import pytest

import __spark_entry__ as entry
from rainloom.functions.lattice import Lattice
from rainloom.operators import resample as B, verify as X
from tests.test_oracles import SF, TABLES, norm

duckdb = pytest.importorskip("duckdb")
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")


def whole(spark, name):
    """The query's rows, after they were found equal to the SQL."""
    sql = entry.oracle_sql()[name]
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    rows, cur = df.collect(), db.execute(sql)
    want = norm([d[0] for d in cur.description], cur.fetchall())
    assert want and norm(df.columns, [tuple(r) for r in rows]) == want
    return rows


@here
def test_single_day_comparison_masks_around_every_gauge(spark):
    whole(spark, "ver40_single_day_comparison")


def test_bullseye_of_few_gauges(spark):
    g = Lattice(86.0, 20.0, 16, 16, 0.5)
    rng = np.random.default_rng(7)
    t, b, a = rng.normal(size=(3, 16, 16))
    d = spark.createDataFrame([(1, i, j, float(t[i, j]), float(b[i, j]), float(a[i, j])) for i in range(16) for j in range(16)], "day int, iy int, ix int, value double, ref double, an double")

    def ratio(cells):
        s = spark.createDataFrame([(k, 20.25 + i / 2, 86.25 + j / 2) for k, (i, j) in enumerate(cells)], "station_id int, lat double, lon double")
        return X.single_day_comparison(d, s, g, 4).first().bullseye

    inc, gauges = np.abs(a - b), [(2, 3), (3, 0)]
    reach = np.array([[min(max(abs(i - y), abs(j - x)) for y, x in gauges) for j in range(16)] for i in range(16)])
    assert ratio(gauges) == pytest.approx(inc[reach <= 1].mean() / inc[reach > 5].mean(), rel=1e-12)
    assert ratio([(i, j) for i in (4, 12) for j in (4, 12)]) is None


@here
def test_segmented_bootstrap_takes_every_day(spark):
    whole(spark, "boo03_segmented_bootstrap")


@pytest.fixture
def gaps(spark):
    """Four runs of days; all days of a run have one value."""
    days = [d for d in range(1, 31) if d not in (9, 10, 21, 26)]
    return spark.createDataFrame([("s", dt.date(2024, 1, d), float(sum(d > g for g in (9, 21, 26))), 1) for d in days], "k string, date date, num double, den int")


def test_segmented_blocks_stay_between_gaps(gaps):
    one = B.block_bootstrap(gaps, ["k"], 4, 100, 3, segmented=True).first()
    assert (one.n_days, one.n_segments) == (26, 4) and one.ci_low == one.ci_high == one["mean"]
    assert B.block_bootstrap(gaps, ["k"], 4, 100, 3).first().ci_high > one["mean"]


@here
def test_overlap_weights_reach_the_border_targets(spark):
    rows = whole(spark, "grd01_overlap_weights")
    last = {a: max(r.target for r in rows if r.axis == a) for a in ("lat", "lon")}
    assert last["lat"] == 7 and {(r.axis, r.target) for r in rows if r.coverage < 1} == set(last.items())
    whole(spark, "grd02_conservative_regrid")
