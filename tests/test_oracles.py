"""A spread of registered queries against their SQL on the smallest tables; tools/check_queries.py runs all."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["flagship_error_averaging", "scl05_token_cleaning", "tmp01_reporting_day", "tmp04_calendar_blocks", "agg11_physical_summary", "agg20_quantile_map_apply", "grd02_conservative_regrid",
          "grd17_smooth_upsample", "joi03_bilinear_renormalised", "joi10_polygon_mask", "ver09_fss_table", "ver13_point_metrics", "ver32_power_spectrum", "win07_spread_holdout", "boo03_segmented_bootstrap",
          "boo07_placement_permutation", "ens01_single_gauge_update", "src02_legacy_matrix", "str01_reporting_windows", "chk04_fold_cover"]


def norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(round(r[i], 6) + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = db.execute(entry.oracle_sql()[name])
    want = norm([d[0] for d in cur.description], cur.fetchall())
    assert want and norm(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
