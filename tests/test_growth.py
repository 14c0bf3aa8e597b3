"""Steps whose cost must follow the table, each with its rows checked against a plain version."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rainloom.functions.lattice import Lattice
from rainloom.operators import joins as J, temporal as T, update as U
from rainloom.sources import granules as GN


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


@pytest.mark.parametrize("kind", ["half-hour", "daily"])
def test_file_names_are_parsed_once(spark, kind):
    """names are parsed after the distinct that makes them few, not on every event."""
    names = ["sat.20240102-S030000-E032959.a", "sat.20240102-S030000-E032959.b", "sat.20240102-S033000-E035900.a", "sat.20240103-S023000-E025959.a", "junk"]
    f = spark.createDataFrame([(n,) for n in names * 3], "file string").distinct()
    first, last = F.lit("2024-01-03").cast("date"), F.lit("2024-01-04").cast("date")
    d = GN.half_hour_inventory(f, first, last) if kind == "half-hour" else GN.daily_inventory(f.withColumn("file", F.regexp_replace("file", r"S\d{6}-E\d{6}", "S000000-E235959")), first, last)
    lines = plan(d)
    at = next(i for i, x in enumerate(lines) if "Aggregate [file" in x)
    assert any("regexp_extract" in x for x in lines[:at]) and not any("regexp_extract" in x for x in lines[at:])
    if kind == "half-hour":
        assert {str(r.slot): r.files for r in d.where("files > 0").collect()} == {"2024-01-02 03:00:00": 2, "2024-01-03 02:30:00": 1}
        assert {str(r.date): (r.missing, r.duplicated) for r in GN.window_status(d).collect()} == {"2024-01-03": (46, 1), "2024-01-04": (48, 0)}
    else:
        assert {str(r.day): (r.files, r.status) for r in d.collect()} == {"2024-01-03": (1, "ok"), "2024-01-04": (0, "missing")}


LAT = Lattice(86.0, 20.0, 5, 4, 0.5)


def holed_field(spark):
    """Two days on the lattice, with absent cells and missing values; returns the frame and the values of (day, iy, ix)."""
    r = np.random.default_rng(4)
    v = {(d, y, x): None if r.random() < 0.2 else float(r.gamma(1.0, 9.0)) for d in (1, 2) for y in range(4) for x in range(5) if r.random() > 0.2}
    return spark.createDataFrame([(*k, x) for k, x in v.items()], "day int, iy int, ix int, value double"), v


def scattered(spark):
    r = np.random.default_rng(5)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(19.6, 22.4, 60), r.uniform(85.6, 88.9, 60)))]
    pts += [(60, 20.25, 86.25), (61, 21.75, 88.25), (62, 21.75, 86.9), (63, 20.25, 86.25), (64, None, 86.5)]
    return spark.createDataFrame(pts, "station_id bigint, lat double, lon double"), [p for p in pts if p[1] is not None]


def around(lat, lon, clamp):
    y, x = (lat - 20.25) / 0.5, (lon - 86.25) / 0.5
    if clamp:
        y, x = min(max(y, 0.0), 3.0), min(max(x, 0.0), 4.0)
    fy, fx = math.floor(y), math.floor(x)
    return [(fy + dy, fx + dx, ((y - fy) if dy else 1 - y + fy) * ((x - fx) if dx else 1 - x + fx)) for dy in (0, 1) for dx in (0, 1)]


@pytest.mark.parametrize("missing", ["zero", "renormalise", "strict"])
def test_points_look_up_their_four_cells(spark, missing):
    """the rows that are grouped are those of the field, not one for each point, day and cell."""
    f, v = holed_field(spark)
    p, pts = scattered(spark)
    d = J.bilinear_sample(f, p, LAT, missing=missing)
    assert not any("Aggregate [station_id" in x for x in plan(d))
    want = {}
    for i, lat, lon in pts:
        for day in (1, 2):
            cells = [(v[day, y, x], w) for y, x, w in around(lat, lon, missing == "renormalise") if (day, y, x) in v]
            known = [(a, w) for a, w in cells if a is not None]
            s, w = sum(a * b for a, b in known), sum(b for _, b in known)
            if cells:
                value = s if missing == "zero" else (s / w if w else None) if missing == "renormalise" else (s if known and w >= 1 - 1e-9 else None)
                want[i, day] = (value, w)
    got = {(r.station_id, r.day): (r.value, r.coverage) for r in d.collect()}
    assert got.keys() == want.keys() and len(got) > 60
    for k, (a, w) in want.items():
        assert got[k][0] == (None if a is None else pytest.approx(a, abs=1e-9)) and got[k][1] == pytest.approx(w, abs=1e-12)


@pytest.mark.parametrize("clamp", [False, True])
def test_members_look_up_their_four_cells(spark, clamp):
    f, v = holed_field(spark)
    p, pts = scattered(spark)
    d = J.bilinear_members(f.withColumn("members", F.array("value", F.lit(2.0), F.col("value") * 3)), p, LAT, clamp=clamp)
    assert not any("Aggregate [station_id" in x for x in plan(d))
    want = {}
    for i, lat, lon in pts:
        for day in (1, 2):
            cells = [(v[day, y, x], w) for y, x, w in around(lat, lon, clamp) if (day, y, x) in v and (w > 0 or not clamp)]
            if cells:
                known = [a * w for a, w in cells if a is not None]
                want[i, day] = [sum(known) if known else None, 2.0 * sum(w for _, w in cells), 3.0 * sum(known) if known else None]
    got = {(r.station_id, r.day): r.members for r in d.collect()}
    assert got.keys() == want.keys() and len(got) > 60
    for k, m in want.items():
        assert got[k] == [None if x is None else pytest.approx(x, abs=1e-9) for x in m]


def test_points_of_a_place_travel_in_lists(spark):
    """what meets is a list of the points of a place, not each of its points."""
    r = np.random.default_rng(6)
    ids = r.permutation(900)
    pts = [(int(ids[i]), *([(22.0, 89.0), (22.5, 89.5), (23.9, 91.0), (22.0, 89.1)][min(i // 20, 3)] if i < 400 else (float(r.uniform(20, 26)), float(r.uniform(88, 92))))) for i in range(500)]
    d = J.pairs_within(spark.createDataFrame(pts, "station_id bigint, lat double, lon double"), 60.0, block=16)
    lines = plan(d)
    first = next(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert any("Join" in x for x in lines[first:]) and not any("Join" in x for x in lines[:first])
    a = np.array(pts)
    rows = np.array(d.collect())
    rad = np.radians(a[:, 1:])
    h = np.sin((rad[:, None, 0] - rad[None, :, 0]) / 2) ** 2 + np.cos(rad[:, None, 0]) * np.cos(rad[None, :, 0]) * np.sin((rad[:, None, 1] - rad[None, :, 1]) / 2) ** 2
    km = 2 * 6371.0 * np.arcsin(np.sqrt(h))
    i, j = np.nonzero((km <= 60.0) & (a[:, None, 0] < a[None, :, 0]))
    want = {(int(a[x, 0]), int(a[y, 0])): km[x, y] for x, y in zip(i, j)}
    got = {(int(x), int(y)): z for x, y, z in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and len(got) > 50000
    assert max(abs(got[k] - want[k]) for k in want) < 0.1


def test_runs_are_not_grouped(spark):
    """F16: the length of a run is read off the row numbers; only stations are grouped."""
    r = np.random.default_rng(7)
    rows = [(s, int(day), None if r.random() < 0.1 else float(r.integers(0, 3))) for s in range(30) for day in r.permutation(200)[:120]]
    d = T.stuck_runs(spark.createDataFrame(rows, "station_id int, date int, precip_mm double"), max_mm=1.0, flag_at=4)
    assert sum("Aggregate [" in x for x in plan(d)) == 1
    want = {}
    for s in range(30):
        v = [x for _, x in sorted((day, x) for k, day, x in rows if k == s)]
        longest = run = 1
        for a, b in zip(v, v[1:]):
            run = run + 1 if b is not None and a == b and b > 0 else 1
            longest = max(longest, run)
        over = sum(x is not None and x > 1.0 for x in v)
        want[s] = (longest, over, over > 0 or longest >= 4)
    assert {x.station_id: (x.longest_run, x.n_over_max, x.suspicious) for x in d.collect()} == want


def one_by_one(field, gauges, obs, var, support):
    """Every gauge of one day in turn, cell by cell. field: members of (iy, ix); gauges: (id, lat, lon) in order."""
    for i, la, lo in gauges:
        if obs.get(i) is None:
            continue
        read = [(field[y, x], w) for y, x, w in around(la, lo, True) if (y, x) in field and w > 0]
        if not read:
            continue
        mm = [sum(max(math.expm1(m[k]) * 0.1, 0.0) * w for m, w in read) for k in range(len(read[0][0]))]
        h = [math.log1p(a / 0.1) for a in mm]
        n, hm = len(h), sum(h) / len(h)
        den = sum((a - hm) ** 2 for a in h) / (n - 1) + var
        for (y, x), m in list(field.items()):
            km = 111.0 * math.hypot(20.25 + y * 0.5 - la, math.cos(math.radians(la)) * (86.25 + x * 0.5 - lo))
            w = float(U._taper(np.array([km]), support)[0])
            gain = w * sum((a - sum(m) / n) * (b - hm) for a, b in zip(m, h)) / (n - 1) / den
            if w > 0:
                field[y, x] = [a + gain * (math.log1p(obs[i] / 0.1) - hm) - gain / (1 + math.sqrt(var / den)) * (b - hm) for a, b in zip(m, h)]
    return field


def test_days_are_updated_side_by_side(spark, monkeypatch):
    """what hangs on a place is worked out once for its gauges and days; days may lack cells and observations and differ in members."""
    r = np.random.default_rng(8)
    sizes = {0: 4, 1: 4, 2: 3, 3: 4, 4: 4, 5: 4}
    field = {d: {(y, x): np.log1p(r.gamma(1.0, 9.0, n) / 0.1).tolist() for y in range(4) for x in range(5) if r.random() > 0.15} for d, n in sizes.items()}
    where = [(20.4, 86.6), (21.1, 87.3), (21.9, 88.4), (20.9, 87.0)]
    gauges = [(int(i), *where[i % 4]) for i in r.permutation(24)]
    obs = {d: {i: None if r.random() < 0.2 else float(r.gamma(1.0, 9.0)) for i in range(24) if r.random() > 0.2} for d in sizes if d != 4}
    cells = [(d, y, x, m) for d, f in field.items() for (y, x), m in f.items()]
    f = spark.createDataFrame(cells, "day int, iy int, ix int, members array<double>")
    g = spark.createDataFrame(gauges, "station_id int, lat double, lon double")
    o = spark.createDataFrame([(i, d, v) for d, s in obs.items() for i, v in s.items()], "station_id int, day int, obs_mm double")
    got = {(x.day, x.iy, x.ix): x.members for x in U.update_serial(f, g, o, [i for i, _, _ in gauges], LAT, 0.3, 120.0).collect()}
    assert len(got) == len(cells)
    for d in sizes:
        for k, m in one_by_one(dict(field[d]), gauges, obs.get(d, {}), 0.3, 120.0).items():
            assert got[d, *k] == pytest.approx(m, abs=1e-9)
    calls, taper = [], U._taper
    monkeypatch.setattr(U, "_taper", lambda km, support: calls.append(1) or taper(km, support))
    seen = pd.DataFrame([(d, i, k, la, lo, 1.0) for d in sizes for k, (i, la, lo) in enumerate(gauges)], columns=["day", "_id", "_o", "_la", "_lo", "_y"])
    U._updated(pd.DataFrame(cells, columns=["day", "iy", "ix", "members"]), seen, ["day"], LAT, 0.3, 120.0, "log1p", 0.1)
    assert len(calls) == 2 * len(where)
