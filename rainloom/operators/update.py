"""Localized ensemble update by one gauge, and its fold over gauges in order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.functions import ensemble as EN, scalar as S
from rainloom.functions.lattice import Lattice
from rainloom.operators import joins as J
from rainloom.operators.checks import guard

LEAST_MEMBERS, TOO_FEW = 3, "an update needs at least three members"


def predicted_members(field: DataFrame, gauge: DataFrame, lattice: Lattice, kind="log1p", eps=0.1, keys=("day",), key="station_id") -> DataFrame:
    """Gauge prediction of every member: interpolated in mm, returned in transformed units.

    A gauge beyond the outermost centres reads the border cells with their whole weight.
    Cells that the field lacks count as dry; a gauge with none of its cells has no prediction.
    """
    mm = field.select(*keys, "iy", "ix", F.transform("members", lambda x: S.rain_inverse(x, kind, eps)).alias("members"))
    s = J.bilinear_members(mm, gauge, lattice, "members", keys, key, clamp=True)
    return s.select(key, *keys, F.transform("members", lambda x: S.rain_forward(x, kind, eps)).alias("hx"))


def update_once(field: DataFrame, gauge: DataFrame, obs: DataFrame, lattice: Lattice, obs_var: float, support_km: float,
                kind="log1p", eps=0.1, keys=("day",), key="station_id", value="obs_mm") -> DataFrame:
    """Square-root update of members (transformed units) by one gauge per day.

    The gauge side has one row per day, so it meets the cells on the day key; cells
    beyond the support keep their members untouched. Fewer than three members stop the job.
    """
    field = field.where(guard(F.size("members") < LEAST_MEMBERS, F.lit(TOO_FEW)))
    h = predicted_members(field, gauge, lattice, kind, eps, keys, key).join(gauge.select(key, F.col("lat").alias("_la"), F.col("lon").alias("_lo")), key)
    h = h.join(obs.where(F.col(value).isNotNull()).select(key, *keys, S.rain_forward(value, kind, eps).alias("_y")), [key, *keys])
    h = h.withColumn("_hm", EN.mean("hx")).withColumn("_hv", EN.variance("hx"))
    h = h.withColumn("_ha", F.transform("hx", lambda x: x - F.col("_hm"))).withColumn("_den", F.col("_hv") + obs_var)
    h = h.where(F.col("_den") > 1e-8).select(*keys, "_la", "_lo", "_y", "_hm", "_ha", "_den")
    d = field.join(h, list(keys), "left")
    dist = S.tangent_km(F.col("_la"), F.col("_lo"), lattice.lat(), lattice.lon())
    d = d.withColumn("_w", F.coalesce(S.gaspari_cohn(dist, support_km), F.lit(0.0))).withColumn("_m", EN.mean("members"))
    cov = EN.total(F.zip_with("members", "_ha", lambda x, a: (x - F.col("_m")) * a)) / (F.size("members") - 1)
    d = d.withColumn("_gain", F.col("_w") * cov / F.col("_den"))
    alpha = F.lit(1.0) / (F.sqrt(F.lit(float(obs_var)) / F.col("_den")) + 1.0)
    d = d.withColumn("_shift", F.col("_gain") * (F.col("_y") - F.col("_hm"))).withColumn("_pull", alpha * F.col("_gain"))
    new = F.zip_with("members", "_ha", lambda x, a: x + F.col("_shift") - F.col("_pull") * a)
    d = d.withColumn("_new", F.when(F.col("_w") > 0, new).otherwise(F.col("members")))
    return d.select(*keys, "iy", "ix", F.col("_new").alias("members"))


def innovation_rmse(field: DataFrame, gauges: DataFrame, obs: DataFrame, lattice: Lattice, kind="log1p", eps=0.1, keys=("day",), key="station_id", value="obs_mm") -> DataFrame:
    h = predicted_members(field, gauges, lattice, kind, eps, keys, key).select(key, *keys, EN.mean("hx").alias("_hm"))
    j = h.join(obs.where(F.col(value).isNotNull()).select(key, *keys, S.rain_forward(value, kind, eps).alias("_y")), [key, *keys])
    e = F.col("_y") - F.col("_hm")
    return j.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count("*").alias("n_gauges"))


#: The transforms of scalar.TRANSFORMS and their inverses on arrays; both get and give amounts that are not negative.
ARRAYS = {
    "none": (lambda p, scale: p, lambda z, scale: z),
    "sqrt": (lambda p, scale: np.sqrt(p), lambda z, scale: np.maximum(z, 0) ** 2),
    "cbrt": (lambda p, scale: p ** (1.0 / 3.0), lambda z, scale: z ** 3),
    "log1p": (lambda p, scale: np.log1p(p / scale), lambda z, scale: np.expm1(np.minimum(z, S.LARGEST_LOG)) * scale),
}


def _taper(km, support: float):
    """scalar.gaspari_cohn on an array."""
    r = km * 2.0 / support
    near = np.polyval([-1 / 4, 1 / 2, 5 / 8, -5 / 3, 0, 1], r)
    far = np.polyval([1 / 12, -1 / 2, 5 / 8, 5 / 3, -5, 4], r) - 2.0 / (np.maximum(r, 1.0) * 3.0)
    return np.clip(np.where(r <= 1, near, np.where(r < 2, far, 0.0)), 0, 1)


#: Days that one task updates together, and stored weights of places after which a task forgets them.
TOGETHER, KEPT_WEIGHTS = 4, 4_000_000


def _assimilate(state, iy, ix, gauges, seen, lattice: Lattice, obs_var: float, support_km: float, kind: str, eps: float):
    """Days of one ensemble size: update_once by each gauge in turn, on all days at once.

    state: cells x days x members, NaN where a day lacks a cell. gauges: (lat, lon) in order; seen: their transformed
    observations, gauges x days, NaN where there is none. What hangs on the place of a gauge alone is worked out once for gauges of a place.
    """
    forward, inverse = ARRAYS[kind]
    n, at = state.shape[2], {k: i for i, k in enumerate(zip(iy.tolist(), ix.tolist()))}
    if n < LEAST_MEMBERS:
        raise ValueError(TOO_FEW)
    first, res = (lattice.lat_min + 0.5 * lattice.res, lattice.lon_min + 0.5 * lattice.res), lattice.res
    lat, lon = iy * res + first[0], ix * res + first[1]

    def place(la, lo):
        """Cells read and their weights, cells within the support and theirs."""
        row, column = (min(max((v - a) / res, 0.0), size - 1.0) for v, a, size in ((la, first[0], lattice.nlat), (lo, first[1], lattice.nlon)))
        y0, x0 = int(np.floor(row)), int(np.floor(column))
        wy, wx = row - y0, column - x0
        four = [(at[y0 + dy, x0 + dx], (wy if dy else 1 - wy) * (wx if dx else 1 - wx)) for dy in (0, 1) for dx in (0, 1) if (y0 + dy, x0 + dx) in at]
        four = [(i, w) for i, w in four if w > 0]
        w = _taper(111.0 * np.sqrt((lat - la) ** 2 + (np.cos(np.radians(la)) * (lon - lo)) ** 2), support_km)
        near = np.flatnonzero(w)
        return np.array([i for i, _ in four], int), np.array([w for _, w in four])[:, None, None], near, w[near][:, None] / (n - 1)

    known, kept = {}, 0
    for (la, lo), y in zip(gauges, seen):
        if (la, lo) not in known:
            if kept > KEPT_WEIGHTS:
                known, kept = {}, 0
            known[la, lo] = place(la, lo)
            kept += len(known[la, lo][2])
        read, share, near, weight = known[la, lo]
        if not len(read):
            continue
        mm = np.maximum(inverse(state[read], eps), 0) * share
        total = mm.sum(0)
        if np.isnan(total).any():
            total = np.where(np.isnan(mm).all(0), np.nan, np.nansum(mm, 0))
        hx = forward(np.maximum(total, 0), eps)
        hm = hx.sum(1) / n
        ha = hx - hm[:, None]
        den = (ha * ha).sum(1) / (n - 1) + obs_var
        use = (den > 1e-8) & (y == y)
        days = slice(None)
        if not use.all():
            days = np.flatnonzero(use)
            if not len(days):
                continue
            hm, ha, den, y = hm[days], ha[days], den[days], y[days]
        s = state[near] if isinstance(days, slice) else state[near[:, None], days]
        centred = s - s.sum(2, keepdims=True) / n
        gain = weight * np.einsum("cdm,dm->cd", centred, ha) / den
        s += gain[:, :, None] * ((y - hm)[:, None] - ha / (np.sqrt(obs_var / den) + 1.0)[:, None])
        if isinstance(days, slice):
            state[near] = s
        else:
            state[near[:, None], days] = s
    return state


def _updated(cells, seen, keys, lattice: Lattice, obs_var: float, support_km: float, kind: str, eps: float):
    """update_serial on a few days, as pandas frames: cells with members, and gauges with _o, _id, _la, _lo, _y."""
    cells = cells.reset_index(drop=True)
    day = cells.groupby(keys, dropna=False).ngroup().to_numpy()
    names = cells[keys].assign(_d=day).drop_duplicates()
    seen = seen.merge(names, on=keys).sort_values(["_o", "_id"], kind="stable")
    seen["_again"] = seen.groupby(["_d", "_o", "_id"], dropna=False).cumcount()
    sizes, out = cells["members"].map(len).to_numpy(), [None] * len(cells)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        days, d = np.unique(day[rows], return_inverse=True)
        part = seen[seen["_d"].isin(days)]
        if len(part):
            where, c = np.unique(cells.loc[rows, ["iy", "ix"]].to_numpy(), axis=0, return_inverse=True)
            state = np.full((len(where), len(days), n), np.nan)
            state[c.ravel(), d] = np.array(cells.loc[rows, "members"].tolist(), float)
            turn = part.groupby(["_o", "_id", "_again", "_la", "_lo"], dropna=False).ngroup().to_numpy()
            at = np.empty((turn.max() + 1, 2))
            at[turn] = part[["_la", "_lo"]].to_numpy(float)
            y = np.full((len(at), len(days)), np.nan)
            y[turn, np.searchsorted(days, part["_d"].to_numpy())] = part["_y"].to_numpy(float)
            state = _assimilate(state, where[:, 0], where[:, 1], list(map(tuple, at.tolist())), y, lattice, obs_var, support_km, kind, eps)[c.ravel(), d]
        else:
            state = np.array(cells.loc[rows, "members"].tolist(), float)
        for r, m in zip(rows.tolist(), state.tolist()):
            out[r] = [None if x != x else x for x in m]
    return cells.assign(members=out)


def update_serial(field: DataFrame, gauges: DataFrame, obs: DataFrame, order: list | str | Column, lattice: Lattice, obs_var: float, support_km: float,
                  kind="log1p", eps=0.1, keys=("day",), key="station_id", value="obs_mm") -> DataFrame:
    """update_once by every gauge in turn. order: ids in their order (others are left out), or a column of the gauges, ties by id.

    Each update needs the field that the one before it left, but days are independent: one
    task takes the field and the gauges of at most TOGETHER days and updates them side by side,
    and any number of gauges is one shuffle.
    """
    S.transform_pair(kind)
    if isinstance(order, list):
        turns = F.array(*[F.lit(g) for g in order]) if order else F.array().cast("array<bigint>")
        o = field.sparkSession.range(1).select(F.posexplode(turns).alias("_o", key))
        g = gauges.join(o, key)
    else:
        g = gauges.withColumn("_o", S.col(order))
    g = g.select(key, "_o", F.col("lat").alias("_la"), F.col("lon").alias("_lo"))
    y = S.rain_forward(F.col(value), kind, eps).alias("_y")
    g = obs.where(F.col(value).isNotNull()).select(key, *keys, y).join(g, key).select(*keys, F.col(key).alias("_id"), "_o", "_la", "_lo", "_y")
    f = field.select(*keys, "iy", "ix", "members")
    columns = f.columns
    # The list of days is a calendar, so this window holds at most days of the record.
    days = field.select(*[F.col(k).alias(f"_day{i}") for i, k in enumerate(keys)]).distinct()
    first = days.columns
    days = days.withColumn("_b", F.lit(0)).withColumn("_b", F.floor((F.row_number().over(W.partitionBy("_b").orderBy(*first)) - 1) / TOGETHER))

    def numbered(df):
        own = days.select(*[F.col(c).alias(c) for c in days.columns])
        return df.join(own, [F.col(k).eqNullSafe(F.col(d)) for k, d in zip(keys, first)]).drop(*first).groupBy("_b")

    def some_days(cells, seen):
        if len(cells) and len(seen):
            cells = _updated(cells, seen.drop(columns="_b"), list(keys), lattice, obs_var, support_km, kind, eps)
        return cells[columns]

    return numbered(f).cogroup(numbered(g)).applyInPandas(some_days, f.schema)
