"""Summaries, fits and geostatistics as aggregations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from rainloom.functions import ensemble as EN, order as O, scalar as S
from rainloom.operators import joins as J
from rainloom.operators.checks import guard
from rainloom.session import cut_lineage

WET_MM = 1.0


def share(cond: Column) -> Column:
    """Share of rows meeting a condition; rows where it is unknown do not count."""
    return F.avg(cond.cast("double"))


def safe_corr(a, b) -> Column:
    """Correlation, NULL when either side has no spread.

    From the covariance and the spreads that are tested: corr rounds its own sums, which can be zero where a spread of
    one unit in the last place is not, and then stops the job by a division by zero. Equal values are told by their
    bounds: merging the partial means of equal values rounds, so their deviation need not be zero.
    """
    a, b = S.col(a), S.col(b)
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)) & (spread > 0)
    return S.clip(F.when(varied, F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))), -1.0, 1.0)


# ---- station and product summaries ----------------------------------------

def station_summary(df: DataFrame, n_days: int, key="station_id", value="precip_mm") -> DataFrame:
    """Availability, coverage, wet share, mean, p95, p99, max and total per station."""
    v = F.col(value)
    return df.groupBy(key).agg(
        F.count(v).alias("n_obs"), (F.count(v) / float(n_days)).alias("coverage"), share(v > 0).alias("wet_fraction"),
        F.avg(v).alias("mean_mm"), F.percentile(v, 0.95).alias("p95_mm"), F.percentile(v, 0.99).alias("p99_mm"),
        F.max(v).alias("max_mm"), F.sum(v).alias("total_mm"))


def _ingest_counts(text: str, max_mm: float, ok: Column) -> list[Column]:
    """Counts of cleaning over the cells that meet a condition."""
    v, good = F.when(ok, S.token_value(text)), F.when(ok, S.clean_legacy(text, max_mm))
    sent = S.is_sentinel(v)
    n = F.count_if(ok)
    return [
        n.alias("cells"), F.count(good).alias("valid"), F.count_if(sent).alias("sentinels"),
        F.count_if(v < 0).alias("negatives"), F.count_if(v > max_mm).alias("over_max"),
        F.count_if(ok & S.is_unknown_token(text)).alias("unknown_tokens"), S.ratio(F.count(good), n.cast("double")).alias("coverage"),
        share(good > 0).alias("wet_fraction"), F.avg(good).alias("mean_mm"), F.max(good).alias("max_mm")]


def ingest_report(cells: DataFrame, text: str, max_mm=1000.0) -> DataFrame:
    """Counts of what cleaning removed, over the raw text cells."""
    return cells.agg(*_ingest_counts(text, max_mm, F.lit(True)))


def archive_report(cells: DataFrame, text: str, date: Column, source: str, catalogued: str, max_mm=1000.0) -> DataFrame:
    """The ingest report of a station archive: cells without a calendar date are counted and left out of the rest.

    date: NULL where year, month and day name no day; source and catalogued: a station's name in the archive and in the
    catalogue, whose keys differ where an alias was used. One scan, one row.
    """
    d = cells.withColumn("_date", date)
    ok = F.col("_date").isNotNull()
    alias = ok & (S.station_key(source) != S.station_key(catalogued))
    return d.agg(
        F.count_if(~ok).alias("invalid_calendar_cells"), F.min("_date").alias("date_start"), F.max("_date").alias("date_end"),
        F.countDistinct(F.when(ok, F.col(catalogued))).alias("stations"), F.countDistinct(F.when(alias, F.struct(source, catalogued))).alias("aliases"),
        F.lit(float(max_mm)).alias("max_mm_threshold"), *_ingest_counts(text, max_mm, ok))


def aliases_used(cells: DataFrame, date: Column, source: str, catalogued: str) -> DataFrame:
    """The pairs of names that an alias joined, once each."""
    return cells.where(date.isNotNull() & (S.station_key(source) != S.station_key(catalogued))).select(source, catalogued).distinct()


def satellite_report(df: DataFrame, value="value", error="error", day="day") -> DataFrame:
    """Valid share, daily valid range and whole-table distribution of a prepared product: two scans for all of them."""
    hist, _, q = O.shared_quantiles(df, {value: [0.99], error: [0.5, 0.9]}, groups={"_day": (F.col(day), F.col(value))})
    daily, own = F.col("column") == "_day", F.col("column") == value
    share_of_day = F.when(daily, F.col("n") / F.col("rows"))
    one = hist.agg(
        S.ratio(F.sum(F.when(daily, F.col("n"))).cast("double"), F.sum(F.when(daily, F.col("rows"))).cast("double")).alias("valid_fraction"),
        F.min(share_of_day).alias("daily_valid_min"), F.median(share_of_day).alias("daily_valid_median"), F.max(share_of_day).alias("daily_valid_max"),
        S.ratio(F.sum(F.when(own, F.col("total"))), F.sum(F.when(own, F.col("n"))).cast("double")).alias("mean_mm"), F.max(F.when(own, F.col("high"))).alias("max_mm"))
    at = lambda c, i, name: F.max(F.when((F.col("column") == c) & (F.col("idx") == i), F.col("value"))).alias(name)
    ranks = q.agg(F.struct(at(value, 0, "p99_mm"), at(error, 0, "error_median"), at(error, 1, "error_p90")).alias("_q"))
    return one.withColumn("_q", ranks.scalar()).select("valid_fraction", "daily_valid_min", "daily_valid_median", "daily_valid_max", "mean_mm", "_q.p99_mm", "max_mm", "_q.error_median", "_q.error_p90")


def fit_transform(df: DataFrame, value: str, kind="log1p", eps=0.1, keys=()) -> DataFrame:
    y = S.rain_forward(value, kind, eps)
    return df.groupBy(*keys).agg(F.avg(y).alias("mu"), (F.stddev_pop(y) + 1e-12).alias("sd"))


def channel_statistics(df: DataFrame, channel: str, value: str) -> DataFrame:
    """Transformed mean and SD per channel with raw wet share and maximum."""
    y = S.channel_forward(value, channel)
    return df.groupBy(channel).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.count(value).alias("n"),
                                   share(F.col(value) >= WET_MM).alias("wet_fraction"), F.max(value).alias("max_mm"))


def residual_statistics(df: DataFrame, target: Column, base: Column) -> DataFrame:
    """Residual mean, SD, base correlation and largest encoded residual in one pass."""
    r = target - base
    s = df.agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), safe_corr(target, base).alias("base_corr"),
               F.max(r).alias("_hi"), F.min(r).alias("_lo"), F.count(r).alias("n"))
    sd = F.nullif(F.col("std"), F.lit(0.0))
    top = F.greatest(F.abs((F.col("_hi") - F.col("mean")) / sd), F.abs((F.col("_lo") - F.col("mean")) / sd))
    return s.select("n", "mean", "std", "base_corr", top.alias("encoded_abs_max"))


def running_pair(df: DataFrame, keys, pred="pred", obs="obs") -> DataFrame:
    """Mergeable sums of a paired score; finish_pair turns them into metrics."""
    p, o = F.col(pred), F.col(obs)
    d = df.where(p.isNotNull() & o.isNotNull())
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(o).alias("so"), F.sum(p * p).alias("spp"), F.sum(o * o).alias("soo"),
        F.sum(p * o).alias("spo"), F.sum(F.abs(p - o)).alias("sad"))


def finish_pair(sums: DataFrame, keys) -> DataFrame:
    n = F.col("n")
    cov = F.col("spo") - F.col("sp") * F.col("so") / n
    vp, vo = F.col("spp") - F.col("sp") * F.col("sp") / n, F.col("soo") - F.col("so") * F.col("so") / n
    return sums.select(*keys, "n", F.when((vp > 0) & (vo > 0), cov / F.sqrt(F.greatest(vp * vo, F.lit(1e-300)))).alias("corr"),
                       ((F.col("sp") - F.col("so")) / n).alias("bias"), (F.col("sad") / n).alias("mae"),
                       F.sqrt(F.greatest((F.col("spp") - F.col("spo") * 2 + F.col("soo")) / n, F.lit(0.0))).alias("rmse"))


def drizzle(df: DataFrame, value="value", wet=WET_MM, keys=()) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(share(F.when(v > 0, v < wet)).alias("drizzle_cells"),
                                 S.ratio(F.sum(F.when((v > 0) & (v < wet), v).otherwise(F.when(v.isNotNull(), 0.0))), F.sum(F.when(v > 0, v))).alias("drizzle_mass"))


def daily_spatial(df: DataFrame, value: str, keys=("day",), wet=WET_MM) -> DataFrame:
    """Domain mean, spatial SD, wet area and p95 per day; a day holds one lattice at most."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("domain_mean"), F.stddev_pop(v).alias("spatial_std"),
                                 share(v >= wet).alias("wet_area"), F.percentile(v, 0.95).alias("p95"))


def physical_summary(df: DataFrame, value: str, keys=()) -> DataFrame:
    """n, mean, p99, p99.9 and max of whole columns, all from one histogram and its refinement."""
    hist, _, q = O.shared_quantiles(df, {value: [0.99, 0.999]}, keys)
    at = lambda i, name: F.max(F.when(F.col("idx") == i, F.col("value"))).alias(name)
    a = hist.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), S.ratio(F.sum("total"), F.sum("n").cast("double")).alias("mean"), F.max("high").alias("max"))
    b = q.groupBy(*keys).agg(at(0, "p99"), at(1, "p999"))
    a = a.join(b, list(keys)) if keys else a.withColumn("_q", b.select(F.struct("*")).scalar()).select("*", "_q.*")
    return a.select(*keys, "n", "mean", "p99", "p999", "max")


# ---- variograms -----------------------------------------------------------

#: Places of a block: two blocks of months meet in one task.
BLOCK = 256


def _block_sums(edges):
    """Sums over all station pairs of two blocks of places in one month, by distance bin: squared differences, shared days, distances.

    A place has for each day the number of its values, their sum and the sum of their squares, which are all that the
    squared differences between the stations of two places, or of one, ask for.
    """
    def km(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        la, lb, oa, ob = (np.radians(x.to_numpy(float)) for x in (a["lat"], b["lat"], a["lon"], b["lon"]))
        h = np.sin((lb[None] - la[:, None]) / 2) ** 2 + np.cos(la)[:, None] * np.cos(lb)[None] * np.sin((ob[None] - oa[:, None]) / 2) ** 2
        return 2 * S.EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        same = bool((t["p"] == t["q"]).iloc[0])
        a, b = (t, t) if same else (t[t["p"] == t["block"]], t[t["q"] == t["block"]])
        if not len(a) or not len(b):
            return pd.DataFrame({"bin": pd.Series(dtype="int32"), "ss": pd.Series(dtype=float), "n": pd.Series(dtype="int64"), "sk": pd.Series(dtype=float)})
        (na, xa, qa), (nb, xb, qb) = ([np.nan_to_num(np.stack(z[c].to_numpy()).astype(float)) for c in ("ns", "ys", "qs")] for z in (a, b))
        n, ss, d = na @ nb.T, qa @ nb.T + na @ qb.T - 2 * xa @ xb.T, km(a, b)
        if same:
            # A place with itself: each pair of its stations once.
            own = np.arange(len(a))
            n[own, own], ss[own, own], d[own, own] = (na * (na - 1) / 2).sum(1), (na * qa - xa * xa).sum(1), 0.0
        bins = np.where(d < edges[-1], np.searchsorted(edges, d, side="right") - 1, -1)
        if same:
            bins[np.tril_indices(len(a), -1)] = -1
        at = bins >= 0
        add = lambda w: np.bincount(bins[at], w[at], len(edges) - 1)
        return pd.DataFrame({"bin": np.arange(len(edges) - 1, dtype=np.int32), "ss": add(np.maximum(ss, 0)), "n": np.rint(add(n)).astype(np.int64), "sk": add(n * d)})

    return run


def empirical_variogram(obs: DataFrame, stations: DataFrame, edges, min_pairs=30, value="precip_mm", date="date",
                        key="station_id", block: int = BLOCK) -> DataFrame:
    """Pair variogram pooled over days. A station with two rows of one day stops the job.

    Stations of equal coordinates travel as one place with the count, sum and sum of squares of its values of a day,
    taken from the mean of all values; so the pairs grow with the places, not with the stations. Places are dealt into
    blocks: tiles as wide as the last edge, dense ones cut by hash into blocks of about `block` places. All blocks of
    tiles that hold a pair closer than the last edge meet once a month, where matrix products form the sums of all
    their pairs. A place-month is shipped once for each such block, and a task returns one row a bin.
    """
    edges = [float(e) for e in edges]
    tile = edges[-1] / 111.0
    at = J.places(stations, key, 1).select(F.get("_ids", F.lit(0)).alias("_p"), "lat", "lon")
    at = cut_lineage(at.withColumn("_t", F.concat_ws(":", F.floor(F.col("lat") / tile), F.floor(F.col("lon") / tile))))
    n = at.groupBy("_t").agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    name = lambda i: F.concat_ws(":", "_t", i)
    b = at.join(n, "_t").select("lat", "lon", name(F.pmod(F.xxhash64("_p"), "_n")).alias("block"))
    tiles = J.neighbours_within(at, at, edges[-1], "_p").join(at.select(F.col("_p").alias("a"), F.col("_t").alias("_ta")), "a").join(at.select(F.col("_p").alias("b"), F.col("_t").alias("_tb")), "b")
    tiles = tiles.select("_ta", "_tb").unionByName(n.select(F.col("_t").alias("_ta"), F.col("_t").alias("_tb"))).distinct()
    blocks = n.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("_t", name("_i").alias("block"))
    near = tiles.join(blocks.select(F.col("_t").alias("_ta"), F.col("block").alias("p")), "_ta").join(blocks.select(F.col("_t").alias("_tb"), F.col("block").alias("q")), "_tb")
    near = cut_lineage(near.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct())
    visits = near.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))

    o = obs.where(F.col(value).isNotNull())
    twice = F.concat(F.lit("two values of one day: "), F.concat_ws(",", F.col(key).cast("string"), F.col(date).cast("string")))
    o = o.groupBy(key, date).agg(F.first(value).cast("double").alias("_v"), F.count("*").alias("_c")).where(guard(F.col("_c") > 1, twice))
    centred = F.col("_v") - F.coalesce(obs.agg(F.avg(value)).scalar(), F.lit(0.0))
    o = o.withColumn("_v", centred).join(stations.select(key, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")), key)
    s = o.groupBy("lat", "lon", date).agg(F.count("*").cast("double").alias("n"), F.sum("_v").alias("y"), F.sum(F.col("_v") * F.col("_v")).alias("q"))
    s = s.groupBy("lat", "lon", F.trunc(date, "month").alias("month")).agg(F.map_from_entries(F.collect_list(F.struct(F.dayofmonth(date), F.struct("n", "y", "q")))).alias("m"))
    days = F.transform(F.sequence(F.lit(1), F.lit(31)), lambda d: F.try_element_at("m", d))
    s = s.select("lat", "lon", "month", days.alias("z")).select("lat", "lon", "month", *[F.col(f"z.{c}").alias(f"{c}s") for c in "nyq"])
    j = s.join(b, ["lat", "lon"]).join(visits, "block").select("p", "q", "block", "month", "lat", "lon", "ns", "ys", "qs")
    j = j.groupBy("p", "q", "month").applyInPandas(_block_sums(edges), "bin int, ss double, n long, sk double")
    g = j.groupBy("bin").agg(F.sum("ss").alias("ss"), F.sum("n").alias("n_pairs"), F.sum("sk").alias("sk"))
    mids = F.array(*[F.lit((a + b) / 2.0) for a, b in zip(edges[:-1], edges[1:])])
    full = F.col("n_pairs") >= min_pairs
    return g.where("n_pairs > 0").select(
        "bin", F.when(full, F.col("sk") / F.col("n_pairs")).otherwise(F.get(mids, F.col("bin"))).alias("distance_km"),
        F.when(full, F.col("ss") * 0.5 / F.col("n_pairs")).alias("gamma"), "n_pairs")


def fit_variogram(bins: DataFrame, candidates: int = 400, min_range: float | None = None, keys=()) -> DataFrame:
    """Exponential fit: ranges searched on a log grid, nugget and sill by weighted least squares.

    The usable bins travel as one small array, so the search explodes a sequence
    and needs no join.
    """
    g = bins.where(F.col("gamma").isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("bin"), F.col("distance_km").alias("h"), F.col("gamma").alias("g"), F.col("n_pairs").cast("double").alias("n")))).alias("b"))
    g = g.where(F.size("b") >= 3)
    tot = F.aggregate("b", F.lit(0.0), lambda a, x: a + x["n"])
    low = F.array_min(F.transform("b", lambda x: x["h"])) if min_range is None else F.lit(float(min_range))
    g = g.withColumn("_lo", F.greatest(low, F.lit(1e-3))).withColumn(
        "_hi", F.greatest(F.array_max(F.transform("b", lambda x: x["h"])) * 5, F.col("_lo") * 10)).withColumn("_t", tot)
    g = g.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    g = g.withColumn("range_km", F.exp(F.log("_lo") + F.col("_k") / float(candidates - 1) * (F.log("_hi") - F.log("_lo"))))
    g = g.withColumn("x", F.transform("b", lambda x: F.struct(
        (x["n"] / F.col("_t")).alias("w"), x["g"].alias("g"), (F.lit(1.0) - F.exp(-x["h"] / F.col("range_km"))).alias("u"))))

    def s(f):
        return F.aggregate("x", F.lit(0.0), lambda a, r: a + r["w"] * f(r))

    g = g.withColumn("s1", s(lambda r: r["u"])).withColumn("s2", s(lambda r: r["u"] * r["u"])).withColumn(
        "g0", s(lambda r: r["g"])).withColumn("g1", s(lambda r: r["g"] * r["u"]))
    det = F.nullif(F.col("s2") - F.col("s1") * F.col("s1"), F.lit(0.0))
    g = g.withColumn("_n", (F.col("g0") * F.col("s2") - F.col("g1") * F.col("s1")) / det).withColumn(
        "_s", (F.col("g1") - F.col("s1") * F.col("g0")) / det).where(F.col("_n").isNotNull())
    flat, pure = F.col("_s") < 0, (F.col("_s") >= 0) & (F.col("_n") < 0)
    g = g.withColumn("nugget", F.when(flat, F.greatest("g0", F.lit(0.0))).when(pure, F.lit(0.0)).otherwise(F.col("_n")))
    g = g.withColumn("sill", F.when(flat, F.lit(0.0)).when(pure, F.greatest(
        F.col("g1") / F.greatest("s2", F.lit(1e-12)), F.lit(0.0))).otherwise(F.col("_s")))
    score = F.aggregate("x", F.lit(0.0), lambda a, r: a + r["w"] * F.pow(r["g"] - (F.col("nugget") + F.col("sill") * r["u"]), F.lit(2.0)))
    g = g.withColumn("score", score)
    best = g.groupBy(*keys).agg(F.min_by(F.struct("nugget", "sill", "range_km", "score", F.size("b").alias("n_bins")), F.struct("score", "_k")).alias("f")).where("f is not null")
    return best.select(*keys, "f.nugget", "f.sill", "f.range_km", F.sqrt("f.score").alias("fit_rmse"), "f.n_bins")


def block_dispersion(fit: DataFrame, cell_km: float, n_sub: int = 12) -> DataFrame:
    """Mean variogram over point pairs of a cell, by offsets with their multiplicity."""
    n = n_sub
    k = F.sequence(F.lit(1), F.lit(n * n - 1))

    def term(i):
        di, dj = F.floor(i / n), i % n
        mult = (n - di) * (n - dj) * F.when(di > 0, 2).otherwise(1) * F.when(dj > 0, 2).otherwise(1)
        h = F.sqrt((di * di + dj * dj).cast("double")) * (cell_km / n)
        return mult * (F.col("nugget") + F.col("sill") * (F.lit(1.0) - F.exp(-h / F.greatest(F.col("range_km"), F.lit(1e-9)))))

    total = F.aggregate(F.transform(k, term), F.lit(0.0), lambda a, x: a + x)
    m = n * n
    return fit.withColumn("block_variance", total / float(m * (m - 1))).withColumn(
        "rep_sigma", F.sqrt(F.greatest(F.col("block_variance"), F.lit(0.0))))


# ---- error models ---------------------------------------------------------

def aggregation_decomposition(scores: DataFrame, window="window", mse="mse", keys=()) -> DataFrame:
    """MSE(N) = a + b/N over windows; the floor is clipped at zero before R squared."""
    x, y = 1.0 / F.col(window), F.col(mse)
    g = scores.groupBy(*keys).agg(
        F.count(y).alias("n_windows"), F.regr_intercept(y, x).alias("_a"), F.regr_slope(y, x).alias("_b"),
        F.sum(y * y).alias("syy"), F.sum(y).alias("sy"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    a, b, n = F.greatest(F.col("_a"), F.lit(0.0)), F.col("_b"), F.col("n_windows")
    sse = F.col("syy") - a * 2 * F.col("sy") - b * 2 * F.col("sxy") + a * a * n + a * b * 2 * F.col("sx") + b * b * F.col("sxx")
    sst = F.col("syy") - F.col("sy") * F.col("sy") / n
    return g.where("n_windows >= 2").select(
        *keys, "n_windows", a.alias("systematic_mse"), b.alias("random_mse"), F.sqrt(a).alias("systematic_rmse"),
        F.sqrt(F.greatest(b, F.lit(0.0))).alias("random_rmse_daily"), (1 - S.ratio(sse, sst)).alias("r_squared"),
        (F.col("_a") < 0).alias("intercept_was_negative"), (b < 0).alias("error_grows"), ((F.col("_a") >= 0) & (b >= 0)).alias("model_is_valid"))


def observation_error(df: DataFrame, product: Column, gauge: Column, sigma_rep: float, keys=()) -> DataFrame:
    """Split product-minus-gauge scatter into representativeness and product error."""
    d = product - gauge
    g = df.groupBy(*keys).agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.var_samp(d).alias("v"))
    left = F.col("v") - sigma_rep ** 2
    return g.select(*keys, "n", "mean_difference", F.sqrt("v").alias("total_sigma"), F.when(left > 0, F.sqrt(F.greatest(left, F.lit(0.0)))).alias("sigma_obs"),
                    S.ratio(F.lit(sigma_rep ** 2), F.col("v")).alias("representativeness_share"), (left > 0).alias("split_is_valid"))


def intensity_bins(df: DataFrame, gauge: str, difference: Column, eps=0.1, n_bins=12) -> DataFrame:
    """SD of the difference per quantile bin of log1p(gauge/eps); bins are half open, so the top value is out.

    Edges and bins take two scans: sums travel with the buckets that find the edges."""
    d = df.select(F.log1p(F.col(gauge) / eps).alias("x"), difference.alias("d")).where("x is not null and d is not null")
    hist, detail, q = O.shared_quantiles(d, {"x": [i / n_bins for i in range(n_bins + 1)]}, sums={"d": F.col("d"), "dd": F.col("d") * F.col("d")})
    p = O.pieces(hist, detail, sums=["d", "dd"]).withColumn("_e", O.edges_of(q).scalar())
    p = p.withColumn("bin", F.size(F.filter("_e", lambda e: e <= F.col("low"))) - 1).where(F.col("bin") < F.size("_e") - 1)
    n, sd = F.sum("n"), F.sum("d")
    var = F.greatest(F.sum("dd") - sd * sd / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0))
    return p.groupBy("bin").agg((F.sum("total") / n).alias("centre"), F.sqrt(var).alias("sigma"), n.alias("n"))


def fit_intensity_error(bins: DataFrame, min_per_bin=50) -> DataFrame:
    """Count-weighted line through the bin SDs with an unweighted R squared."""
    b = bins.where(F.col("n") >= min_per_bin)
    w, x, y = F.col("n").cast("double"), F.col("centre"), F.col("sigma")
    g = b.agg(F.count("*").alias("bins"), F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"),
              F.sum(w * x * y).alias("wxy"), F.max(y).alias("max_sigma"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"), F.sum(x).alias("x"),
              F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    det = F.nullif(F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"), F.lit(0.0))
    slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / det
    floor = (F.col("wy") - slope * F.col("wx")) / F.col("w")
    n = F.col("bins")
    g = g.where("bins >= 3").withColumn("slope", slope).withColumn("floor", floor)
    sse = (F.col("yy") - F.col("floor") * 2 * F.col("y") - F.col("slope") * 2 * F.col("xy") + F.col("floor") * F.col("floor") * n
           + F.col("floor") * F.col("slope") * 2 * F.col("x") + F.col("slope") * F.col("slope") * F.col("xx"))
    sst = F.col("yy") - F.col("y") * F.col("y") / n
    return g.select("bins", F.col("floor").alias("sigma_floor"), F.col("slope").alias("sigma_slope"), "max_sigma", (1 - S.ratio(sse, sst)).alias("r_squared"))


# ---- pooling --------------------------------------------------------------

def weighted_mean(value, weight) -> Column:
    v, w = S.col(value), S.col(weight)
    return S.ratio(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def fisher_pooled(corr, n) -> Column:
    """Correlation pooled through Fisher z with weights max(n - 3, 1)."""
    z = F.atanh(S.clip(corr, -0.999999, 0.999999))
    return F.tanh(weighted_mean(z, F.greatest(S.col(n) - 3, F.lit(1))))


def binned_profile(df: DataFrame, covariate: Column, value: str, edges) -> DataFrame:
    """Mean and count of a value by covariate bin [lo, hi)."""
    b = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        b = F.when((covariate >= float(edges[i])) & (covariate < float(edges[i + 1])), F.lit(i)).otherwise(b)
    return df.withColumn("bin", b).where("bin is not null").groupBy("bin").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def exceedance_attribution(df: DataFrame, exceeds: Column, regions: list[str]) -> DataFrame:
    """Share of exceedances over share of area for each region and crossing of regions."""
    g = df.cube(*regions).agg(F.count("*").alias("cells"), F.count_if(exceeds).alias("hits"))
    t = df.agg(F.count("*").alias("c"), F.count_if(exceeds).alias("h"))
    c, h = t.select("c").scalar(), t.select("h").scalar()
    sa, sh = F.col("cells") / c, S.ratio(F.col("hits").cast("double"), h.cast("double"))
    return g.select(*regions, "cells", "hits", sa.alias("area_share"), sh.alias("hit_share"), (sh / sa).alias("enrichment"))


def edge_distance(nlat: int, nlon: int) -> Column:
    return F.least(F.col("iy"), F.lit(nlat - 1) - F.col("iy"), F.col("ix"), F.lit(nlon - 1) - F.col("ix"))


def distance_to_false(mask: DataFrame, flag: str, first: int = 4) -> DataFrame:
    """Euclidean cell distance of every true cell to the nearest false one; NULL only where there is no false cell.

    Only false cells on the rim of the false region can be nearest. Buckets widen fourfold until the neighbourhood
    proves the distance or spans the mask. Runs a job for each width while the plan is built.
    """
    ends = mask.agg(F.min("iy"), F.max("iy"), F.min("ix"), F.max("ix")).first()
    span = max((b - a for a, b in ((ends[0], ends[1]), (ends[2], ends[3])) if a is not None), default=0)
    f = mask.where(~F.col(flag)).select(F.col("iy").alias("fy"), F.col("ix").alias("fx"))
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))]))
    t = mask.where(F.col(flag)).select("iy", "ix")
    touched = t.withColumn("_o", near).select((F.col("iy") + F.col("_o.y")).alias("fy"), (F.col("ix") + F.col("_o.x")).alias("fx")).distinct()
    rim = f.join(touched, ["fy", "fx"], "left_semi")
    open_, done = t, None
    size = first
    while True:
        around = F.array(*[F.struct((F.floor(F.col("iy") / size) + a).alias("_by"), (F.floor(F.col("ix") / size) + b).alias("_bx"))
                           for a in (-1, 0, 1) for b in (-1, 0, 1)])
        look = open_.withColumn("_k", F.explode(around)).select("iy", "ix", "_k.*")
        filed = rim.withColumn("_by", F.floor(F.col("fy") / size)).withColumn("_bx", F.floor(F.col("fx") / size))
        dy, dx = F.col("iy") - F.col("fy"), F.col("ix") - F.col("fx")
        best = look.join(filed, ["_by", "_bx"], "left").groupBy("iy", "ix").agg(F.min(F.sqrt((dy * dy + dx * dx).cast("double"))).alias("distance"))
        last = size > span
        if not last:
            best = J.cut_lineage(best)
        out = best if last else best.where(F.col("distance") <= size)
        done = out if done is None else done.unionByName(out)
        if last:
            break
        open_ = best.where(F.col("distance").isNull() | (F.col("distance") > size)).select("iy", "ix")
        if open_.isEmpty():
            break
        size *= 4
    return done


def station_sd_metrics(df: DataFrame, key="station_id", pred="pred", obs="obs", min_days=2, keys=()) -> DataFrame:
    """Compare per-station SDs of daily values (population SD, at least two days)."""
    s = df.where(F.col(pred).isNotNull() & F.col(obs).isNotNull()).groupBy(*keys, key).agg(
        F.stddev_pop(pred).alias("p"), F.stddev_pop(obs).alias("o"), F.count("*").alias("n")).where(F.col("n") >= min_days)
    d = F.col("p") - F.col("o")
    return s.groupBy(*keys).agg(F.count("*").alias("stations"), safe_corr("p", "o").alias("corr"), F.avg(d).alias("bias"), F.sqrt(F.avg(d * d)).alias("rmse"),
                                S.ratio(F.avg("p"), F.avg("o")).alias("amplitude_ratio"))


def member_summaries(df: DataFrame, keys=(), members="members", wet=WET_MM, n_members: int | None = None) -> DataFrame:
    """Field summaries per member averaged over members, beside the summary of the mean. Rows do not follow the ensemble's size, which is looked up unless given."""
    n, m = n_members or EN.largest(df, members), F.col("_m")
    each = lambda agg, name: EN.each(agg, n, members).alias(name)
    s = df.withColumn("_m", EN.mean(members)).groupBy(*keys).agg(
        each(F.avg, "mean"), each(lambda v: share(v >= wet), "wet"), each(F.max, "mx"), each(lambda v: F.percentile(v, 0.99), "p99"), each(F.stddev_pop, "sd"),
        F.percentile(m, 0.99).alias("mean_p99"), F.avg(m).alias("mean_mean"), share(m >= wet).alias("mean_wet"), F.max(m).alias("mean_max"))
    return s.select(*keys, EN.mean_of_known(F.col("mean")).alias("member_mean"), EN.mean_of_known(F.col("wet")).alias("member_wet"), EN.mean_of_known(F.col("mx")).alias("member_max"),
                    EN.mean_of_known(F.col("p99")).alias("member_p99"), "mean_p99", F.size(F.filter("sd", lambda x: x == 0)).cast("long").alias("constant_members"), "mean_mean", "mean_wet", "mean_max")
