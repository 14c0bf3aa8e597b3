"""Deterministic and spatial verification of long fields and station pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from rainloom.functions import order as O, scalar as S
from rainloom.operators import grid as GR, joins as J
from rainloom.operators.stats import safe_corr, share
from rainloom.session import cut_lineage

WET_MM = 1.0


def paired(df: DataFrame, pred="pred", obs="obs") -> DataFrame:
    return df.where(F.col(pred).isNotNull() & F.col(obs).isNotNull() & ~F.isnan(pred) & ~F.isnan(obs))


def _d(pred, obs):
    return F.col(pred) - F.col(obs)


def basic(pred="pred", obs="obs") -> list[Column]:
    d = _d(pred, obs)
    return [F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias")]


def categorical(threshold: float, pred="pred", obs="obs", prefix="") -> list[Column]:
    """POD, FAR, CSI, ETS and frequency bias at one threshold, all from one pass."""
    p, o = F.col(pred) >= threshold, F.col(obs) >= threshold
    h, f, m = (F.count_if(p & o).cast("double"), F.count_if(p & ~o).cast("double"), F.count_if(~p & o).cast("double"))
    n = F.count("*")
    lucky = (h + m) * (h + f) / n
    return [S.ratio(h, h + m).alias(f"{prefix}pod"), S.ratio(f, h + f).alias(f"{prefix}far"), S.ratio(h, h + f + m).alias(f"{prefix}csi"),
            S.ratio(h - lucky, h + f + m - lucky).alias(f"{prefix}ets"), S.ratio(h + f, h + m).alias(f"{prefix}freq_bias")]


def summarize(df: DataFrame, thresholds, keys=(), pred="pred", obs="obs") -> DataFrame:
    extra = [c for t in thresholds for c in categorical(float(t), pred, obs, f"t{t:g}_")]
    return paired(df, pred, obs).groupBy(*keys).agg(*basic(pred, obs), *extra)


def contingency(df: DataFrame, thresholds, keys=(), pred="pred", obs="obs") -> DataFrame:
    d = paired(df, pred, obs).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    p, o = F.col(pred) >= F.col("threshold"), F.col(obs) >= F.col("threshold")
    g = d.groupBy(*keys, "threshold").agg(F.count("*").alias("n"), F.count_if(p & o).alias("hits"), F.count_if(~p & o).alias("misses"), F.count_if(p & ~o).alias("false_alarms"))
    h, m, f = F.col("hits").cast("double"), F.col("misses").cast("double"), F.col("false_alarms").cast("double")
    lucky = (h + m) * (h + f) / F.col("n")
    return g.withColumn("pod", S.ratio(h, h + m)).withColumn("far", S.ratio(f, h + f)).withColumn("csi", S.ratio(h, h + f + m)).withColumn(
        "ets", S.ratio(h - lucky, h + f + m - lucky)).withColumn("freq_bias", S.ratio(h + f, h + m))


def paired_scores(df: DataFrame, keys=(), pred="pred", obs="obs", wet=WET_MM) -> DataFrame:
    """Product-versus-gauge scores; the median bias comes from distributed order statistics."""
    p = paired(df, pred, obs)
    d, e, g = _d(pred, obs), F.col(pred), F.col(obs)
    out = p.groupBy(*keys).agg(
        *basic(pred, obs), F.avg(d * d).alias("mse"), F.avg(g).alias("gauge_mean"), F.avg(e).alias("product_mean"), safe_corr(pred, obs).alias("correlation"),
        share(e >= wet).alias("wet_product"), share(g >= wet).alias("wet_gauge"), F.avg(F.when(g >= wet, F.abs(d))).alias("wet_mae"),
        S.ratio(F.stddev_pop(e), F.stddev_pop(g)).alias("sd_ratio")).where("n >= 2")
    q = O.quantiles(p.select(*keys, d.alias("_d")), "_d", [0.5], keys).select(*keys, F.col("value").alias("median_bias"))
    return out.join(q, list(keys)) if keys else out.withColumn("median_bias", q.scalar())


def pattern_correlation(df: DataFrame, pred="pred", obs="obs", day="day", keys=(), min_cells=3, strict=False) -> DataFrame:
    """Spatial correlation per day, missing where too few cells or no spread."""
    g = paired(df, pred, obs).groupBy(*keys, day).agg(F.count("*").alias("cells"), safe_corr(pred, obs).alias("corr"))
    ok = F.col("cells") > min_cells if strict else F.col("cells") >= min_cells
    return g.withColumn("corr", F.when(ok, F.col("corr")))


def field_metrics(df: DataFrame, keys=(), pred="pred", obs="obs") -> DataFrame:
    d = _d(pred, obs)
    return paired(df, pred, obs).groupBy(*keys).agg(
        *basic(pred, obs), safe_corr(pred, obs).alias("correlation"), F.stddev_pop(d).alias("centred_rmse"),
        S.ratio(F.stddev_pop(pred), F.stddev_pop(obs)).alias("sd_ratio"), S.ratio(F.var_pop(pred), F.var_pop(obs)).alias("variance_ratio"))


def base_comparison(df: DataFrame, candidate: str, keys=(), pred="pred", obs="obs", kind="log1p", eps=0.1) -> DataFrame:
    """Scores per candidate on its own matched sample, with transformed-space correlation."""
    d = paired(df, pred, obs).withColumn("_p", S.rain_forward(pred, kind, eps)).withColumn("_o", S.rain_forward(obs, kind, eps))
    g = d.groupBy(*keys, candidate).agg(*basic(pred, obs), safe_corr(pred, obs).alias("correlation"), safe_corr("_p", "_o").alias("transformed_correlation"),
                                        F.stddev_pop(pred).alias("candidate_std"), F.stddev_pop(obs).alias("target_std"))
    c = F.greatest(F.col("correlation"), F.lit(0.0))
    return g.withColumn("variance_explained", F.when(F.col("correlation").isNotNull(), c * c)).withColumn(
        "std_ratio", S.ratio(F.col("candidate_std"), F.col("target_std")))


def anomaly_metrics(df: DataFrame, keys=(), pred="pred", obs="obs", active=1.0) -> DataFrame:
    """Scores of anomalies. They are rounded to nine digits first: an anomaly on the threshold must not hang on the order of a sum."""
    df = df.withColumn(pred, F.round(pred, 9)).withColumn(obs, F.round(obs, 9))
    d, p, o = _d(pred, obs), F.col(pred), F.col(obs)
    agree = F.when(F.abs(o) >= active, (F.signum(p) == F.signum(o)).cast("double"))
    return paired(df, pred, obs).groupBy(*keys).agg(
        F.count("*").alias("n"), safe_corr(pred, obs).alias("correlation"), F.sqrt(F.avg(d * d)).alias("rmse"),
        (1 - S.ratio(F.avg(d * d), F.avg(o * o))).alias("mse_skill"), F.avg(d).alias("bias"),
        S.ratio(F.var_pop(p), F.var_pop(o)).alias("variance_ratio"), F.avg(agree).alias("sign_agreement"))


def skill_against(scores: DataFrame, null: DataFrame, keys, metrics=("mse", "crps")) -> DataFrame:
    """1 - score/null per metric on the shared keys."""
    n = null.select(*keys, *[F.col(m).alias(f"_n_{m}") for m in metrics])
    j = scores.join(n, list(keys))
    return j.select(*scores.columns, *[F.when(F.col(f"_n_{m}") > 0, 1 - F.col(m) / F.nullif(F.col(f"_n_{m}"), F.lit(0.0))).alias(f"{m}_skill") for m in metrics])


# ---- neighbourhood scores -------------------------------------------------

def fss_days(df: DataFrame, thresholds, windows, nlat: int, nlon: int, pred="pred", obs="obs", day="day", edge="zero", cells="all") -> DataFrame:
    """Numerator and denominator of the fractions skill score per day, threshold and window.

    All windows share the two running sums of box_sums. edge 'zero' pads with dry
    cells, 'replicate' repeats the border. cells 'all' averages over the lattice,
    'land' scores only cells where both fields are present, and 'paired' also counts
    every other cell as dry.
    """
    if edge not in ("zero", "replicate") or cells not in ("all", "land", "paired"):
        raise ValueError("unknown edge or cells rule")
    pad = max(windows) // 2 if edge == "replicate" else 0
    spine = df.select(day).distinct().withColumn("iy", F.explode(F.sequence(F.lit(-pad), F.lit(nlat - 1 + pad)))).withColumn(
        "ix", F.explode(F.sequence(F.lit(-pad), F.lit(nlon - 1 + pad))))
    src = spine.withColumn("sy", F.least(F.greatest("iy", F.lit(0)), F.lit(nlat - 1))).withColumn("sx", F.least(F.greatest("ix", F.lit(0)), F.lit(nlon - 1)))
    d = src.join(df.select(day, F.col("iy").alias("sy"), F.col("ix").alias("sx"), F.col(pred).alias("_p"), F.col(obs).alias("_o")), [day, "sy", "sx"], "left")
    ok = F.col("_p").isNotNull() & F.col("_o").isNotNull()
    d = d.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))

    def hit(c):
        seen = ok if cells == "paired" else F.lit(True)
        return F.when(seen & F.coalesce(F.col(c) >= F.col("threshold"), F.lit(False)), 1).otherwise(0)

    d = d.select(day, "threshold", "iy", "ix", ok.alias("ok"), hit("_p").alias("pb"), hit("_o").alias("ob"))
    spans = {f"_{w}": (w // 2, w - 1 - w // 2) for w in windows}
    b = GR.box_sums(d, {"p": "pb", "o": "ob"}, spans, (day, "threshold"))
    b = b.where(F.col("iy").between(0, nlat - 1) & F.col("ix").between(0, nlon - 1))
    use = F.lit(True) if cells == "all" else F.col("ok")

    def part(w):
        a = float(w * w)
        p, o = F.when(use, F.col(f"p_{w}") / a), F.when(use, F.col(f"o_{w}") / a)
        return F.struct(F.lit(w).alias("window"), F.avg((p - o) * (p - o)).alias("num"), (F.avg(p * p) + F.avg(o * o)).alias("den"))

    g = b.groupBy(day, "threshold").agg(F.array(*[part(w) for w in windows]).alias("_w"), F.count_if("ok").alias("n_ok"),
                                        F.sum("pb").alias("n_pred"), F.sum("ob").alias("n_obs"))
    return g.select(day, "threshold", "n_ok", "n_pred", "n_obs", F.inline("_w"))


def fss_single(days: DataFrame, day="day") -> DataFrame:
    return days.select(day, "threshold", "window", F.when(F.col("den") > 0, 1 - F.col("num") / F.nullif(F.col("den"), F.lit(0.0))).alias("fss"))


def fss_pooled(days: DataFrame) -> DataFrame:
    """Numerators and denominators summed over time before the ratio."""
    g = days.groupBy("threshold", "window").agg(F.sum("num").alias("n"), F.sum("den").alias("d"))
    return g.select("threshold", "window", F.when(F.col("d") > 0, 1 - F.col("n") / F.nullif(F.col("d"), F.lit(0.0))).alias("fss"))


def fss_table(days: DataFrame, min_cells=16) -> DataFrame:
    """Mean of daily scores with the uniform-skill target 0.5 + f0/2; empty days are skipped."""
    d = days.where((F.col("n_ok") >= min_cells) & ((F.col("n_pred") > 0) | (F.col("n_obs") > 0)))
    s = F.when(F.col("den") > 0, 1 - F.col("num") / F.nullif(F.col("den"), F.lit(0.0)))
    g = d.groupBy("threshold", "window").agg(F.avg(s).alias("fss"), F.avg(F.col("n_obs") / F.col("n_ok")).alias("base_rate"), F.count(s).alias("days"))
    return g.withColumn("target", F.col("base_rate") / 2 + 0.5)


def skillful_scale(table: DataFrame) -> DataFrame:
    return table.groupBy("threshold").agg(F.min(F.when(F.col("fss") >= F.col("target"), F.col("window"))).alias("skillful_window"))


# ---- structure ------------------------------------------------------------

def shifted(df: DataFrame, value: str, lag: int, along: str, keys=("day",)) -> Column:
    """Value exactly `lag` cells before along an axis; gaps give NULL."""
    other = "ix" if along == "iy" else "iy"
    w = W.partitionBy(*keys, other).orderBy(along).rangeBetween(-lag, -lag)
    return F.first(value).over(w)


def semivariance(df: DataFrame, value="value", lags=(1, 2, 4, 8), keys=("day",)) -> DataFrame:
    """Mean over (day, direction) of half the mean squared increment at each lag."""
    # One select per axis: all lags of an axis share its shuffle and sort.
    d = df
    for a in ("iy", "ix"):
        steps = {lag: F.col(value) - shifted(df, value, lag, a, keys) for lag in lags}
        d = d.select("*", *[(x * x).alias(f"_{a}{lag}") for lag, x in steps.items()])
    g = d.groupBy(*keys).agg(*[(F.avg(f"_{a}{lag}") * 0.5).alias(f"_{a}{lag}") for lag in lags for a in ("iy", "ix")])
    rows = F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"_{a}{lag}").alias("g")) for lag in lags for a in ("iy", "ix")])
    return g.select(F.inline(rows)).groupBy("lag").agg(F.avg("g").alias("semivariance"), F.count("g").alias("terms"))


def field_energy(df: DataFrame, value="value", keys=("day",)) -> DataFrame:
    """Gradient energy (mean over day and direction), energy and spatial anomaly energy."""
    v = F.col(value)
    d = df
    for a in ("iy", "ix"):
        x = v - shifted(df, value, 1, a, keys)
        d = d.withColumn(f"_g{a}", x * x)
    g = d.groupBy(*keys).agg(F.avg("_giy").alias("gy"), F.avg("_gix").alias("gx"), F.sum(v * v).alias("s2"), F.sum(v).alias("s"), F.count(v).alias("n"))
    r = g.agg(((F.coalesce(F.sum("gy"), F.lit(0.0)) + F.coalesce(F.sum("gx"), F.lit(0.0))) / (F.count("gy") + F.count("gx"))).alias("gradient_energy"),
              (F.sum("s2") / F.sum("n")).alias("energy"), (F.sum(F.col("s2") - F.col("s") * F.col("s") / F.col("n")) / F.sum("n")).alias("anomaly_energy"))
    return r


def seam_index(df: DataFrame, factor: int, value="value", keys=("day",), group=()) -> DataFrame:
    """Mean absolute gradient across block edges over the mean inside blocks."""
    v = F.col(value)
    d = df
    for a in ("iy", "ix"):
        d = d.withColumn(f"_g{a}", F.abs(v - shifted(df, value, 1, a, keys)))
    seam_y, seam_x = F.col("iy") % factor == 0, F.col("ix") % factor == 0

    def mean(cond_y, cond_x):
        n = F.count(F.when(cond_y, F.col("_giy"))) + F.count(F.when(cond_x, F.col("_gix")))
        s = F.coalesce(F.sum(F.when(cond_y, F.col("_giy"))), F.lit(0.0)) + F.coalesce(F.sum(F.when(cond_x, F.col("_gix"))), F.lit(0.0))
        return S.ratio(s, n.cast("double"))

    g = d.groupBy(*group).agg(mean(seam_y, seam_x).alias("edge"), mean(~seam_y, ~seam_x).alias("interior"))
    return g.withColumn("seam_index", S.ratio(F.col("edge"), F.col("interior")))


# ---- spectra --------------------------------------------------------------

@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _fft_rows(re: pd.Series, im: pd.Series) -> pd.Series:
    """FFT of one lattice row or column per array, real parts before imaginary parts."""
    out = []
    for a, b in zip(re, im):
        z = np.fft.fft(np.asarray(a, float) + 1j * np.asarray(b, float))
        out.append(np.concatenate([z.real, z.imag]))
    return pd.Series(out)


def _parts(z: Column) -> Column:
    """Array of (re, im) pairs from the packed transform."""
    n = F.size(z) / 2
    half = n.cast("int")
    return F.arrays_zip(F.slice(z, F.lit(1), half).alias("re"), F.slice(z, half + 1, half).alias("im"))


def power_spectrum(df: DataFrame, nlat: int, nlon: int, value="value", keys=("day",), res_deg=0.05, min_cells=16, taper=True) -> DataFrame:
    """Radially averaged power per key by a separable transform.

    Rows are transformed first, then columns, so no task ever holds a field: a group
    is one row or one column of the lattice.
    """
    k = list(keys)
    m = df.groupBy(*k).agg(F.avg(value).alias("_mu"), F.count(value).alias("_n")).where(F.col("_n") >= min_cells)
    spine = m.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(nlat - 1)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(nlon - 1))))
    d = spine.join(df.select(*k, "iy", "ix", value), [*k, "iy", "ix"], "left")

    def hann(c, n):
        return F.lit(0.5) - F.cos(F.col(c) * (2.0 * math.pi / (n - 1))) * 0.5 if taper else F.lit(1.0)

    work = F.coalesce(F.col(value) - F.col("_mu"), F.lit(0.0)) * hann("iy", nlat) * hann("ix", nlon)
    rows = d.select(*k, "iy", "ix", work.alias("v")).groupBy(*k, "iy").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ix", "v"))), lambda x: x["v"]).alias("re"))
    rows = rows.withColumn("im", F.transform("re", lambda x: F.lit(0.0)))
    rows = rows.select(*k, "iy", _fft_rows("re", "im").alias("z")).select(*k, "iy", F.posexplode(_parts(F.col("z"))).alias("kx", "z"))
    cols = rows.groupBy(*k, "kx").agg(F.array_sort(F.collect_list(F.struct("iy", F.col("z.re").alias("re"), F.col("z.im").alias("im")))).alias("c"))
    cols = cols.select(*k, "kx", _fft_rows(F.transform("c", lambda x: x["re"]), F.transform("c", lambda x: x["im"])).alias("z"))
    cols = cols.select(*k, "kx", F.posexplode(_parts(F.col("z"))).alias("ky", "z"))

    def freq(c, n):
        return F.when(F.col(c) * 2 < n, F.col(c)).otherwise(F.col(c) - n) * (1.0 / n)

    bins = min(nlat, nlon) // 2
    lo, step = 1.0 / max(nlat, nlon), (0.5 - 1.0 / max(nlat, nlon)) / bins
    r = F.sqrt(freq("ky", nlat) * freq("ky", nlat) + freq("kx", nlon) * freq("kx", nlon))
    # The floor can miss an edge by one ulp; comparing with the edges settles it.
    near = F.floor((r - lo) / step).cast("int")
    b = near + F.when(r >= (near + 1) * step + lo, 1).when(r < near * step + lo, -1).otherwise(0)
    b = F.when(r < 0.5, b).otherwise(F.lit(bins))
    p = cols.select(*k, b.alias("bin"), (F.col("z.re") * F.col("z.re") + F.col("z.im") * F.col("z.im")).alias("p"))
    p = p.where(F.col("bin").between(0, bins - 1)).groupBy(*k, "bin").agg(F.avg("p").alias("power")).where("power > 0")
    return p.withColumn("wavelength_km", F.lit(res_deg * 111.0) / ((F.col("bin") + 0.5) * step + lo))


def spectral_summary(spectra: DataFrame, name="name", truth="truth") -> DataFrame:
    """Day-mean power per field and its ratio to the truth."""
    m = spectra.groupBy(name, "bin", "wavelength_km").agg(F.avg("power").alias("power"))
    t = m.where(F.col(name) == truth).select("bin", F.col("power").alias("truth_power"))
    return m.where(F.col(name) != truth).join(t, "bin").withColumn("power_ratio", S.ratio(F.col("power"), F.col("truth_power")))


def effective_resolution(summary: DataFrame, name="name", tolerance=2.0) -> DataFrame:
    """Last wavelength before the ratio first leaves [1/tolerance, tolerance], from large scales down."""
    d = summary.where(F.col("power_ratio").isNotNull())
    w = W.partitionBy(name).orderBy(F.desc("wavelength_km"))
    out = ~F.col("power_ratio").between(1.0 / tolerance, tolerance)
    d = d.withColumn("_prev", F.coalesce(F.lag("wavelength_km").over(w), F.col("wavelength_km"))).withColumn("_out", out)
    first = F.max_by("_prev", F.when(F.col("_out"), F.col("wavelength_km")))
    return d.groupBy(name).agg(F.coalesce(F.when(F.count_if("_out") > 0, first), F.min("wavelength_km")).alias("effective_resolution_km"))


# ---- alignment ------------------------------------------------------------

def spatial_variants(nlat: int, nlon: int, max_shift=2, wrap=False) -> list[tuple[str, Column, Column]]:
    """Misregistration hypotheses as target keys of a cell."""
    iy, ix = F.col("iy"), F.col("ix")
    fy, fx = F.lit(nlat - 1) - iy, F.lit(nlon - 1) - ix
    v = [("identity", iy, ix), ("lat_flip", fy, ix), ("lon_flip", iy, fx), ("lat_lon_flip", fy, fx)]
    if nlat == nlon:
        v.append(("transpose", ix, iy))
    for c in range(1, max_shift + 1):
        for s in (c, -c):
            my, mx = iy + s, ix + s
            v.append((f"lat_shift{s:+d}", F.pmod(my, F.lit(nlat)) if wrap else my, ix))
            v.append((f"lon_shift{s:+d}", iy, F.pmod(mx, F.lit(nlon)) if wrap else mx))
    return v


def misregistration(field: DataFrame, reference: DataFrame, nlat: int, nlon: int, value: str, ref: str, max_shift=2, wrap=False, margin=0, day="day") -> DataFrame:
    """Mean daily pattern correlation of every variant of a field against a reference."""
    keys = F.array(*[F.struct(F.lit(n).alias("variant"), y.cast("int").alias("iy"), x.cast("int").alias("ix")) for n, y, x in spatial_variants(nlat, nlon, max_shift, wrap)])
    f = field.select(day, F.col(value).alias("_v"), F.explode(keys).alias("k")).select(day, "_v", "k.*")
    f = f.where(F.col("iy").between(margin, nlat - 1 - margin) & F.col("ix").between(margin, nlon - 1 - margin))
    j = f.join(reference.select(day, "iy", "ix", F.col(ref).alias("_r")), [day, "iy", "ix"])
    g = pattern_correlation(j, "_v", "_r", day, ("variant",))
    return g.groupBy("variant").agg(F.avg("corr").alias("corr"), F.count("corr").alias("days"))


def lagged_pattern(field: DataFrame, reference: DataFrame, lags, value: str, ref: str, shift_day, day="day") -> DataFrame:
    """Pooled spatial-anomaly correlation at day shifts; shift_day(column, lag) moves a label."""
    f = field.select(day, "iy", "ix", F.col(value).alias("_v"), F.explode(F.array(*[F.lit(int(x)) for x in lags])).alias("lag"))
    f = f.withColumn(day, shift_day(F.col(day), F.col("lag")))
    j = f.join(reference.select(day, "iy", "ix", F.col(ref).alias("_r")), [day, "iy", "ix"])
    # Within-day sums give the anomaly moments without a window over the day.
    a, b = F.col("_v"), F.col("_r")
    g = j.groupBy("lag", day).agg(F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab")).where("n >= 3")
    n = F.col("n")
    t = g.groupBy("lag").agg(F.sum("n").alias("n"), F.sum(F.col("sab") - F.col("sa") * F.col("sb") / n).alias("ab"),
                             F.sum(F.col("saa") - F.col("sa") * F.col("sa") / n).alias("aa"), F.sum(F.col("sbb") - F.col("sb") * F.col("sb") / n).alias("bb"))
    return t.select("lag", "n", F.when((F.col("n") >= 10) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("corr"))


def alignment_label(temporal: DataFrame, spatial: DataFrame, gain=0.05) -> DataFrame:
    """A signal needs a non-trivial best variant that gains at least `gain` correlation."""
    t = temporal.agg(F.max_by(F.struct("lag", "corr"), "corr").alias("b"), F.max(F.when(F.col("lag") == 0, F.col("corr"))).alias("base")).select(
        ((F.col("b.lag") != 0) & (F.col("b.corr") - F.col("base") >= gain)).alias("timing"))
    s = spatial.agg(F.max_by(F.struct("variant", "corr"), "corr").alias("b"), F.max(F.when(F.col("variant") == "identity", F.col("corr"))).alias("base"))
    s = s.select(F.col("b.variant").alias("best_variant"), ((F.col("b.variant") != "identity") & (F.col("b.corr") - F.col("base") >= gain)).alias("space"))
    s = s.withColumn("timing", t.scalar())
    # The names of the diagnoses.
    label = (F.when(F.col("timing") & F.col("space"), "mixed_timing_and_spatial_signal").when(F.col("timing"), "possible_timing_signal")
             .when(F.col("space"), "possible_spatial_displacement").otherwise("no_clear_fixed_lag_or_shift"))
    return s.select("best_variant", label.alias("diagnosis"))


# ---- station baselines and composites -------------------------------------

def idw(assimilated: DataFrame, withheld: DataFrame, stations: DataFrame, value: str, power=2.0, key="station_id", date="date", block: int = 1024) -> DataFrame:
    """Inverse-distance prediction at every withheld station for every date of the gauges, from all gauges with a value that day.

    Distances are planar degrees, longitudes scaled by the cosine of the mean latitude of `stations`. Gauges of equal
    coordinates travel as one place with the sum and count of their values of a day, and withheld stations of equal
    coordinates share a prediction, so the pairs grow with the places, not with the stations. The gauge places of a
    day are dealt into chunks and the withheld places into blocks of about `block` rows, as many as the tables ask
    for; a chunk and a block meet on (date, chunk, block), so tasks grow with days and places and no key with the
    table. Weights are summed per place and date before the shuffle. A day without a value anywhere has a NULL
    prediction and no gauges.
    """
    here = stations.select(F.col(key).alias("_s"), F.col("lat").cast("double").alias("_la"), F.col("lon").cast("double").alias("_lo"))
    shrink = stations.agg(F.cos(F.radians(F.avg("lat"))).alias("c")).scalar()
    many = lambda n: F.greatest(F.ceil(n / block), F.lit(1)).cast("int")
    g = assimilated.where(F.col(value).isNotNull()).select(F.col(key).alias("_s"), date, F.col(value).cast("double").alias("_v")).join(here, "_s")
    g = cut_lineage(g.groupBy(date, "_la", "_lo").agg(F.sum("_v").alias("_v"), F.count("_v").alias("_m")))
    days = assimilated.select(date).distinct().join(g.groupBy(date).agg(many(F.count("*")).alias("_n")), date, "left")
    days = cut_lineage(days.select(date, F.coalesce("_n", F.lit(1)).alias("_n")))
    own = withheld.select(F.col(key), F.col("lat").alias("_y"), F.col("lon").alias("_x"))
    at = own.select("_y", "_x").distinct()
    blocks = at.agg(many(F.count("*")).alias("n")).scalar()
    g = g.join(days, date).withColumn("_c", F.pmod(F.xxhash64("_la", "_lo"), "_n").cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_n")
    at = at.withColumn("_b", F.pmod(F.xxhash64("_y", "_x"), blocks).cast("int"))
    at = at.withColumn("_d", F.explode(days.agg(F.collect_list(F.struct(date, "_n"))).scalar())).select("_y", "_x", "_b", "_d.*")
    at = at.withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    d = F.sqrt(F.pow((F.col("_lo") - F.col("_x")) * shrink, 2) + F.pow(F.col("_la") - F.col("_y"), 2))
    w = F.when(F.col("_v").isNotNull(), F.pow(F.greatest(d, F.lit(1e-6)), F.lit(-power)))
    out = at.join(g, [date, "_c", "_b"], "left").groupBy("_y", "_x", date).agg(
        S.ratio(F.sum(F.col("_v") * w), F.sum(F.col("_m") * w)).alias("idw"), F.coalesce(F.sum("_m"), F.lit(0)).alias("n_gauges"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("_y", "_x")]
    return own.alias("a").join(out.alias("b"), same).select(f"a.{key}", date, "idw", "n_gauges")


def scale_ladder(df: DataFrame, factors, area: Column | None = None, pred="pred", obs="obs", keys=("day",), group=()) -> DataFrame:
    """Scores of the block mean and of the residual at every factor.

    A row meets each factor once, and blocks keep only their sums: what is left of a cell below the block mean has
    the squares of the cell less those of the mean, so no row is shuffled with its block.
    """
    p, o = F.col(pred), F.col(obs)
    d = paired(df, pred, obs).withColumn("factor", F.explode(F.array(*[F.lit(int(f)) for f in factors])))
    block = [F.floor(F.col(c) / F.col("factor")).alias(n) for c, n in (("iy", "by"), ("ix", "bx"))]
    b = d.groupBy(*group, *keys, "factor", *block).agg(F.count("*").alias("n"), F.avg(p).alias("_p"), F.avg(o).alias("_o"), F.sum(p * p).alias("_pp"), F.sum(o * o).alias("_oo"), F.sum((p - o) * (p - o)).alias("_dd"))
    n, e = F.col("n"), F.col("_p") - F.col("_o")
    whole = {"_pp": n * F.col("_p") * F.col("_p"), "_oo": n * F.col("_o") * F.col("_o"), "_dd": n * e * e}

    def s(name, bias, of):
        mean = {k: F.sum(of(k)) / F.sum("n") for k in whole}
        return [F.sqrt(mean["_dd"]).alias(f"{name}_rmse"), bias.alias(f"{name}_bias"), S.ratio(mean["_pp"], mean["_oo"]).alias(f"{name}_energy_ratio"), (1 - S.ratio(mean["_dd"], mean["_oo"])).alias(f"{name}_skill")]

    return b.groupBy(*group, "factor").agg(F.sum("n").alias("n"), *s("block", F.sum(n * e) / F.sum("n"), lambda k: whole[k]),
                                           *s("residual", F.lit(0.0), lambda k: F.greatest(F.col(k) - whole[k], F.lit(0.0))))


def daily_residual_skill(df: DataFrame, factor: int, pred="pred", obs="obs", day="day") -> DataFrame:
    """1 - mse/energy of the residual below the block scale, on fully valid blocks only."""
    d = GR.with_blocks(paired(df, pred, obs), factor)
    w = W.partitionBy(day, "by", "bx")
    d = d.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == factor * factor)
    r, o = F.col(pred) - F.avg(pred).over(w), F.col(obs) - F.avg(obs).over(w)
    d = d.select(day, r.alias("_r"), o.alias("_o"))
    e = F.col("_r") - F.col("_o")
    return d.groupBy(day).agg((1 - S.ratio(F.avg(e * e), F.avg(F.col("_o") * F.col("_o")))).alias("skill"), F.count("*").alias("n"))


def subgrid_report(df: DataFrame, factor: int, candidate: str, pred="pred", obs="obs", keys=("day",)) -> DataFrame:
    """Residual variance ratio, coherent fraction and subgrid fraction per candidate."""
    d = GR.with_blocks(paired(df, pred, obs), factor)
    w = W.partitionBy(candidate, *keys, "by", "bx")
    d = d.withColumn("_r", F.col(pred) - F.avg(pred).over(w)).withColumn("_o", F.col(obs) - F.avg(obs).over(w))
    r, o = F.col("_r"), F.col("_o")
    g = d.groupBy(candidate).agg(F.count("*").alias("n"), S.ratio(F.avg(r * r), F.avg(o * o)).alias("residual_variance_ratio"), safe_corr("_r", "_o").alias("residual_corr"),
                                 S.ratio(F.avg(r * r), F.var_pop(pred)).alias("subgrid_fraction"), F.sqrt(F.avg((r - o) * (r - o))).alias("increment_rms"))
    return g.withColumn("coherent_fraction", F.col("residual_corr") * F.col("residual_corr"))


def objects(df: DataFrame, flag: str, keys=("day",), max_rounds=64) -> DataFrame:
    """8-connected components by hooking and pointer jumping.

    Every round gives a node the smallest of its neighbours' labels, of its label's
    label, and of what the nodes carrying its name as label have seen, so rounds grow
    with the logarithm of an object's size. Rounds are cut through a written table,
    and the loop ends when no label changes.
    """
    k = list(keys)
    cells = df.where(F.col(flag)).select(*k, "iy", "ix", (F.col("iy").cast("bigint") * 2 ** 31 + F.col("ix")).alias("node"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    edges = cells.withColumn("_o", around).select(*k, "node", (F.col("iy") + F.col("_o.y")).alias("iy"), (F.col("ix") + F.col("_o.x")).alias("ix"))
    edges = cut_lineage(edges.join(cells.withColumnRenamed("node", "peer"), [*k, "iy", "ix"]).select(*k, "node", "peer"))
    lab = cut_lineage(edges.groupBy(*k, "node").agg(F.min("peer").alias("label")))
    for _ in range(max_rounds):
        near = edges.join(lab.select(*k, F.col("node").alias("peer"), "label"), [*k, "peer"]).groupBy(*k, "node").agg(F.min("label").alias("near"))
        seen = near.join(lab, [*k, "node"])
        hook = seen.groupBy(*k, F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        jump = lab.select(*k, F.col("node").alias("near"), F.col("label").alias("far"))
        best = seen.join(jump, [*k, "near"]).join(hook, [*k, "node"], "left").select(*k, "node", "label", F.least("near", "far", "hook").alias("best"))
        new = cut_lineage(best.select(*k, "node", F.col("best").alias("label"), (F.col("best") != F.col("label")).alias("moved")))
        lab = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return lab.select(*k, F.floor(F.col("node") / 2 ** 31).cast("int").alias("iy"), (F.col("node") % 2 ** 31).cast("int").alias("ix"), "label")


def sal(df: DataFrame, nlat: int, nlon: int, pred="pred", obs="obs", day="day", thr_factor=1 / 15) -> DataFrame:
    """Structure, amplitude and location per day; objects exceed thr_factor times the wet p95."""
    long = df.select(day, "iy", "ix", F.col(pred).alias("pred"), F.col(obs).alias("obs")).unpivot([day, "iy", "ix"], ["pred", "obs"], "source", "v")
    long = long.withColumn("v", F.coalesce(F.col("v"), F.lit(0.0)))
    k = [day, "source"]
    whole = long.groupBy(*k).agg(F.avg("v").alias("mean"), F.sum("v").alias("mass"), S.ratio(F.sum(F.col("v") * F.col("iy")), F.sum("v")).alias("cy"),
                                 S.ratio(F.sum(F.col("v") * F.col("ix")), F.sum("v")).alias("cx"), (F.percentile(F.when(F.col("v") > 0, F.col("v")), 0.95) * thr_factor).alias("thr"))
    flagged = long.join(whole.select(*k, "thr"), k).withColumn("hit", F.coalesce(F.col("v") >= F.col("thr"), F.lit(False)) & (F.col("v") > 0))
    lab = objects(flagged, "hit", k)
    o = flagged.join(lab, [*k, "iy", "ix"]).groupBy(*k, "label").agg(F.sum("v").alias("m"), F.max("v").alias("top"), (F.sum(F.col("v") * F.col("iy")) / F.sum("v")).alias("oy"),
                                                                    (F.sum(F.col("v") * F.col("ix")) / F.sum("v")).alias("ox"))
    o = o.join(whole.select(*k, "cy", "cx"), k)
    dist = F.sqrt((F.col("oy") - F.col("cy")) * (F.col("oy") - F.col("cy")) + (F.col("ox") - F.col("cx")) * (F.col("ox") - F.col("cx")))
    per = o.groupBy(*k).agg((F.sum(F.col("m") * F.col("m") / F.col("top")) / F.sum("m")).alias("volume"), (F.sum(F.col("m") * dist) / F.sum("m")).alias("r"))
    a = whole.join(per, k, "left").groupBy(day).agg(*[F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{s}_{c}") for s in ("pred", "obs") for c in ("mean", "cy", "cx", "volume", "r")])
    d_max = math.hypot(nlat, nlon)

    def rel(c):
        p, q = F.col(f"pred_{c}"), F.col(f"obs_{c}")
        return S.ratio((p - q) * 2, p + q)
    dy, dx = F.col("pred_cy") - F.col("obs_cy"), F.col("pred_cx") - F.col("obs_cx")
    loc = F.sqrt(dy * dy + dx * dx) / d_max + F.abs(F.col("pred_r") - F.col("obs_r")) * 2 / d_max
    return a.select(day, rel("volume").alias("structure"), rel("mean").alias("amplitude"), loc.alias("location"))


def single_day_comparison(df: DataFrame, gauges: DataFrame, lattice, factor: int, truth="value", background="ref", analysis="an", day="day") -> DataFrame:
    """Field and within-block correlations, RMSE gain, and the near-gauge over far increment ratio."""
    d = GR.with_blocks(df, factor)
    w = W.partitionBy(day, "by", "bx")
    for n, c in (("_t", truth), ("_b", background), ("_a", analysis)):
        d = d.withColumn(n, F.col(c) - F.avg(c).over(w))
    cells = J.nearest_cell(gauges, lattice).select("iy", "ix").distinct()

    def around(h, name):
        o = F.sequence(F.lit(-h), F.lit(h))
        e = cells.withColumn("_dy", F.explode(o)).withColumn("_dx", F.explode(o))
        return e.select((F.col("iy") + F.col("_dy")).alias("iy"), (F.col("ix") + F.col("_dx")).alias("ix")).distinct().withColumn(name, F.lit(True))

    d = d.join(around(1, "_near"), ["iy", "ix"], "left").join(around(5, "_reach"), ["iy", "ix"], "left")
    inc = F.abs(F.col(analysis) - F.col(background))

    def rmse(a):
        return F.sqrt(F.avg((F.col(a) - F.col(truth)) * (F.col(a) - F.col(truth))))
    g = d.groupBy(day).agg(rmse(analysis).alias("field_rmse"), rmse(background).alias("background_rmse"), safe_corr(analysis, truth).alias("field_corr"), safe_corr(background, truth).alias("background_corr"),
                           safe_corr("_a", "_t").alias("subgrid_corr"), safe_corr("_b", "_t").alias("background_subgrid_corr"),
                           S.ratio(F.avg(F.when(F.col("_near"), inc)), F.avg(F.when(F.col("_reach").isNull(), inc))).alias("bullseye"))
    return g.withColumn("rmse_gain_percent", (F.col("background_rmse") - F.col("field_rmse")) * 100.0 / F.greatest("background_rmse", F.lit(1e-9)))


def field_verification(df: DataFrame, keys=("day",), members="members", truth="truth", wet=WET_MM) -> DataFrame:
    """RMSE, bias, wet-share error, maxima and mean spread of the ensemble mean."""
    from rainloom.functions import ensemble as EN

    d = df.where(EN.usable(members, truth)).withColumn("_m", EN.mean(members)).withColumn("_s", EN.std(members))
    e = F.col("_m") - F.col(truth)
    return d.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (share(F.col("_m") >= wet) - share(F.col(truth) >= wet)).alias("wet_share_error"),
                                F.max("_m").alias("max_pred"), F.max(truth).alias("max_truth"), F.avg("_s").alias("mean_spread"))
