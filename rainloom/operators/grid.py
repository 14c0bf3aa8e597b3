"""Regridding and nested block algebra over long fields (day, iy, ix, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.functions import scalar as S
from rainloom.functions.lattice import Lattice
from rainloom.operators import joins as J
from rainloom.operators.checks import guard


def block(c: str, factor: int) -> Column:
    return F.floor(F.col(c) / factor).cast("int")


def with_blocks(df: DataFrame, factor: int) -> DataFrame:
    return df.withColumn("by", block("iy", factor)).withColumn("bx", block("ix", factor))


def _block_window(keys):
    return W.partitionBy(*keys, "by", "bx")


# ---- axes and gradients ---------------------------------------------------

def axis_edges(axis: DataFrame, coord: str, keys=()) -> DataFrame:
    """Cell edges halfway between centres, extrapolated at both ends (one axis per group)."""
    w = W.partitionBy(*keys).orderBy(coord)
    c, before, after = F.col(coord), F.lag(coord).over(w), F.lead(coord).over(w)
    low = F.coalesce((before + c) / 2, c - (after - c) / 2)
    high = F.coalesce((after + c) / 2, c + (c - before) / 2)
    return axis.withColumn("edge_low", low).withColumn("edge_high", high)


def index_gradient(df: DataFrame, value: str, along: str, across, out: str) -> DataFrame:
    """Centred difference in index units, one-sided at the ends."""
    w = W.partitionBy(*across).orderBy(along)
    v, i = F.col(value), F.col(along)
    va, vb = F.coalesce(F.lag(v).over(w), v), F.coalesce(F.lead(v).over(w), v)
    ia, ib = F.coalesce(F.lag(i).over(w), i), F.coalesce(F.lead(i).over(w), i)
    return df.withColumn(out, F.coalesce((vb - va) / F.nullif(ib - ia, F.lit(0)), F.lit(0.0)))


def terrain_ascent(wind: DataFrame, elevation: DataFrame) -> DataFrame:
    """u * dz/dlon + v * dz/dlat; the static gradient table is joined on the cell."""
    g = index_gradient(elevation, "z", "ix", ["iy"], "gx")
    g = index_gradient(g, "z", "iy", ["ix"], "gy")
    return wind.join(g.select("iy", "ix", "gx", "gy"), ["iy", "ix"]).withColumn(
        "ascent", F.col("u") * F.col("gx") + F.col("v") * F.col("gy"))


# ---- regridding -----------------------------------------------------------

def overlap_weights(source: DataFrame, target: DataFrame, source_id: str, target_id: str, coord: str,
                    latitude: bool = False, width: float = 1.0) -> DataFrame:
    """Conservative 1-D weights: overlap over the covered width of the target cell.

    A target cell without any source keeps one row with coverage zero.
    """
    def edges(df, i, p):
        e = axis_edges(df.select(F.col(i), F.col(coord)), coord)
        lo, hi = F.col("edge_low"), F.col("edge_high")
        return e.select(F.col(i), lo.alias(f"{p}lo"), hi.alias(f"{p}hi"))

    def measure(c):
        return F.sin(F.radians(c)) if latitude else c

    j = J.interval_join(edges(target, target_id, "t"), edges(source, source_id, "s"), "tlo", "thi", "slo", "shi", width)
    ov = measure(F.least("thi", "shi")) - measure(F.greatest("tlo", "slo"))
    full = measure(F.col("thi")) - measure(F.col("tlo"))
    j = j.select(target_id, source_id, ov.alias("overlap"), full.alias("full"))
    w = W.partitionBy(target_id)
    out = j.withColumn("_c", F.sum("overlap").over(w)).select(
        target_id, source_id, (F.col("overlap") / F.col("_c")).alias("weight"),
        (F.col("_c") / F.col("full")).alias("coverage"))
    return target.select(target_id).join(out, target_id, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def require_covered(weights: DataFrame) -> DataFrame:
    """Stop the job when a target cell is covered by less than 1 - 1e-6."""
    return weights.where(guard(F.col("coverage") < 1 - 1e-6, F.lit("source grid does not cover target cell")))


def conservative_regrid(field: DataFrame, wy: DataFrame, wx: DataFrame, value="value", keys=("day",)) -> DataFrame:
    """Area remap of rain: weight tables are axis-sized, so one aggregation shuffles.

    A source value that is missing or not finite stops the job: the sum of the rest would lose its rain unseen.
    """
    raw = F.col(value).cast("double")
    field = field.where(guard(raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf")), F.lit("source field has non-finite values")))
    v = S.clip(value, 0)
    j = field.join(wy.select("iy", "ty", F.col("weight").alias("_wy")), "iy").join(
        wx.select("ix", "tx", F.col("weight").alias("_wx")), "ix")
    return j.groupBy(*keys, "ty", "tx").agg(F.sum(v * F.col("_wy") * F.col("_wx")).alias(value))


def coverage_interpolate(field: DataFrame, points: DataFrame, lattice: Lattice, value="value", key="station_id",
                         days: DataFrame | None = None) -> DataFrame:
    """Bilinear value over bilinear coverage; unsupported point-days give 0 and 0."""
    v = F.col(value)
    ok = field.withColumn(value, F.when((v >= 0) & (v <= 1000), v))
    s = J.bilinear_sample(ok, points, lattice, value, point_key=key, missing="zero")
    spine = J.spread_over(points.select(key), field.select("day") if days is None else days, "day")
    out = spine.join(s, [key, "day"], "left")
    cov = F.coalesce(F.col("coverage"), F.lit(0.0))
    return out.select(key, "day", F.when(cov > 1e-6, F.greatest(F.col(value) / F.nullif(cov, F.lit(0.0)), F.lit(0.0)))
                      .otherwise(F.lit(0.0)).alias(value), F.least(cov, F.lit(1.0)).alias("coverage"))


def nearest_regrid(field: DataFrame, source: Lattice, target_cells: DataFrame, value="value", keys=("day",)) -> DataFrame:
    """Value of the nearest source centre for every target cell (lat, lon columns)."""
    t = target_cells.withColumn("iy", F.floor(source.row("lat") + 0.5).cast("int")).withColumn(
        "ix", F.floor(source.column("lon") + 0.5).cast("int"))
    return field.select(*keys, "iy", "ix", value).join(t, ["iy", "ix"])


def replicate_driver(field: DataFrame, source: Lattice, target_cells: DataFrame, target_res: float, value="value") -> DataFrame:
    """Place a coarse driver on a finer lattice by replication; a finer driver is refused."""
    if source.res < target_res - 1e-9:
        raise ValueError("driver is finer than the lattice it would be replicated on")
    return nearest_regrid(field, source, target_cells, value)


def bin_average(field: DataFrame, source: Lattice, target: Lattice, value="value", keys=("day",)) -> DataFrame:
    """Centre-bin average onto coarser cells, weighted by cos(lat), missing ignored."""
    f = field.withColumn("_lat", source.lat()).withColumn("_lon", source.lon())
    ty = F.floor((F.col("_lat") - target.lat_min) / target.res).cast("int")
    tx = F.floor((F.col("_lon") - target.lon_min) / target.res).cast("int")
    w = F.when(F.col(value).isNotNull(), F.cos(F.radians("_lat")))
    f = f.withColumn("ty", ty).withColumn("tx", tx).where(
        F.col("ty").between(0, target.nlat - 1) & F.col("tx").between(0, target.nlon - 1))
    return f.groupBy(*keys, "ty", "tx").agg((F.sum(F.col(value) * w) / F.sum(w)).alias(value))


# ---- block algebra --------------------------------------------------------

def block_mean(df: DataFrame, factor: int, values=("value",), keys=("day",), min_fraction: float = 0.0, how="avg") -> DataFrame:
    """Block reduction; a block below the valid fraction is missing."""
    fn = {"avg": F.avg, "min": F.min, "rms": lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))}[how]
    aggs = []
    for v in values:
        enough = F.count(v) >= max(1, math.ceil(min_fraction * factor * factor - 1e-9))
        aggs.append(F.when(enough, fn(v)).alias(v))
    return with_blocks(df, factor).groupBy(*keys, "by", "bx").agg(*aggs, F.count(values[0]).alias("n_valid"))


def area_block_mean(df: DataFrame, factor: int, area: Column, threshold: float, value="value", keys=("day",), total_area=None) -> DataFrame:
    """Area-weighted block mean (0 when dropped), retained flag and valid-area fraction."""
    d = with_blocks(df, factor).withColumn("_a", area)
    ok = F.col(value).isNotNull()
    g = d.groupBy(*keys, "by", "bx").agg(
        F.sum(F.when(ok, F.col("_a") * F.col(value))).alias("_n"), F.sum(F.when(ok, F.col("_a"))).alias("_v"),
        (F.sum("_a") if total_area is None else total_area).alias("_t"))
    frac = F.coalesce(F.col("_v"), F.lit(0.0)) / F.col("_t")
    kept = (frac >= threshold) & (frac > 0)
    return g.select(*keys, "by", "bx", F.when(kept, F.col("_n") / F.nullif(F.col("_v"), F.lit(0.0))).otherwise(F.lit(0.0)).alias(value),
                    kept.alias("retained"), frac.alias("valid_fraction"))


def upsample(coarse: DataFrame, fine_cells: DataFrame, factor: int, keys=("day",)) -> DataFrame:
    """Repeat each block value into its cells: an equi join on the block key."""
    return with_blocks(fine_cells, factor).join(coarse, [*keys, "by", "bx"] if all(k in fine_cells.columns for k in keys) else ["by", "bx"])


def scale_decompose(df: DataFrame, factor: int, value="value", keys=("day",)) -> DataFrame:
    """Block mean and residual on the cells; one shuffle on (day, block)."""
    d = with_blocks(df, factor)
    return d.withColumn("coarse", F.avg(value).over(_block_window(keys))).withColumn("residual", F.col(value) - F.col("coarse"))


def relative_anomaly(df: DataFrame, factor: int, area: Column, value="value", keys=("day",)) -> DataFrame:
    d = with_blocks(df, factor).withColumn("_a", F.when(F.col(value).isNotNull(), area))
    w = _block_window(keys)
    m = F.sum(F.col("_a") * F.col(value)).over(w) / F.sum("_a").over(w)
    return d.withColumn("block_mean", m).withColumn(
        "relative", F.when(F.col("block_mean") > 0, F.col(value) / F.col("block_mean") - 1)).drop("_a")


def eligible(df: DataFrame, factor: int, fraction: float = 1.0, value="value", keys=("day",)) -> DataFrame:
    """Flag valid cells of blocks with at least ceil(fraction * factor^2) valid cells."""
    n = F.count(value).over(_block_window(keys))
    need = math.ceil(fraction * factor * factor - 1e-9)
    return with_blocks(df, factor).withColumn("eligible", F.col(value).isNotNull() & (n >= need))


def geometric_factor(factor: int, res_deg: float, latitude: float, corr_km: float, km_per_degree: float = 111.32) -> float:
    """Variance kept by a block mean under exponential correlation.

    Sums over cell offsets with their multiplicity instead of all cell pairs.
    """
    dy = res_deg * km_per_degree
    dx = dy * math.cos(math.radians(latitude))
    s = sum((factor - abs(i)) * (factor - abs(j)) * math.exp(-math.hypot(i * dy, j * dx) / corr_km)
            for i in range(1 - factor, factor) for j in range(1 - factor, factor))
    return s / factor ** 4


def block_error(df: DataFrame, factor: int, geometric: float, error="error", keys=("day",)) -> DataFrame:
    """Propagated error of a block mean, correlated and independent."""
    r = block_mean(df, factor, (error,), keys, how="rms")
    return r.select(*keys, "by", "bx", "n_valid", F.col(error).alias("rms"), (F.col(error) * math.sqrt(geometric)).alias("sigma"),
                    (F.col(error) / F.sqrt(F.nullif(F.col("n_valid"), F.lit(0)))).alias("sigma_independent"))


def coarse_wet(df: DataFrame, factor: int, threshold: float, value="value", keys=("day",)) -> DataFrame:
    return with_blocks(df, factor).groupBy(*keys, "by", "bx").agg(
        F.coalesce(F.bool_or(F.col(value) >= threshold), F.lit(False)).alias("wet"))


def allocation_weights(df: DataFrame, factor: int, area: Column, wet_mm=0.1, floor=1e-6, base: str | None = None,
                       value="value", keys=("day",)) -> DataFrame:
    """log(fine / base) minus its area-weighted mean over the wet cells of the block; dry cells are 0."""
    d = with_blocks(df, factor).withColumn("_a", F.when(F.col(value).isNotNull(), area))
    w = _block_window(keys)
    v = F.greatest(F.col(value), F.lit(0.0))
    b = F.col(base) if base else F.sum(F.col("_a") * v).over(w) / F.sum("_a").over(w)
    d = d.withColumn("_base", b).withColumn("wet", F.coalesce(v >= wet_mm, F.lit(False)))
    d = d.withColumn("_raw", F.log(F.greatest(v / F.greatest(F.col("_base"), F.lit(floor)), F.lit(floor))))
    wa = F.when(F.col("wet"), F.col("_a"))
    centre = F.sum(wa * F.col("_raw")).over(w) / F.sum(wa).over(w)
    return d.withColumn("log_weight", F.when(F.col("wet"), F.col("_raw") - centre).otherwise(F.lit(0.0))).drop("_a", "_base", "_raw")


def lift(coarse: DataFrame, cells: DataFrame, factor: int, nby: int, nbx: int, value="value", keys=("day",)) -> DataFrame:
    """Bilinear lift of block values to cells, edges repeated."""
    def place(c, n):
        pos = F.greatest((F.col(c) + 0.5) / factor - 0.5, F.lit(0.0))
        lo = F.floor(pos).cast("int")
        return F.least(lo, F.lit(n - 1)), F.least(lo + 1, F.lit(n - 1)), pos - lo
    y0, y1, wy = place("iy", nby)
    x0, x1, wx = place("ix", nbx)
    four = F.array(*[F.struct(y.alias("by"), x.alias("bx"), w.alias("w")) for y, x, w in (
        (y0, x0, (1 - wy) * (1 - wx)), (y0, x1, (1 - wy) * wx), (y1, x0, wy * (1 - wx)), (y1, x1, wy * wx))])
    c = cells.select("iy", "ix").distinct().withColumn("_k", F.explode(four)).select("iy", "ix", "_k.*")
    j = coarse.select(*keys, "by", "bx", F.coalesce(F.col(value), F.lit(0.0)).alias(value)).join(c, ["by", "bx"])
    return j.groupBy(*keys, "iy", "ix").agg(F.sum(F.col("w") * F.col(value)).alias("lifted"))


def smooth_upsample(coarse: DataFrame, cells: DataFrame, factor: int, area: Column, nby: int, nbx: int,
                    iterations: int = 2, value="value", keys=("day",)) -> DataFrame:
    """Continuous field whose area-weighted block means equal the coarse amounts."""
    k = [*keys, "by", "bx"]
    target = coarse.select(*k, F.coalesce(F.col(value), F.lit(0.0)).alias("_target"))

    def ratios(base):
        """Correction per block of the target, with whether a ratio can be taken."""
        m = base.groupBy(*k).agg((F.sum(area * F.col("base")) / F.sum(area)).alias("_mean"))
        usable = F.coalesce(F.col("_mean") > 1e-12, F.lit(False))
        return target.join(m, k, "left").select(
            *k, "_target", usable.alias("_ok"), F.when(usable, F.col("_target") / F.nullif(F.col("_mean"), F.lit(0.0))).otherwise(F.lit(1.0)).alias("_r"))

    base = with_blocks(lift(target, cells, factor, nby, nbx, "_target", keys), factor).withColumnRenamed("lifted", "base")
    for _ in range(iterations):
        r = ratios(base).withColumn("_r", F.least(F.greatest("_r", F.lit(0.0)), F.lit(1e3)))
        up = lift(r, cells, factor, nby, nbx, "_r", keys)
        base = base.join(up, [*keys, "iy", "ix"]).withColumn("base", F.col("base") * F.col("lifted")).drop("lifted")
    out = base.join(ratios(base), k)
    block_constant = F.col("_target")
    return out.select(*keys, "iy", "ix", "by", "bx", F.when(F.col("_ok"), F.col("base") * F.col("_r")).otherwise(block_constant).alias(value)) \
        if iterations else out.select(*keys, "iy", "ix", "by", "bx", block_constant.alias(value))


def static_predictors(cells: DataFrame, lattice: Lattice, elevation="elev", land="land") -> DataFrame:
    """Scaled root elevation, land-standardised slope and position encodings of a static map."""
    m = lattice.res * 111_320.0
    d = index_gradient(cells, elevation, "iy", ["ix"], "_gy")
    d = index_gradient(d, elevation, "ix", ["iy"], "_gx")
    gy, gx = F.col("_gy") / m, F.col("_gx") / (F.cos(F.radians(lattice.lat())) * m)
    d = d.withColumn("slope_raw", F.sqrt(gy * gy + gx * gx)).withColumn("_e", F.sqrt(F.greatest(F.col(elevation), F.lit(0.0))))
    s = d.agg(F.min("_e").alias("e0"), F.max("_e").alias("e1"), F.avg(F.when(F.col(land), F.col("slope_raw"))).alias("mu"),
              F.stddev_pop(F.when(F.col(land), F.col("slope_raw"))).alias("sd"))
    s = s.select(F.struct("*").alias("s")).scalar()
    u = F.col("ix") / float(lattice.nlon - 1) * math.pi
    v = F.col("iy") / float(lattice.nlat - 1) * math.pi
    return d.withColumn("_s", s).select(
        "iy", "ix", ((F.col("_e") - F.col("_s.e0")) / (F.col("_s.e1") - F.col("_s.e0") + 1e-6)).alias("elevation"),
        F.when(F.col(land), (F.col("slope_raw") - F.col("_s.mu")) / (F.col("_s.sd") + 1e-6)).otherwise(F.lit(0.0)).alias("slope"),
        F.col(land).cast("int").alias("land"), F.sin(u).alias("sin_u"), F.cos(u).alias("cos_u"), F.sin(v).alias("sin_v"), F.cos(v).alias("cos_v"))


def pool_neighbourhood(df: DataFrame, size: int, nlat: int, nlon: int) -> DataFrame:
    """File every sample under each cell whose odd size x size window holds it."""
    h = size // 2
    offsets = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-h, h + 1) for j in range(-h, h + 1)])
    d = df.withColumn("_o", F.explode(offsets))
    return d.withColumn("iy", (F.col("iy") + F.col("_o.dy")).cast("int")).withColumn("ix", (F.col("ix") + F.col("_o.dx")).cast("int")).where(
        F.col("iy").between(0, nlat - 1) & F.col("ix").between(0, nlon - 1)).drop("_o")


def crop(df: DataFrame, y0: int, x0: int, ny: int, nx: int) -> DataFrame:
    """Range filter that reaches the scan, rekeyed to the window's own origin."""
    return df.where(F.col("iy").between(y0, y0 + ny - 1) & F.col("ix").between(x0, x0 + nx - 1)).withColumn(
        "iy", F.col("iy") - y0).withColumn("ix", F.col("ix") - x0)


# ---- neighbourhood sums ---------------------------------------------------

def densify(df: DataFrame, nlat: int, nlon: int, keys=("day",)) -> DataFrame:
    """Every cell of the lattice for every key, absent cells as NULL."""
    spine = df.select(*keys).distinct().withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(nlat - 1)))).withColumn(
        "ix", F.explode(F.sequence(F.lit(0), F.lit(nlon - 1))))
    return spine.join(df, [*keys, "iy", "ix"], "left")


def box_sums(df: DataFrame, columns: dict[str, str], spans: dict[str, tuple[int, int]], keys=("day",)) -> DataFrame:
    """Sums over boxes on a dense lattice as a difference of running sums per axis.

    columns maps output prefix to a 0/1 or count column, spans maps a suffix to the
    (before, after) reach in cells. Both running sums of an axis share one sort, and
    all spans and columns share it too.
    """
    def run(w, c, upto):
        return F.coalesce(F.sum(c).over(w.rangeBetween(W.unboundedPreceding, upto)), F.lit(0))

    wx = W.partitionBy(*keys, "iy").orderBy("ix")
    wy = W.partitionBy(*keys, "ix").orderBy("iy")
    d = df.select("*", *[(run(wx, c, b) - run(wx, c, -a - 1)).alias(f"_{p}{s}") for p, c in columns.items() for s, (a, b) in spans.items()])
    out = d.select("*", *[(run(wy, F.col(f"_{p}{s}"), b) - run(wy, F.col(f"_{p}{s}"), -a - 1)).alias(f"{p}{s}")
                          for p in columns for s, (a, b) in spans.items()])
    return out.drop(*[f"_{p}{s}" for p in columns for s in spans])


def wet_crop_origins(df: DataFrame, valid: DataFrame, size: int, quantile: float, min_fraction: float, nlat: int, nlon: int,
                     value="value") -> DataFrame:
    """Crop origins per day that hold a cell at or above the day's quantile and enough land."""
    q = df.groupBy("day").agg(F.percentile(value, quantile).alias("threshold"))
    d = densify(df, nlat, nlon).join(q, "day").join(valid, ["iy", "ix"], "left")
    d = d.select("day", "iy", "ix", F.coalesce((F.col(value) >= F.col("threshold")).cast("int"), F.lit(0)).alias("wet"),
                 F.coalesce(F.col("land").cast("int"), F.lit(0)).alias("land"))
    b = box_sums(d, {"n_wet": "wet", "n_land": "land"}, {"": (0, size - 1)})
    return b.where((F.col("iy") <= nlat - size) & (F.col("ix") <= nlon - size) & (F.col("n_wet") > 0)).select(
        "day", F.col("iy").alias("r0"), F.col("ix").alias("c0"), "n_wet", (F.col("n_land") / float(size * size)).alias("land_fraction")).where(
        F.col("land_fraction") >= min_fraction)
