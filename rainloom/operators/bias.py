"""Frequency adaptation and quantile mapping, fitted leave-one-year-out per cell and stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rainloom.functions import order as O, scalar as S
from rainloom.operators.checks import guard


def sorted_quantile(s: Column, q) -> Column:
    """Linear-interpolation quantile of a sorted array."""
    pos = (F.size(s) - 1) * q
    lo = F.floor(pos).cast("int")
    a = F.get(s, lo)
    return a + (pos - lo) * (F.get(s, F.least(lo + 1, F.size(s) - 1)) - a)


def wet_count(n: Column, wet_fraction: Column, rounding: str = "round") -> Column:
    """Samples that may stay wet; the older variant truncates instead of rounding half even."""
    k = n * wet_fraction
    k = F.bround(k) if rounding == "round" else F.floor(k)
    return F.least(F.greatest(k, F.lit(0)), n).cast("int")


def sorted_cut(s: Column, wet_fraction: Column, rounding: str = "round") -> Column:
    """Source value below which everything is dried to match the wet share."""
    n = F.size(s)
    k = wet_count(n, wet_fraction, rounding)
    return (F.when(wet_fraction.isNull() | (n == 0), F.lit(0.0)).when(k <= 0, F.get(s, n - 1) + 1.0)
            .when(k >= n, F.lit(0.0)).otherwise(F.get(s, n - k)))


def frequency_cut(df: DataFrame, keys, source: str, target: str, wet_mm: float, rounding="round") -> DataFrame:
    """Cut per group whose rows are bounded by the calendar (a station or a cell)."""
    g = df.where(F.col(source).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(source)).alias("s"), F.avg((F.col(target) >= wet_mm).cast("double")).alias("wet_fraction"))
    return g.select(*keys, "wet_fraction", sorted_cut(F.col("s"), F.col("wet_fraction"), rounding).alias("cut"), F.size("s").alias("n"))


def fit_quantile_map(df: DataFrame, source: str, target: str, keys=("stratum", "iy", "ix"), year="year", n_knots=41,
                     wet_mm=0.1, min_samples=300, leave_out=True, mode="full") -> DataFrame:
    """Maps per holdout year x stratum x cell from the jointly finite samples of the other years.

    A group holds the days of one stratum in one (pooled) cell, so its samples fit one
    row. They are shuffled and sorted once, with their years; leaving a year out of the
    sorted samples leaves them sorted, so neither shuffle nor sort grows with the years. Thin groups get identity knots; mode 'frequency_only' keeps the cut
    and sets target knots to source knots; mode 'all_values' maps every value, zeros
    included, without a cut.
    """
    d = df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    by = list(keys)
    if leave_out:
        years = df.agg(F.sort_array(F.collect_set(year)).alias("y")).scalar()
        dated = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("v"), F.col(year).alias("y"))))
        without = lambda c: F.transform(F.filter(c, lambda x: x["y"] != F.col("holdout")), lambda x: x["v"]).alias(c)
        g = d.groupBy(*by).agg(dated(source).alias("s"), dated(target).alias("t")).withColumn("holdout", F.explode(years))
        by = ["holdout", *by]
        g = g.select(*by, without("s"), without("t")).where(F.size("s") > 0)
    else:
        g = d.groupBy(*by).agg(F.array_sort(F.collect_list(source)).alias("s"), F.array_sort(F.collect_list(target)).alias("t"))
    n = F.size("s")
    wet_t = F.filter("t", lambda x: x >= wet_mm) if mode != "all_values" else F.col("t")
    g = g.withColumn("n", n).withColumn("_wt", wet_t)
    frac = F.size(F.filter("t", lambda x: x >= wet_mm)) / n
    g = g.withColumn("cut", F.lit(0.0) if mode == "all_values" else sorted_cut(F.col("s"), frac))
    g = g.withColumn("_ws", F.col("s") if mode == "all_values" else F.filter("s", lambda x: (x >= F.col("cut")) & (x > 0)))
    thin = F.col("n") < min_samples
    few = thin | (F.size("_ws") < 2) | (F.size("_wt") < 2)
    probs = F.transform(F.sequence(F.lit(0), F.lit(n_knots - 1)), lambda k: k / float(n_knots - 1))

    def knots(c):
        k = F.transform(probs, lambda p: sorted_quantile(F.col(c), p))
        return F.transform(k, lambda x, i: F.array_max(F.slice(k, F.lit(1), i + 1)))

    identity = F.array(F.lit(0.0), F.lit(1.0))
    sk = F.when(few, identity).otherwise(knots("_ws"))
    tk = sk if mode == "frequency_only" else F.when(few, identity).otherwise(knots("_wt"))
    return g.select(*by, "n", F.when(thin, F.lit(0.0)).otherwise(F.col("cut")).alias("cut"), sk.alias("source_knots"), tk.alias("target_knots"))


def interpolate(v: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear value, clamped at both ends."""
    n = F.size(xs)
    k = F.size(F.filter(xs, lambda x: x <= v))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    return (F.when(k == 0, F.get(ys, F.lit(0))).when(k == n, F.get(ys, n - 1))
            .otherwise(y0 + (v - x0) * (y1 - y0) / F.nullif(x1 - x0, F.lit(0.0))))


def map_value(v: Column, cut: Column, xs: Column, ys: Column) -> Column:
    """Zero below the cut, interpolation inside, constant ratio above the top knot."""
    top, top_y = F.element_at(xs, -1), F.element_at(ys, -1)
    inner = interpolate(v, xs, ys)
    out = F.when((top > 0) & (v > top), v * top_y / F.nullif(top, F.lit(0.0))).otherwise(inner)
    return F.when(v.isNull(), F.lit(None).cast("double")).when((v >= cut) & (v > 0), F.greatest(out, F.lit(0.0))).otherwise(F.lit(0.0))


def apply_quantile_map(df: DataFrame, maps: DataFrame, source: str, keys=("stratum", "iy", "ix"), year="year", out="corrected") -> DataFrame:
    """Correct each year with the map that left it out; a sample without its map stops the job."""
    m = maps.select(F.col("holdout").alias(year), *keys, "cut", "source_knots", "target_knots")
    j = df.join(m, [year, *keys], "left")
    j = j.where(guard(F.col("cut").isNull(), F.lit("no map fitted without this year and stratum")))
    return j.withColumn(out, map_value(F.col(source), F.col("cut"), F.col("source_knots"), F.col("target_knots"))).drop(
        "cut", "source_knots", "target_knots")


def correction_report(df: DataFrame, raw: str, corrected: str, target: str, keys=(), wet_mm=1.0) -> DataFrame:
    """Raw against corrected bias, RMSE and wet share, overall and per key through grouping sets."""
    r, c, t = F.col(raw), F.col(corrected), F.col(target)
    g = df.rollup(*keys) if keys else df.groupBy()
    return g.agg(F.count(c - t).alias("n"), F.avg(r - t).alias("raw_bias"), F.avg(c - t).alias("corrected_bias"),
                 F.sqrt(F.avg((r - t) * (r - t))).alias("raw_rmse"), F.sqrt(F.avg((c - t) * (c - t))).alias("corrected_rmse"),
                 F.avg((r >= wet_mm).cast("double")).alias("raw_wet"), F.avg((c >= wet_mm).cast("double")).alias("corrected_wet"),
                 F.avg((t >= wet_mm).cast("double")).alias("target_wet"))


def bias_persistence(df: DataFrame, corrected: str, target: str, keys, year="year") -> DataFrame:
    """How far a yearly bias carries over: mean and SD over years, and the leave-one-year-out error."""
    y = df.groupBy(*keys, year).agg(F.avg(F.col(corrected) - F.col(target)).alias("b"))
    g = y.groupBy(*keys).agg(F.avg("b").alias("mean_bias"), F.stddev_pop("b").alias("sd_bias"), F.count("b").alias("years"),
                             F.sum("b").alias("_s"), F.collect_list("b").alias("_b"))
    n = F.col("years")
    e = F.transform("_b", lambda b: F.abs(b - (F.col("_s") - b) / F.nullif(n - 1, F.lit(0))))
    return g.select(*keys, "years", "mean_bias", "sd_bias", F.when(n > 1, F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / n).alias("loyo_error"))
