"""Time: reporting-day windows, block means, climatology, coverage, runs, lags, day selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.functions import ensemble as EN, scalar as S
from rainloom.operators import joins as J


# ---- accumulation ---------------------------------------------------------

def reporting_day(ts, hour: int = 3) -> Column:
    """Label of the window [D-1 hour, D hour) that holds the time: the day it ends on."""
    return F.date_add(F.to_date(S.col(ts) - F.expr(f"interval {hour} hours")), 1)


def accumulate_windows(df: DataFrame, keys, min_count: int, ts="ts", rate="rate", error: str | None = None,
                       hours_per_step: float = 0.5, hour: int = 3) -> DataFrame:
    """Rates to reporting-day depth, quadrature error and completeness; short windows are NULL."""
    r = S.finite(rate)
    e = S.finite(error) * hours_per_step if error else F.lit(None).cast("double")
    g = df.groupBy(*keys, reporting_day(ts, hour).alias("date")).agg(
        F.sum(r * hours_per_step).alias("_p"), F.sqrt(F.sum(e * e)).alias("_e"), F.count(r).alias("n_valid"))
    ok = F.col("n_valid") >= min_count
    return g.select(*keys, "date", F.when(ok, F.col("_p")).alias("precip_mm"), F.when(ok, F.col("_e")).alias("error_mm"), "n_valid")


def daily_mean(df: DataFrame, keys, value: str, ts="ts") -> DataFrame:
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def daily_total(df: DataFrame, keys, value: str, ts="ts", scale: float = 1000.0, hours: int | None = 24) -> DataFrame:
    """Hourly accumulations are stamped at the end of their hour, so the label moves back one hour."""
    g = df.groupBy(*keys, F.to_date(F.col(ts) - F.expr("interval 1 hour")).alias("date")).agg(
        (F.sum(value) * scale).alias(value), F.countDistinct(F.date_trunc("hour", F.col(ts))).alias("n_hours"))
    return g if hours is None else g.withColumn(value, F.when(F.col("n_hours") >= hours, F.col(value)))


# ---- block means ----------------------------------------------------------

def calendar_blocks(df: DataFrame, keys, values, windows, start, end, min_fraction=0.8, date="date") -> DataFrame:
    """Non-overlapping calendar blocks for every window length in one pass.

    Rows must have all values (common days); a trailing partial block is dropped.
    start and end are Columns (literal dates or scalar subqueries).
    """
    common = df.where(" and ".join(f"{v} is not null" for v in values))
    w = F.explode(F.array(*[F.lit(int(x)) for x in windows])).alias("window")
    d = common.select(*keys, date, *values, w).withColumn("_n", F.datediff(end, start) + 1)
    d = d.withColumn("block", F.floor(F.datediff(F.col(date), start) / F.col("window")).cast("int")).where(
        (F.col("block") >= 0) & (F.col("block") < F.floor(F.col("_n") / F.col("window"))))
    g = d.groupBy(*keys, "window", "block").agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n_days"))
    return g.where(F.col("n_days") >= F.col("window") * min_fraction)


def row_blocks(df: DataFrame, keys, values, windows, date="date") -> DataFrame:
    """Blocks over consecutive available rows of a station, whatever the calendar says."""
    common = df.where(" and ".join(f"{v} is not null" for v in values))
    w = W.partitionBy(*keys)
    d = common.withColumn("_i", F.row_number().over(w.orderBy(date)) - 1).withColumn("_n", F.count("*").over(w))
    d = d.withColumn("window", F.explode(F.array(*[F.lit(int(x)) for x in windows])))
    d = d.withColumn("block", F.floor(F.col("_i") / F.col("window")).cast("int")).where(
        F.col("block") < F.floor(F.col("_n") / F.col("window")))
    return d.groupBy(*keys, "window", "block").agg(*[F.avg(v).alias(v) for v in values])


def required_days(df: DataFrame, period: str, date="date", fraction=0.8) -> DataFrame:
    """Days a station needs in each period: ceil(fraction * days requested in it)."""
    return df.groupBy(period).agg(F.ceil(F.countDistinct(date) * fraction - 1e-9).alias("required"))


def period_ensembles(df: DataFrame, period: str, fraction=0.8, method="method", station="station_id", date="date", n_members: int | None = None) -> DataFrame:
    """Period means per station of truth and of every member, plus SDs of the daily values.

    A station-day counts only when truth and all members of all methods are finite. Every member is a partial sum of
    one row; their number is looked up (a small job) unless n_members says it.
    """
    need = required_days(df, period, date, fraction)
    w = W.partitionBy(station, date)
    ok = EN.usable("members", "truth")
    d = df.withColumn("_bad", F.max(F.when(ok, 0).otherwise(1)).over(w)).where("_bad = 0")
    g = d.groupBy(period, station, method).agg(
        F.filter(EN.each(F.avg, n_members or EN.largest(df)), lambda x: x.isNotNull()).alias("members"), F.avg("truth").alias("truth"),
        F.stddev_pop("truth").alias("truth_sd"), F.stddev_pop(EN.mean("members")).alias("predicted_sd"), F.countDistinct(date).alias("n_days"))
    return g.join(need, period).where(F.col("n_days") >= F.col("required")).drop("required")


def complete_season_years(df: DataFrame, date="date") -> DataFrame:
    """Years holding every day from 1 May to 30 September (153 days)."""
    return df.where(F.month(date).between(5, 9)).groupBy(F.year(date).alias("year")).agg(
        (F.countDistinct(date) == 153).alias("complete"))


def window_pattern_correlation(df: DataFrame, a: str, b: str, days: int, start: Column, cell=("iy", "ix"), date="day", min_cells=3) -> DataFrame:
    """n-day accumulations per cell, then the spatial correlation of each block."""
    d = df.withColumn("block", F.floor(F.datediff(F.col(date), start) / days).cast("int"))
    s = d.groupBy("block", *cell).agg(F.sum(a).alias("a"), F.sum(b).alias("b")).where("a is not null and b is not null")
    g = s.groupBy("block").agg(F.corr("a", "b").alias("corr"), F.count("*").alias("n"),
                               F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return g.select("block", "n", F.when((F.col("n") >= min_cells) & (F.col("sa") > 0) & (F.col("sb") > 0), F.col("corr")).alias("corr"))


# ---- climatology ----------------------------------------------------------

def doy_climatology(df: DataFrame, value="value", day="day", smooth: int = 1) -> DataFrame:
    """Day-of-year mean per cell for all 366 days, missing as zero, then a circular running mean.

    Day counts come from the calendar of the record, not from the cell.
    """
    d = df.withColumn("doy", F.dayofyear(day) - 1)
    n = d.groupBy("doy").agg(F.countDistinct(day).alias("n_days"))
    s = d.groupBy("doy", "iy", "ix").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s")).join(n, "doy")
    whole = df.select("iy", "ix").distinct().withColumn("doy", F.explode(F.sequence(F.lit(0), F.lit(365))))
    c = whole.join(s, ["doy", "iy", "ix"], "left").select("doy", "iy", "ix", F.coalesce(F.col("s") / F.col("n_days"), F.lit(0.0)).alias("climatology"))
    if smooth <= 1:
        return c
    offsets = F.array(*[F.lit(o) for o in range(-((smooth - 1) // 2), smooth // 2 + 1)])
    e = c.withColumn("_o", F.explode(offsets)).withColumn("doy", F.pmod(F.col("doy") + F.col("_o"), F.lit(366)))
    return e.groupBy("doy", "iy", "ix").agg((F.sum("climatology") / smooth).alias("climatology"))


def cell_ceiling(df: DataFrame, value="value", floor: float = 1.0) -> DataFrame:
    return df.groupBy("iy", "ix").agg(F.greatest(F.max(value), F.lit(floor)).alias("ceiling"))


def temporal_statistics(df: DataFrame, values, cell=("iy", "ix")) -> DataFrame:
    return df.groupBy(*cell).agg(*[x for v in values for x in (
        F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_n"))])


def period_climatology(df: DataFrame, period: Column, value="value", day="day", cell=("iy", "ix")) -> DataFrame:
    """Mean over years of the within-year mean and of the within-year SD."""
    y = df.groupBy(period.alias("period"), F.year(day).alias("year"), *cell).agg(
        F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return y.groupBy("period", *cell).agg(F.avg("m").alias("mean"), F.avg("s").alias("within_sd"), F.count("m").alias("n_years"))


# ---- completeness, runs, segments -----------------------------------------

def date_spine(df: DataFrame, keys, start: Column, end: Column, date="date") -> DataFrame:
    return df.select(*keys).distinct().withColumn(date, F.explode(F.sequence(start, end)))


def coverage(df: DataFrame, start: Column, end: Column, min_coverage: float, key="station_id", value="precip_mm", date="date") -> DataFrame:
    """Share of requested days with a value; counts need no spine rows."""
    n = F.datediff(end, start) + 1
    d = df.where(F.col(date).between(start, end))
    g = d.groupBy(key).agg(F.countDistinct(F.when(F.col(value).isNotNull(), F.col(date))).alias("n_obs"))
    return g.select(key, "n_obs", n.cast("bigint").alias("n_days"), (F.col("n_obs") / n).alias("coverage"),
                    (F.col("n_obs") / n >= min_coverage).alias("kept"))


def on_spine(df: DataFrame, start: Column, end: Column, key="station_id", value="precip_mm", date="date", duplicates="mean") -> DataFrame:
    """One row per station and day; duplicates averaged or the first taken."""
    agg = F.avg(value) if duplicates == "mean" else F.min_by(value, "_order")
    d = df if duplicates == "mean" else df.withColumn("_order", F.col("file_order"))
    one = d.groupBy(key, date).agg(agg.alias(value))
    return date_spine(df, [key], start, end, date).join(one, [key, date], "left")


def stuck_runs(df: DataFrame, key="station_id", value="precip_mm", date="date", max_mm=1000.0, flag_at=10) -> DataFrame:
    """Longest run of equal positive values, count over max_mm, and the suspicion flag."""
    w = W.partitionBy(key).orderBy(date)
    v = F.col(value)
    same = F.coalesce((v == F.lag(v).over(w)) & (v > 0), F.lit(False))
    # A run is as long as its last row is far from its first, so the runs need no groups of their own.
    d = df.withColumn("_i", F.row_number().over(w).cast("bigint")).withColumn("_first", F.when(~same, F.col("_i")))
    d = d.withColumn("_first", F.max("_first").over(w.rowsBetween(W.unboundedPreceding, 0)))
    g = d.groupBy(key).agg(F.max(F.col("_i") - F.col("_first") + 1).alias("longest_run"), F.count_if(v > max_mm).alias("n_over_max"))
    return g.withColumn("suspicious", (F.col("n_over_max") > 0) | (F.col("longest_run") >= flag_at))


def segments(df: DataFrame, keys=(), date="date", max_gap: int = 1) -> DataFrame:
    """Number contiguous date stretches of a daily series."""
    w = W.partitionBy(*(keys or [F.lit(0)])).orderBy(date)
    gap = F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)) > max_gap, F.lit(False))
    return df.withColumn("_g", gap.cast("int")).withColumn(
        "segment", F.sum("_g").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_g")


# ---- day selection --------------------------------------------------------

def evenly_spaced_days(days: DataFrame, count: int, date="date") -> DataFrame:
    """Days at truncated linspace positions of the ordered calendar."""
    d = days.select(date).distinct().withColumn("_k", F.lit(0))
    w = W.partitionBy("_k")
    d = d.withColumn("_i", F.row_number().over(w.orderBy(date)) - 1).withColumn("_n", F.count("*").over(w))
    c = F.least(F.lit(count), F.col("_n"))
    pick = F.transform(F.sequence(F.lit(0), c.cast("int") - 1),
                       lambda k: F.floor(k * ((F.col("_n") - 1) / F.greatest(c - 1, F.lit(1)))))
    return d.where(F.array_contains(pick, F.col("_i").cast("bigint"))).select(date)


def balanced_days(days: DataFrame, count: int, months, date="date") -> DataFrame:
    """Quota per year-month dealt round robin, interior positions within each month.

    The day list is a calendar, so these windows hold at most days of the record.
    """
    d = days.select(date).distinct().where(F.month(date).isin(list(months))).withColumn("period", F.date_format(date, "yyyy-MM"))
    d = d.withColumn("_all", F.lit(0))
    wg, wa = W.partitionBy("period"), W.partitionBy("_all")
    d = d.withColumn("_i", F.row_number().over(wg.orderBy(date)) - 1).withColumn("_size", F.count("*").over(wg))
    d = d.withColumn("_g", F.dense_rank().over(wa.orderBy("period")) - 1)
    d = d.withColumn("_ng", F.max("_g").over(wa) + 1)
    years = F.size(F.collect_set(F.year(date)).over(wa))
    d = d.withColumn("_expected", years * len(set(months)))
    d = d.withColumn("_ng", F.when(F.col("_ng") == F.col("_expected"), F.col("_ng")).otherwise(
        F.raise_error(F.lit("incomplete year-month coverage")).cast("int")))
    # Fewer days than months: keep evenly spread months, one day each.
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(
        k * ((F.col("_ng") - 1) / float(max(count - 1, 1)))).cast("int"))
    d = d.where((F.col("_ng") <= count) | F.array_contains(spread, F.col("_g")))
    d = d.withColumn("_deal", F.row_number().over(wa.orderBy("_i", "_g")))
    d = d.withColumn("_quota", F.count_if(F.col("_deal") <= F.least(F.lit(count), F.count("*").over(wa))).over(wg))
    slot = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_quota").cast("int") - 1, F.lit(0))),
                       lambda k: F.floor((k + 0.5) * F.col("_size") / F.greatest(F.col("_quota"), F.lit(1))))
    return d.where((F.col("_quota") > 0) & F.array_contains(slot, F.col("_i").cast("bigint"))).select("period", date)


def case_days(series: DataFrame, quantiles, date="day", value="value") -> DataFrame:
    """For each quantile of the daily series, the nearest day not already taken.

    Only the K nearest days of each of the K quantiles can matter, so one row of
    K x K candidates is enough for the sequential choice.
    """
    k = len(quantiles)
    q = series.agg(F.percentile(value, F.array(*[F.lit(float(x)) for x in quantiles])).alias("q")).scalar()
    d = series.select(date, value, F.posexplode(q).alias("slot", "target"))
    w = W.partitionBy("slot").orderBy(F.abs(F.col(value) - F.col("target")), date)
    near = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    per = near.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("_r", date, value))).alias("c"))
    row = per.agg(F.sort_array(F.collect_list(F.struct("slot", "c"))).alias("s"))
    empty = F.lit(None).cast(f"array<struct<slot:int,{date}:date,{value}:double>>")

    def choose(acc, s):
        free = F.filter(s["c"], lambda x: ~F.exists(acc, lambda y: y[date] == x[date]))
        return F.concat(acc, F.array(F.struct(s["slot"].alias("slot"), free[0][date].alias(date), free[0][value].alias(value))))

    start = F.coalesce(empty, F.array().cast(f"array<struct<slot:int,{date}:date,{value}:double>>"))
    picked = row.select(F.inline(F.aggregate("s", start, choose)))
    qs = F.array(*[F.lit(float(x)) for x in quantiles])
    return picked.select(F.get(qs, F.col("slot")).alias("quantile"), date, value)


# ---- series and lags ------------------------------------------------------

def area_mean_series(df: DataFrame, weight: Column, values, day="day") -> DataFrame:
    """Weighted daily mean of each value, its own missing cells left out."""
    def m(v):
        w = F.when(F.col(v).isNotNull(), weight)
        return S.ratio(F.sum(F.col(v) * w), F.sum(w)).alias(v)
    return df.groupBy(day).agg(*[m(v) for v in values])


def lag_correlations(series: DataFrame, target: str, background: str, lags, date="date") -> DataFrame:
    """Correlate target at t with background at t + lag; fewer than three pairs is missing."""
    b = series.select(F.col(date).alias("_d"), F.col(background).alias("_b")).withColumn(
        "lag", F.explode(F.array(*[F.lit(int(x)) for x in lags])))
    b = b.withColumn(date, F.date_add("_d", -F.col("lag")))
    j = series.select(date, target).join(b, date).where(F.col(target).isNotNull() & F.col("_b").isNotNull())
    g = j.groupBy("lag").agg(F.corr(target, "_b").alias("corr"), F.count("*").alias("n"))
    return g.withColumn("corr", F.when(F.col("n") >= 3, F.col("corr")))


def lag_scan(obs: DataFrame, product: DataFrame, lags, keys=("station_id",), date="date", min_pairs=30,
             observed="obs", predicted="pred", name="product") -> DataFrame:
    """Scores of each product at each day shift and its best lag by correlation."""
    p = product.withColumn("lag", F.explode(F.array(*[F.lit(int(x)) for x in lags])))
    p = p.withColumn(date, F.date_add(date, -F.col("lag")))
    j = obs.join(p, [*keys, date])
    d = F.col(predicted) - F.col(observed)
    g = j.groupBy(name, "lag").agg(F.count(d).alias("n"), F.corr(predicted, observed).alias("corr"), F.avg(d).alias("bias"),
                                   F.sqrt(F.avg(d * d)).alias("rmse")).where(F.col("n") >= min_pairs)
    w = W.partitionBy(name)
    return g.withColumn("best", F.max_by("lag", F.struct("corr", -F.col("lag"))).over(w) == F.col("lag"))
