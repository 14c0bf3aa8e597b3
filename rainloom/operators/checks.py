"""Integrity checks as queries that return the offending groups, and guards that stop a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Accepted unit spellings.
UNITS_PER_DAY = ["mm/day", "mm day-1", "mm d-1", "mm/d"]
UNITS_PER_HOUR = ["mm/hr", "mm/hour", "mm h-1", "mm hr-1"]


def duplicates(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def guard(broken: Column, message: Column, keep: Column | None = None) -> Column:
    """Filter condition that stops the job on a broken row; filters survive column pruning.

    keep: which of the sound rows stay. A filter of its own could be moved in front of the guard and hide broken rows from it.
    """
    return F.when(broken, F.raise_error(message).cast("boolean")).otherwise(F.lit(True) if keep is None else keep)


def require_unique(df: DataFrame, keys) -> DataFrame:
    """Pass rows through; a key seen twice stops the job when it runs."""
    label = F.concat(F.lit(f"duplicate {','.join(keys)}: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    d = df.withColumn("_copies", F.count("*").over(W.partitionBy(*keys)))
    return d.where(guard(F.col("_copies") > 1, label)).drop("_copies")


def require_same(df: DataFrame, source: str, n: int, keys) -> DataFrame:
    """Pass rows through; a key that not all n sources hold stops the job when it runs."""
    label = F.concat(F.lit(f"sources differ in {','.join(keys)}: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    held = df.groupBy(*keys).agg(F.countDistinct(source).alias("_sources"))
    return df.join(held, list(keys)).where(guard(F.col("_sources") != n, label)).drop("_sources")


def missing_steps(df: DataFrame, axis: str, start: Column, end: Column, step: str = "interval 1 day", keys=()) -> DataFrame:
    """Expected axis positions (per key) that the data lacks."""
    base = df.select(*keys).distinct() if keys else df.sparkSession.range(1).drop("id")
    spine = base.withColumn(axis, F.explode(F.sequence(start, end, F.expr(step))))
    return spine.join(df.select(*keys, axis).distinct(), [*keys, axis], "left_anti")


def wrong_units(meta: DataFrame, units: str, accepted) -> DataFrame:
    return meta.where(F.col(units).isNull() | ~F.lower(F.trim(units)).isin(list(accepted)))


def fold_cover(df: DataFrame, n_folds: int, fold="fold", station="station_id", date="date", method="method") -> DataFrame:
    """Per method: folds complete, stations withheld exactly once, and the same date-station grid."""
    per = df.groupBy(method, station).agg(F.countDistinct(fold).alias("f"), F.countDistinct(date).alias("d"))
    s = per.groupBy(method).agg(F.count("*").alias("stations"), F.count_if(F.col("f") != 1).alias("not_once"), F.min("d").alias("min_days"), F.max("d").alias("max_days"))
    f = df.groupBy(method).agg(F.countDistinct(fold).alias("folds"), F.min(fold).alias("lo"), F.max(fold).alias("hi"))
    return s.join(f, method).select(method, "stations", "not_once", "min_days", "max_days", "folds",
                                    ((F.col("folds") == n_folds) & (F.col("lo") == 0) & (F.col("hi") == n_folds - 1)).alias("folds_complete"))


def truth_differences(a: DataFrame, b: DataFrame, keys, value: str, tolerance: float = 1e-5) -> DataFrame:
    """Rows of two runs that are unmatched or whose shared value differs."""
    j = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_ina")).join(
        b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_inb")), list(keys), "full")
    same = F.col("_ina") & F.col("_inb") & (F.col("_a").eqNullSafe(F.col("_b")) | (F.abs(F.col("_a") - F.col("_b")) <= tolerance))
    return j.where(~F.coalesce(same, F.lit(False))).select(*keys, F.col("_a").alias("value_a"), F.col("_b").alias("value_b"))


def identical(a: DataFrame, b: DataFrame, keys, value: str) -> DataFrame:
    """One row: matched rows, rows only on one side, and rows that are not bit-identical."""
    j = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_x")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_y")), list(keys), "full")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return j.agg(F.count_if(both).alias("matched"), F.count_if(~both).alias("unmatched"), F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"))


def spacing(axis: DataFrame, coord: str, step: float, tolerance: float = 1e-6) -> DataFrame:
    """Axis steps that leave the expected resolution (the axis is a lattice side)."""
    d = F.col(coord) - F.lag(coord).over(W.partitionBy(F.lit(0)).orderBy(coord))
    return axis.withColumn("step", d).where(F.abs(F.col("step") - step) > tolerance)


def conservation(fine: DataFrame, coarse: DataFrame, keys, area: Column, value="value") -> DataFrame:
    """Largest gap between the block means of a reconstruction and the coarse amounts."""
    m = fine.groupBy(*keys).agg((F.sum(area * F.col(value)) / F.sum(area)).alias("_m"))
    j = m.join(coarse.select(*keys, F.col(value).alias("_c")), list(keys))
    return j.agg(F.max(F.abs(F.col("_m") - F.col("_c"))).alias("max_error"), F.count("*").alias("blocks"))


def store_agreement(df: DataFrame, store: str, day="day", value="value") -> DataFrame:
    """Per store: day count, completeness of its calendar, cells and the shared mask."""
    per_day = df.groupBy(store, day).agg(F.count("*").alias("cells"), F.count(value).alias("valid"))
    g = per_day.groupBy(store).agg(F.count("*").alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                                   F.min("cells").alias("min_cells"), F.max("cells").alias("max_cells"))
    return g.withColumn("contiguous", F.col("days") == F.datediff("last_day", "first_day") + 1).withColumn("same_mask", F.col("min_cells") == F.col("max_cells"))


def missing_days(df: DataFrame, requested: DataFrame, day="day") -> DataFrame:
    return requested.select(day).distinct().join(df.select(day).distinct(), day, "left_anti")
