"""Granule inventories and daily satellite fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rainloom.functions import scalar as S
from rainloom.operators import checks as C, joins as J

# Date in a daily name; date, start and end in a half-hourly name.
DAILY_NAME = r"\.(\d{8})-S\d{6}-E\d{6}\."
# Spellings of millimetres a day, without spaces.
MM_PER_DAY = ("mm/day", "mmday-1", "mmd-1", "mmday^-1", "mmd^-1")
REPORTING_HOUR = 3
HALF_HOUR_NAME = r"\.(\d{8})-S(\d{6})-E(\d{6})\."


def list_files(spark: SparkSession, folder: str, pattern="*") -> DataFrame:
    """File names of a folder from metadata only; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select(F.col("_metadata.file_name").alias("file"))


def daily_inventory(files: DataFrame, start: Column, end: Column, name="file") -> DataFrame:
    """One row per requested day with its file count and whether it is usable."""
    d = files.withColumn("day", F.explode(F.array(F.try_to_date(F.regexp_extract(name, DAILY_NAME, 1), "yyyyMMdd")))).where("day is not null")
    c = d.groupBy("day").agg(F.count("*").alias("files"), F.min(name).alias("file"))
    spine = files.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("day"))
    n = F.coalesce(F.col("files"), F.lit(0))
    return spine.join(c, "day", "left").select("day", n.alias("files"), "file", F.when(n == 0, "missing").when(n > 1, "duplicate").otherwise("ok").alias("status"))


def half_hour_start(name="file") -> Column:
    """Start time of a half-hourly name; it must span exactly 29:59 from :00 or :30."""
    day, s, e = (F.regexp_extract(name, HALF_HOUR_NAME, i) for i in (1, 2, 3))

    def at(clock):
        n = [F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2), F.substring(clock, 1, 2), F.substring(clock, 3, 2)]
        return F.try_make_timestamp_ntz(*[x.try_cast("int") for x in n], F.substring(clock, 5, 2).try_cast("decimal(16,6)"))
    t0, t1 = at(s), at(e)
    ok = (t1 == t0 + F.expr("interval 29 minutes 59 seconds")) & F.minute(t0).isin(0, 30) & (F.second(t0) == 0)
    return F.when(ok, t0)


def half_hour_inventory(files: DataFrame, start: Column, end: Column, hour: int = 3, name="file") -> DataFrame:
    """48 slots per reporting day D from [D-1 hour, D hour) with their file counts."""
    # Behind explode a name is parsed once, after any distinct of the caller: a filter on the slot would be moved in front of it, into every row.
    f = files.withColumn("slot", F.explode(F.array(half_hour_start(name)))).where("slot is not null").groupBy("slot").agg(F.count("*").alias("files"))
    days = files.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    t0 = F.date_add("date", -1).cast("timestamp_ntz") + F.expr(f"interval {hour} hours")
    slots = days.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(47)))).withColumn("slot", t0 + F.make_dt_interval(mins=F.col("k") * 30))
    return slots.join(f, "slot", "left").select("date", "slot", F.coalesce("files", F.lit(0)).alias("files"))


def window_status(slots: DataFrame) -> DataFrame:
    """Missing slots may be allowed; duplicates never are."""
    return slots.groupBy("date").agg(F.count_if(F.col("files") == 0).alias("missing"), F.count_if(F.col("files") > 1).alias("duplicated"))


def daily_field(df: DataFrame, value="precip_mm", error="error_mm", count="n_valid", min_count=40) -> DataFrame:
    """Value and error kept only where finite, non-negative and well sampled; the count stays."""
    v = S.finite(value)
    ok = v.isNotNull() & (v >= 0) & (F.col(count) >= min_count)
    others = [c for c in df.columns if c not in (value, error)]
    return df.select(*others, F.when(ok, v).alias(value), F.when(ok, S.finite(error)).alias(error))


def subset_shards(df: DataFrame, start, end, order: str, day="day", complete=True, units=None, end_hour=None,
                  frequency=None, alignment=None, allow_day_shift=False) -> DataFrame:
    """Window of overlapping shards: the day filter reaches the scan, then the first shard of a day wins.

    With complete, requested days that no shard holds stop the call (one small job while the plan is built). Rows
    whose column `units` is not mm/day, or whose column `end_hour` is not the reporting hour, stop the job. So do rows
    whose column `frequency` is not half-hourly, unless column `alignment` says day-shift and such days are allowed.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    d = df.where(F.col(day).between(first, last))
    if units:
        d = d.where(C.guard(~F.coalesce(F.regexp_replace(F.lower(units), " ", "").isin(*MM_PER_DAY), F.lit(False)), F.concat(F.lit("unexpected units "), F.coalesce(units, F.lit("NULL")))))
    if end_hour:
        d = d.where(C.guard(~F.col(end_hour).eqNullSafe(F.lit(REPORTING_HOUR)), F.concat(F.lit("accumulation ends at hour "), F.coalesce(F.col(end_hour).cast("string"), F.lit("NULL")))))
    if frequency:
        shifted = F.coalesce(F.col(alignment) == "day-shift", F.lit(False)) if alignment else F.lit(False)
        other = ~F.coalesce(F.col(frequency) == "half-hourly", F.lit(False))
        d = d.where(C.guard(other & ~shifted, F.lit("not prepared from half-hourly fields and not declared day-shift")))
        if not allow_day_shift:
            d = d.where(C.guard(other & shifted, F.lit("day-shifted product is not allowed")))
    if complete:
        wanted = df.sparkSession.range(1).select(F.explode(F.sequence(first, last)).alias(day))
        gone = [str(r[0]) for r in wanted.join(d.select(day).distinct(), day, "left_anti").orderBy(day).limit(10).collect()]
        if gone:
            raise ValueError(f"requested days are absent: {', '.join(gone)}")
    first = d.groupBy(day).agg(F.min(order).alias(order))
    return d.join(first, [day, order])


def merge_products(frames: list[DataFrame], order_name="_file_order") -> DataFrame:
    """Concatenate product files on one lattice, keeping their order."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn(order_name, F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out


def concat_products(frames: list[DataFrame], cell=("iy", "ix"), day="day") -> DataFrame:
    """Products that share no cell and day and lie on one lattice; anything else stops the job."""
    d = C.require_same(merge_products(frames), "_file_order", len(frames), cell)
    return C.require_unique(d, [day, *cell])


def at_stations(product: DataFrame, stations: DataFrame, lattice, requested: DataFrame | None = None, offset_days: int = 0,
                factor: int = 1, value: str = "value", far: str = "stop") -> DataFrame:
    """Product values at stations for the requested days (a frame with `date`; the product's own days without one).

    A product day is the requested date plus offset_days. Coarse footprints (factor > 1) are not interpolated: the four
    cells of `lattice` around a station read the footprints that hold them, and only footprints are joined. Stations on
    the border read the outermost cells. Those beyond half a cell stop the call, or are read the same way with
    far="clamp". No matched day at all stops the call too (small jobs): it is an error of dates, not of coverage.
    """
    if far not in ("stop", "clamp"):
        raise ValueError(f"unknown rule for far stations {far!r}")
    if far == "stop":
        off = [r["station_id"] for r in stations.where(~lattice.contains("lat", "lon", -1e-9)).select("station_id").orderBy("station_id").limit(5).collect()]
        if off:
            raise ValueError(f"no station may lie off the product's lattice; off it, first of all: {off}")
    p = product
    if requested is not None:
        days = requested.select(F.date_add("date", offset_days).alias("day")).distinct()
        p = product.join(days, "day", "left_semi")
    if p.isEmpty():
        have = product.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        asked = days.agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("n")).first() if requested is not None else None
        want = f"{asked['n']} requested days {asked['a']}..{asked['b']} (shifted by {offset_days})" if asked else "all days"
        raise ValueError(f"matched no day of {want}; the product covers {have['a']}..{have['b']}")
    c = J.corners(stations.select("station_id", "lat", "lon"), lattice, clamp=True)
    cell = lambda k: F.floor(F.col(k) / factor).cast("int").alias(k)
    c = c.groupBy("station_id", cell("iy"), cell("ix")).agg(F.sum("w").alias("w"))
    v = F.col(value)
    g = p.select("day", "iy", "ix", value).join(c, ["iy", "ix"]).groupBy("station_id", "day").agg(
        F.sum(F.when(v.isNotNull(), v * F.col("w"))).alias("_s"), F.sum(F.when(v.isNotNull(), F.col("w"))).alias("_w"))
    return g.select("station_id", "day", S.ratio(F.col("_s"), F.col("_w")).alias(value), F.coalesce(F.col("_w"), F.lit(0.0)).alias("coverage"))


def latest_wins(df: DataFrame, keys, order="_file_order") -> DataFrame:
    """Later file wins on overlapping days."""
    value_cols = [c for c in df.columns if c not in (*keys, order)]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*value_cols), order).alias("_v"))
    return g.select(*keys, "_v.*")


def bounded(value: str, low=0.0, high=1000.0) -> Column:
    """Analysis values outside the plausible range are missing."""
    v = F.col(value)
    return F.when((v >= low) & (v <= high), v)
