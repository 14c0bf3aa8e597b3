"""Station catalogue, station-month matrix and per-station CSV files to station-day rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rainloom.functions import scalar as S
from rainloom.operators import checks as C, joins as J

DAYS = [str(d) for d in range(1, 32)]

# Spelling aliases between archive and catalogue keys.
ALIASES = {"chittagong": "chittagonj", "patuakhali": "pauakhali", "sydpur": "syedpur"}

# Stations absent from the catalogue, key: (name, lat, lon, id).
EXTRA_STATIONS = {
    "dimla": ("Dimla", 26.12833, 88.92500, 36),
    "rajarhat": ("Rajarhat", 25.80500, 89.66833, 37),
    "gopalgonj": ("Gopalgonj", 23.00722, 89.83333, 38),
    "natrakona": ("Natrakona", 24.87750, 90.72750, 39),
    "nikli": ("Nikli", 24.31667, 90.91667, 40),
    "tarash": ("Tarash", 24.43333, 89.36667, 41),
    "tetulia": ("Tetulia", 26.58333, 88.55000, 42),
}


def aliased(key: Column, aliases=None) -> Column:
    out = key
    for a, b in (ALIASES if aliases is None else aliases).items():
        out = F.when(key == a, F.lit(b)).otherwise(out)
    return out


def _number(c: str, kind: str) -> Column:
    """Numeric cast that stops the job on text."""
    v = F.trim(F.col(c).cast("string"))
    return F.coalesce(v.try_cast(kind), F.raise_error(F.concat(F.lit(f"{c} is not a number: "), F.coalesce(v, F.lit("NULL")))).cast(kind))


def parse_catalog(raw: DataFrame) -> DataFrame:
    """station_id, catalog_name, lat, lon, station_key; ids, coordinates and keys must be unique."""
    cols = {c.strip().lower(): c for c in raw.columns}
    missing = {"stationnumber", "station", "latitude", "longitude"} - set(cols)
    if missing:
        raise ValueError(f"catalogue columns missing: {sorted(missing)}")
    d = raw.select(_number(cols["stationnumber"], "bigint").alias("station_id"), F.trim(F.col(cols["station"])).alias("catalog_name"),
                   _number(cols["latitude"], "double").alias("lat"), _number(cols["longitude"], "double").alias("lon"))
    d = d.withColumn("station_key", S.station_key("catalog_name"))
    for keys in (["station_id"], ["lat", "lon"], ["station_key"]):
        d = C.require_unique(d, keys)
    return d


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalog(spark.read.csv(path, header=True))


def read_month_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Rows below the Stati,Year,Month header of every file; title rows above it are dropped.

    The header is located by file position (block start, row id within the block), so
    a file may be split over tasks.
    """
    names = ["Stati", "Year", "Month", *DAYS]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("emptyValue", "").csv(path)
    pos = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    d = raw.select(*names, F.col("_metadata.file_path").alias("_file"), pos.alias("_pos"))
    is_head = (F.lower(F.trim("Stati")) == "stati") & (F.lower(F.trim("Year")) == "year") & (F.lower(F.trim("Month")) == "month")
    heads = d.groupBy("_file").agg(F.min(F.when(is_head, F.col("_pos"))).alias("_head"))
    below = F.when(F.col("_head").isNull(), F.raise_error(F.concat(F.lit("no header row in "), F.col("_file"))).cast("boolean")).otherwise(F.col("_pos") > F.col("_head"))
    return d.join(heads, "_file").where(below).select(*names)


def checked_months(matrix: DataFrame) -> DataFrame:
    """name, date (first of the month), cells (one text for each day it has) of every row; an unknown token stops the job.

    Rows whose year and month name no month drop out with their cells.
    """
    text = F.concat_ws("-", F.lpad(_number("Year", "int").cast("string"), 4, "0"), F.lpad(_number("Month", "int").cast("string"), 2, "0"), F.lit("01"))
    # A generated column: no filter on it can be moved to rows above the header, which hold other text.
    month = F.struct(F.try_to_date(text, "yyyy-MM-dd").alias("date"), F.array(*[F.coalesce(F.col(k), F.lit("")) for k in DAYS]).alias("cells"))
    d = matrix.select(F.trim("Stati").alias("name"), F.explode(F.array(month)).alias("_m")).where("_m.date is not null")
    d = d.select("name", "_m.date", F.slice("_m.cells", F.lit(1), F.dayofmonth(F.last_day("_m.date"))).alias("cells"))
    unknown = F.get(F.filter("cells", S.is_unknown_token), F.lit(0))
    return d.where(C.guard(unknown.isNotNull(), F.concat(F.lit("unrecognized precipitation token "), unknown)))


def month_days(months: DataFrame, max_mm: float = 1000.0) -> DataFrame:
    """One row a day from rows a month: date moves to the day, cells becomes precip_mm, other columns stay."""
    rest = [c for c in months.columns if c not in ("date", "cells")]
    d = months.select(*rest, "date", F.posexplode("cells").alias("_d", "cell"))
    return d.select(*rest, F.date_add("date", F.col("_d")).alias("date"), S.clean_legacy("cell", max_mm).alias("precip_mm"))


def month_matrix_long(matrix: DataFrame, max_mm: float = 1000.0) -> DataFrame:
    """Days 1-31 as rows; impossible dates drop out, unknown tokens stop the job."""
    return month_days(checked_months(matrix), max_mm)


def locate(long: DataFrame, catalog: DataFrame, aliases=None, keep: Column | None = None) -> DataFrame:
    """Many-to-one join to the catalogue by normalised name; an unmatched station stops the job, in rows that `keep` cuts too."""
    d = long.withColumn("station_key", aliased(S.station_key("name"), aliases))
    j = J.many_to_one(d, catalog.select("station_key", "station_id", "lat", "lon"), "station_key", "station_id", keep)
    return j.select("station_id", "name", "lat", "lon", *[c for c in long.columns if c != "name"])


def period(start=None, end=None, last: str = "date") -> Column:
    """date <= end and `last` >= start."""
    first = F.lit(True) if start is None else F.expr(last) >= F.lit(start).cast("date")
    return first if end is None else first & (F.col("date") <= F.lit(end).cast("date"))


def station_days(long: DataFrame, start=None, end=None) -> DataFrame:
    """Requested period with one row per station and day; a duplicate stops the job."""
    return C.require_unique(long.where(period(start, end)), ["station_id", "date"])


def legacy_days(matrix: DataFrame, catalog: DataFrame, start=None, end=None, max_mm: float = 1000.0) -> DataFrame:
    """Station days of a station-month matrix in the requested period.

    Tokens, names and repeated station months are checked, and the period is cut, on rows of a month; only what is
    left becomes days. Tokens and names are checked in every row, repeats inside the period.
    """
    months = locate(checked_months(matrix), catalog, keep=period(start, end, "last_day(date)"))
    return month_days(C.require_unique(months, ["station_id", "date"]), max_mm).where(period(start, end))


def read_legacy(spark: SparkSession, rainfall: str, catalog: str, start=None, end=None, max_mm=1000.0) -> DataFrame:
    return legacy_days(read_month_matrix(spark, rainfall), read_catalog(spark, catalog), start, end, max_mm)


def match_files(files: DataFrame, catalog: DataFrame, file_col="file", order_col="station_id") -> DataFrame:
    """Catalogue station of each file name: exact key, else the first key that contains or is contained.

    Containment is an equi join on the substrings of both keys, so no pair of
    unrelated names is ever compared.
    """
    f = files.select(file_col).distinct().withColumn("key", aliased(S.station_key(F.regexp_replace(F.col(file_col), r"(?i)\.csv$", "")))).where("key <> ''")
    c = catalog.select("station_id", "catalog_name", "lat", "lon", F.col("station_key").alias("cat_key"), F.col(order_col).alias("_ord"))

    def parts(k):
        n = F.length(k)
        return F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
            F.sequence(F.lit(1), n - i + 1), lambda m: F.substring(k, i, m))))))

    inside = f.withColumn("cat_key", parts(F.col("key"))).join(c, "cat_key")
    holds = c.where("cat_key <> ''").withColumn("key", parts(F.col("cat_key"))).join(f, "key")
    cols = [file_col, "key", "cat_key", "station_id", "catalog_name", "lat", "lon", "_ord"]
    hits = inside.select(*cols).unionByName(holds.select(*cols)).withColumn("_exact", F.when(F.col("cat_key") == F.col("key"), 0).otherwise(1))
    best = hits.groupBy(file_col, "key").agg(F.min_by(F.struct("station_id", "catalog_name", "lat", "lon"), F.struct("_exact", "_ord")).alias("s"))
    extra = F.create_map(*[x for k, v in EXTRA_STATIONS.items() for x in (F.lit(k), F.struct(
        F.lit(v[3]).cast("bigint").alias("station_id"), F.lit(v[0]).alias("catalog_name"), F.lit(v[1]).alias("lat"), F.lit(v[2]).alias("lon")))])
    j = f.join(best, [file_col, "key"], "left").withColumn("s", F.coalesce("s", F.try_element_at(extra, F.col("key"))))
    return j.where("s is not null").select(file_col, "s.station_id", "s.catalog_name", "s.lat", "s.lon")


def station_file_rows(rows: DataFrame, matches: DataFrame, file_col="file", date_text="date_text", cell="cell", max_mm=1000.0) -> DataFrame:
    """Station-day rows of matched files; unparseable dates drop out and bad tokens become missing."""
    d = rows.withColumn("date", F.coalesce(F.try_to_date(F.trim(date_text), "yyyy-MM-dd"), F.try_to_timestamp(F.trim(date_text)).cast("date"))).where("date is not null")
    d = d.join(matches, file_col)
    return d.select("station_id", F.col("catalog_name").alias("name"), "lat", "lon", "date", S.clean_legacy(F.coalesce(cell, F.lit("")), max_mm).alias("precip_mm"))


def read_station_dir(spark: SparkSession, folder: str, catalog: str, start=None, end=None, max_mm=1000.0) -> DataFrame:
    """Every CSV of a folder: date column datetime or date, value rainfall, precip_mm or rain.

    Headers differ per file, so lines are read as text and each file's own header maps
    its columns; files lacking either column are skipped.
    """
    raw = spark.read.text(folder, pathGlobFilter="*.csv")
    pos = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    d = raw.select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^﻿", "").alias("line"), pos.alias("pos"))
    d = d.where(~F.lower("file").endswith("stations.csv"))
    head = d.groupBy("file").agg(F.min_by("line", "pos").alias("h"), F.min("pos").alias("p"))
    names = F.transform(F.split("h", ","), lambda x: F.lower(F.trim(F.regexp_replace(x, '"', ""))))

    def at(options):
        p = F.lit(None).cast("bigint")
        for o in reversed(options):
            p = F.when(F.array_contains(F.col("n"), o), F.array_position("n", o)).otherwise(p)
        return p
    head = head.withColumn("n", names).withColumn("di", at(["datetime", "date"])).withColumn("vi", at(["rainfall", "precip_mm", "rain"])).where("di is not null and vi is not null")
    j = d.join(head.select("file", "p", "di", "vi"), "file").where(F.col("pos") > F.col("p"))
    cells = F.transform(F.split("line", ",", -1), lambda x: F.regexp_replace(x, '"', ""))
    rows = j.select("file", F.get(cells, F.col("di").cast("int") - 1).alias("date_text"), F.get(cells, F.col("vi").cast("int") - 1).alias("cell"))
    rows = rows.where(F.length(F.trim("date_text")) > 0)
    return station_days(station_file_rows(rows, match_files(rows, read_catalog(spark, catalog)), max_mm=max_mm), start, end)
