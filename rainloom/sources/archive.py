"""Year-resumable packing, ensemble archives, dump unions, chunk merges and score sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rainloom.functions import ensemble as EN, scalar as S
from rainloom.operators import checks as C

MANIFEST = "year int, rows bigint, days bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    m = f"{path}/_manifest"
    return spark.read.parquet(m) if _exists(spark, m) else spark.createDataFrame([], MANIFEST)


def pending_years(df: DataFrame, done: DataFrame, day="day") -> DataFrame:
    """Years of the source that are not in the manifest, with their completeness."""
    y = df.groupBy(F.year(day).alias("year")).agg(F.countDistinct(day).alias("days"), F.count("*").alias("rows"))
    full = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1)))
    return y.withColumn("complete", F.col("days") == full).join(done.select("year"), "year", "left_anti")


def pack(df: DataFrame, path: str, day="day", require_complete=True) -> list[int]:
    """Write the years not yet recorded in one job, a partition each, and record them after they are written.

    A rerun after a failure rewrites only unrecorded years: partitions are overwritten
    dynamically and the manifest rows come last.
    """
    spark = df.sparkSession
    todo = sorted(pending_years(df, manifest(spark, path), day).collect(), key=lambda r: r["year"])
    for r in todo:
        if require_complete and not r["complete"]:
            raise ValueError(f"year {r['year']} has {r['days']} days")
    years = [r["year"] for r in todo]
    if years:
        part = df.where(F.year(day).isin(years)).withColumn("year", F.year(day))
        part.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(f"{path}/data")
        spark.createDataFrame([(r["year"], r["rows"], r["days"]) for r in todo], MANIFEST).write.mode("append").parquet(f"{path}/_manifest")
    return years


def derived_moments(df: DataFrame, land: Column | None = None, members="members") -> DataFrame:
    """Ensemble mean and SD (one degree of freedom removed), on land only."""
    on = F.lit(True) if land is None else land
    return df.withColumn("ensemble_mean", F.when(on, EN.mean(members))).withColumn("ensemble_std", F.when(on, EN.std(members)))


def write_ensemble(df: DataFrame, path: str, methods, day="day", method="method", members="members", land=None) -> None:
    """Season archive partitioned by method; refuses an existing path and an incomplete season."""
    s = df.groupBy(method).agg(F.countDistinct(day).alias("days"), (F.datediff(F.max(day), F.min(day)) + 1).alias("span"), F.min(F.size(members)).alias("m"))
    rows = s.collect()
    if {r[method] for r in rows} != set(methods):
        raise ValueError("method list and fields differ")
    if any(r["days"] != r["span"] for r in rows):
        raise ValueError("days are not contiguous")
    if any(r["m"] < 2 for r in rows):
        raise ValueError("an ensemble needs two members")
    derived_moments(df, land, members).write.mode("errorifexists").partitionBy(method).parquet(path)


def union_seasons(frames: list[DataFrame], day="day", method="method", grid=()) -> DataFrame:
    """Seasons of one archive: no day may come from two of them, and all hold the same methods and grid columns (mask included)."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_season", F.lit(i))
        out = f if out is None else out.unionByName(f)
    for same in ([method], list(grid)):
        out = C.require_same(out, "_season", len(frames), same) if same else out
    out = out.withColumn("_seasons", F.size(F.collect_set("_season").over(W.partitionBy(method, day))))
    return out.where(C.guard(F.col("_seasons") > 1, F.concat(F.lit("overlapping day "), F.col(day).cast("string")))).drop("_season", "_seasons")


def union_dumps(frames: dict, labels=("period", "fold"), keys=("date", "station_id", "method")) -> DataFrame:
    """Fold dumps labelled and united; one row per date, station and method, and no station may move between dumps."""
    out = None
    for lab, f in frames.items():
        for n, v in zip(labels, lab):
            f = f.withColumn(n, F.lit(v))
        out = f if out is None else out.unionByName(f)
    if {"lat", "lon"} <= set(out.columns):
        w = W.partitionBy("station_id")
        gap = F.greatest(*(F.max(c).over(w) - F.min(c).over(w) for c in ("lat", "lon")))
        out = out.withColumn("_gap", gap).where(C.guard(F.col("_gap") > 1e-6, F.concat(F.lit("coordinates differ for station "), F.col("station_id").cast("string")))).drop("_gap")
    return C.require_unique(out, list(keys))


def moving_stations(df: DataFrame, key="station_id", tolerance=1e-6) -> DataFrame:
    """Stations whose coordinates differ between files."""
    g = df.groupBy(key).agg((F.max("lat") - F.min("lat")).alias("dlat"), (F.max("lon") - F.min("lon")).alias("dlon"))
    return g.where((F.col("dlat") > tolerance) | (F.col("dlon") > tolerance))


def merge_days(frames: list[DataFrame], keys) -> DataFrame:
    """Per-day rows of all chunks; a day that two chunks hold stops the job."""
    return C.require_unique(unite_rows(frames), list(keys))


def merge_chunks(chunks: DataFrame, keys, values, days: str, worst=(), agreed=(), expected: int | None = None) -> DataFrame:
    """Day-weighted mean of finite values, worst-case diagnostics by maximum, text that must agree, and the number of days expected of each key."""
    aggs = [F.sum(days).alias(days)]
    for v in values:
        x = S.finite(v)
        aggs.append(S.ratio(F.sum(x * F.col(days)), F.sum(F.when(x.isNotNull(), F.col(days))).cast("double")).alias(v))
    aggs += [F.max(S.finite(v)).alias(v) for v in worst]
    for v in agreed:
        aggs.append(F.when(F.countDistinct(v) <= 1, F.max(v)).otherwise(F.raise_error(F.lit(f"inconsistent {v}")).cast(dict(chunks.dtypes)[v])).alias(v))
    out = chunks.groupBy(*keys).agg(*aggs)
    return out if expected is None else out.where(C.guard(F.col(days) != expected, F.concat(F.lit("unexpected number of days "), F.col(days).cast("string"))))


# ---- sinks ----------------------------------------------------------------

def finite_columns(df: DataFrame) -> DataFrame:
    """Non-finite numbers become NULL, as the report formats require."""
    return df.select(*[S.finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def unite_rows(frames: list[DataFrame]) -> DataFrame:
    """Rows with different keys under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_json(df: DataFrame, path: str) -> None:
    finite_columns(df).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_csv(frames: list[DataFrame], path: str) -> None:
    finite_columns(unite_rows(frames)).write.mode("errorifexists").csv(path, header=True)


def markdown_lines(df: DataFrame, columns, digits=3) -> DataFrame:
    """Table lines of a report; numbers are formatted on the executors."""
    def cell(c):
        t = dict(df.dtypes)[c]
        v = F.format_string(f"%.{digits}f", F.col(c)) if t in ("double", "float") else F.col(c).cast("string")
        return F.coalesce(F.when(F.col(c).isNotNull(), v), F.lit("n/a"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))


def latex_lines(df: DataFrame, columns, digits=3) -> DataFrame:
    m = markdown_lines(df, columns, digits)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^\| ", ""), r" \|$", ""), r" \| ", " & ")
    return m.select(F.concat(F.regexp_replace(body, "_", r"\\_"), F.lit(r" \\")).alias("line"))
