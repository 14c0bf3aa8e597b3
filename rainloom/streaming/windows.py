"""Structured Streaming twins of the window accumulation, running scores and yearly packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rainloom.operators import stats as ST

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, glob="events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def event_time(ts) -> Column:
    """Zoneless wall-clock time as an instant with the same reading in UTC, whatever the session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts) if isinstance(ts, str) else ts))


def utc_day(ts: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(ts) / 86400).cast("int"))


def reporting_windows(stream: DataFrame, keys, min_count: int, delay="6 hours", ts="ts", rate="rate", hour=3, granule: str | None = None) -> DataFrame:
    """Half-hourly rates to 03:00 windows in append mode.

    A window leaves once the watermark passes its end; a short one leaves with a NULL
    depth. Repeated granules inside the delay are dropped by their id.
    """
    s = stream.withWatermark(ts, delay)
    if granule:
        s = s.dropDuplicatesWithinWatermark([granule])
    w = F.window(ts, "1 day", "1 day", f"{hour} hours")
    g = s.groupBy(*keys, w.alias("w")).agg(F.sum(F.col(rate) * 0.5).alias("_p"), F.count(rate).alias("n_valid"))
    return g.select(*keys, utc_day(F.col("w.end")).alias("date"), F.when(F.col("n_valid") >= min_count, F.col("_p")).alias("precip_mm"), "n_valid")


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain what is available into exactly-once parquet files."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def running_scores(pairs: DataFrame, keys) -> DataFrame:
    """Stateful sums of a paired score, for update mode."""
    return ST.running_pair(pairs, keys)


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Every batch writes its updated sums under its own number, so a replayed batch overwrites itself."""
    def save(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")
    q = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def latest_scores(spark: SparkSession, out: str, keys) -> DataFrame:
    """Latest sums per key turned into metrics."""
    d = spark.read.parquet(f"{out}/batch=*")
    cols = [c for c in d.columns if c not in (*keys, "batch")]
    last = d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("s")).select(*keys, "s.*")
    return ST.finish_pair(last, keys)


def pack_stream(stream: DataFrame, out: str, checkpoint: str, year_of="ts") -> None:
    """Append arriving rows to yearly partitions, batch by batch, with a manifest row per batch and year."""
    def save(batch, number):
        spark = batch.sparkSession
        b = batch.withColumn("year", F.year(year_of)).withColumn("batch", F.lit(number))
        b.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "batch").parquet(f"{out}/data")
        b.groupBy("year").agg(F.count("*").alias("rows"), F.countDistinct(F.to_date(year_of)).alias("days")).write.mode("overwrite").parquet(f"{out}/_manifest/batch={number:08d}")
    q = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
