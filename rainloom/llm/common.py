"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of this package."""
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session: a cluster sizes them to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_repeats(df: DataFrame, most: int = 64) -> DataFrame:
    """The same rows with a column `part`: rows repeated wholly are counted before they are shuffled and come back in parts of at most `most`.

    A hash of all columns and the part then spreads a row that a third of the table repeats.
    """
    cols = df.columns
    g = df.groupBy(*cols).agg(F.count("*").alias("_n")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {most}"))))
    return g.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(most).cast("long"), F.col("_n") - F.col("part") * most)))).select(*cols, "part")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], by: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most `most` bytes of column `by`, or of one row: what a task holds does not follow the rows of a batch."""
    for b in batches:
        if b.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(by)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
                yield b.slice(at, end - at)
                at = end


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, by: str | None = "text") -> DataFrame:
    """Apply fn to Arrow batches, sliced by the bytes of a column; empty batches never reach it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, by) if by else batches:
            if b.num_rows:
                yield fn(b)

    return df.mapInArrow(run, schema)
