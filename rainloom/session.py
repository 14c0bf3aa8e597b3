"""Session helpers: local builder for tests and reliable lineage cuts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the benchmark; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rainloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RAINLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


WRITTEN: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster. Only a local master may go without: it gets a temporary one, which goes at exit."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        current = tempfile.mkdtemp(prefix="spark-checkpoint-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
        sc.setCheckpointDir(current)
    return current


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder of its own below the shared folder; release deletes it with the tables of cut_lineage."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/rainloom-{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and read back.

    The result survives executor loss, and unlike a checkpointed frame it carries no
    constraints of the old plan, which would grow with every round of a loop.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/rainloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables of cut_lineage and the folders of new_folder that this process wrote; call it when results that read them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(WRITTEN)
    while WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
