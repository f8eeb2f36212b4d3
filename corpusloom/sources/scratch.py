"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(shared_folder, "own"):
        shared_folder.own = tempfile.mkdtemp(prefix="corpusloom-")
    return f"file://{shared_folder.own}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs: it does so when the driver collects their plans as
    garbage, which events that wait to be logged still hold, and which a quiet driver does not do by itself."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later jobs start from the files, so a lost
    executor costs no recomputation. The shuffle files that only led to the table go."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    release(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path there)."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`cut` that nothing reads any more."""
    for df in tables:
        fs, path = file_system(df.sparkSession, df.cut_path)
        fs.delete(path, True)
    if tables:
        release(tables[0].sparkSession)


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all cores where it comes from fewer files than there are cores, else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if len(df.inputFiles()) < cores else df
