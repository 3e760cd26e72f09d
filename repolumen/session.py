"""Spark session, shared scratch space and partition helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def get_spark(app: str = "repolumen", cpus: int | str | None = None, **conf) -> SparkSession:
    """Session for local runs; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_MASTER" not in os.environ and cpus is not None:
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus))
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall
    back to a folder of its own, because executors elsewhere could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="repolumen-scratch-")
    return _LOCAL_SCRATCH[app]


def _app_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark).rstrip('/')}/repolumen/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables this application has written to the shared folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_app_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, for a table or archive of this application."""
    return f"{_app_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut and
    later branches read columns from parquet instead of repeating the work."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread an input that arrives in fewer splits than there are cores.

    Streams and large inputs already have many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows that stand for much work each, such as names of files, dealt to all tasks.

    The number of partitions is given: adaptive execution merges others by their size in bytes, and names are so small
    that one task would get all files.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)
