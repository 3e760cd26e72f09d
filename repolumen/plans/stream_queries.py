"""The streaming forms as queries: a given table is read as a stream until nothing is left, written to the shared folder
and read back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from ..streaming import streams
from . import inputs
from .registry import query

#: State on local disk, with one bound on memory for all stores of an executor; the plain store holds all state in the heap.
ROCKS = {"spark.sql.streaming.stateStore.providerClass":
         "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
         "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true"}


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB."""
    before = {name: spark.conf.get(name, None) for name in ROCKS}
    for name, value in ROCKS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _arriving(df: DataFrame, label: str) -> DataFrame:
    """``df``, written once, as a stream of files."""
    stored = materialize(df, label)
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def _drained(stream: DataFrame, label: str) -> DataFrame:
    """All that the stream appends, from a restartable run that ends when its input does."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    with _on_disk(spark):
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint") \
            .trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def _requests(spark, sf):
    return inputs.requests(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(name):
    return F.col(name).cast("timestamp_ntz").alias(name)


@query("facts_stream")
def _(spark, sf):
    files = inputs.corpus(spark, sf).select("repo", "file_path", "content")
    return _drained(streams.facts_stream(_arriving(files, "stream-files")), "stream-facts").select(
        "repo", "file_path", "function_count", "api_count", "lines_of_code", "is_backend", "file_purpose")


@query("minute_usage_stream")
def _(spark, sf):
    used = _drained(streams.minute_usage_stream(_arriving(_requests(spark, sf), "stream-requests")), "stream-minutes")
    return used.withColumn("minute", _plain("minute"))


@query("sliding_usage_stream")
def _(spark, sf):
    used = _drained(streams.sliding_usage_stream(_arriving(_requests(spark, sf), "stream-requests")), "stream-sliding")
    return used.select("key", _plain("start"), _plain("end"), "used")


@query("key_health_stream")
def _(spark, sf):
    """Health of every key after the requests that the watermark has passed: each update is kept, the last one counts."""
    requests = _arriving(_requests(spark, sf), "stream-requests")
    out = scratch_path(spark, "stream-health")
    with _on_disk(spark):
        streams.key_health_stream(requests).writeStream.outputMode("update").foreachBatch(
            lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")) \
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    updates = spark.read.schema(streams.HEALTH).parquet(f"{out}/data")
    return updates.groupBy("key").agg(F.max(F.struct("requests", "health", "failures")).alias("last")) \
        .select("key", "last.health", "last.failures", "last.requests")


@query("job_status_stream")
def _(spark, sf):
    jobs = inputs.jobs(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    out = scratch_path(spark, "stream-status")
    streams.status_stream(_arriving(jobs, "stream-jobs"), f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return streams.latest_status(spark, f"{out}/table").select("analysis_id", _plain("created_at"), "event_id", "status")
