"""Streaming forms: the batch operators' rules on unbounded input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import rules
from ..operators import facts, requestlog


def facts_stream(files: DataFrame, profile: str = "enhanced") -> DataFrame:
    """File facts of arriving files; extraction keeps no state, so this is the batch plan in append mode."""
    return facts.file_facts(files, profile)


def endpoint_stream(files: DataFrame, profile: str = "enhanced") -> DataFrame:
    return facts.endpoints(files, profile)


def minute_usage_stream(requests: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """Tumbling minute usage; a minute is emitted once the watermark has passed it."""
    used = requests.withWatermark("ts", lateness).groupBy("key", F.window("ts", "1 minute").alias("w")).agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return used.select("key", F.col("w.start").alias("minute"), "requests", "tokens",
                       (F.col("requests") > rules.MINUTE_REQUESTS).alias("over_requests"),
                       (F.col("tokens") > rules.MINUTE_TOKENS).alias("over_tokens"))


def sliding_usage_stream(requests: DataFrame, lateness: str = "5 minutes", seconds: int = 60, step: int = 10) -> DataFrame:
    """Usage in sliding windows, the bucketed form of the rolling sum. A request is in ``seconds / step`` windows, so the
    open windows are many rows: use the RocksDB state store, which keeps them on disk."""
    window = F.window("ts", f"{seconds} seconds", f"{step} seconds")
    return requests.withWatermark("ts", lateness).groupBy("key", window.alias("w")).agg(
        F.sum("tokens").alias("used")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "used")


HEALTH = T.StructType([T.StructField("key", T.LongType()), T.StructField("health", T.LongType()),
                       T.StructField("failures", T.LongType()), T.StructField("requests", T.LongType())])

#: A request is folded once the watermark has passed the end of its bucket of so many microseconds.
BUCKET_MICROS = 1_000_000
#: Waiting requests of a key are kept in chunks of at most so many.
CHUNK_ROWS = 4096
WAITING = ["micros", "event_id", "health_step", "failure_step"]


def _by_time(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort(rows.T[::-1])]


class KeyHealth(StatefulProcessor):
    """Health and failure count per key.

    Clamped additions do not commute, so requests wait until the watermark has passed their bucket's end and are then
    folded by microsecond and id. They wait in chunks, each sorted, under a list of chunks with their earliest time: a
    call of the state store moves a chunk and not a request, and a key has one timer, for its earliest request. Only
    chunks with due requests are read; they are merged in order of time, so a fold holds the chunks that overlap.
    With ``idle_hours`` a key without requests for so long (in event time) starts anew.
    """

    def __init__(self, idle_hours: int | None = None) -> None:
        self.idle_ms = None if idle_hours is None else idle_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.score = handle.getValueState("score", "health long, failures long, requests long, last_ms long")
        self.open = handle.getValueState("open", "firsts array<long>, numbers array<long>")
        self.waiting = handle.getMapState(
            "waiting", "chunk long", "micros array<long>, ids array<long>, health array<long>, failures array<long>")

    def _open_chunks(self) -> list[tuple[int, int]]:
        """Earliest time and number of each chunk."""
        return list(zip(*(self.open.get() or ()), strict=True))

    def _keep(self, rows: np.ndarray, chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Write ``rows`` as chunks and list them with the others."""
        rows, chunks = _by_time(rows), list(chunks)
        number = max((n for _, n in chunks), default=-1) + 1
        for at in range(0, len(rows), CHUNK_ROWS):
            part = rows[at:at + CHUNK_ROWS]
            self.waiting.updateValue((number,), tuple(column.tolist() for column in part.T))
            chunks.append((int(part[0, 0]), number))
            number += 1
        return chunks

    def _wake(self, chunks: list[tuple[int, int]]) -> None:
        """A timer for the end of the earliest request's bucket."""
        self.handle.registerTimer((min(chunks)[0] // BUCKET_MICROS + 1) * BUCKET_MICROS // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        known = chunks = self._open_chunks()
        for batch in rows:
            chunks = self._keep(batch.loc[batch["micros"] >= mark, WAITING].to_numpy("int64"), chunks)
        if len(chunks) > len(known):
            self.open.update(tuple(map(list, zip(*chunks, strict=True))))
            if not known or min(chunks)[0] < min(known)[0]:
                self._wake(chunks)
        yield from ()

    def _due(self, due: list[tuple[int, int]], until: int, left: list[np.ndarray]) -> Iterator[list[int]]:
        """Requests before ``until`` of the chunks ``due`` in order of time; the chunks are removed and their other
        requests go to ``left``."""
        pool, size, folded_at = [], 0, CHUNK_ROWS
        due = sorted(due)
        for place, (_, number) in enumerate(due):
            rows = np.array(self.waiting.getValue((number,)), dtype="int64").T
            self.waiting.removeKey((number,))
            ready = int(np.searchsorted(rows[:, 0], until))
            pool.append(rows[:ready])
            if ready < len(rows):
                left.append(rows[ready:])
            size += ready
            last = place + 1 == len(due)
            if last or size >= folded_at:  # what is later than the next chunk's start waits for it
                merged = _by_time(np.concatenate(pool))
                cut = len(merged) if last else int(np.searchsorted(merged[:, 0], due[place + 1][0]))
                yield from merged[:cut].tolist()
                pool, size = [merged[cut:]], len(merged) - cut
                folded_at = 2 * size + CHUNK_ROWS

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        until = mark * 1000 // BUCKET_MICROS * BUCKET_MICROS
        chunks = self._open_chunks()
        due = [chunk for chunk in chunks if chunk[0] < until]
        start = (100, 0, 0, None)
        health, failures, seen, last = self.score.get() or start
        if due:
            left = []
            for micros, _, gain, step in self._due(due, until, left):
                if self.idle_ms is not None and last is not None and micros // 1000 - last >= self.idle_ms:
                    health, failures, seen, _ = start
                health, failures, seen = max(0, min(100, health + gain)), max(0, failures + step), seen + 1
                last = micros // 1000
            chunks = [chunk for chunk in chunks if chunk[0] >= until]
            if left:
                chunks = self._keep(np.concatenate(left), chunks)
            if chunks:
                self.open.update(tuple(map(list, zip(*chunks, strict=True))))
                self._wake(chunks)
            else:
                self.open.clear()
            self.score.update((health, failures, seen, last))
            if self.idle_ms is not None:
                self.handle.registerTimer(last + self.idle_ms)
            yield pd.DataFrame({"key": [key[0]], "health": [health], "failures": [failures], "requests": [seen]})
        elif not chunks and self.idle_ms is not None and last is not None and last + self.idle_ms <= mark:
            self.score.clear()

    def close(self) -> None:
        pass


def key_health_stream(requests: DataFrame, lateness: str = "5 minutes", idle_hours: int | None = None) -> DataFrame:
    """Health per key after every advance of the watermark; needs the RocksDB state store. Only the columns that the
    fold reads reach the Python workers; requests without an id come first, as in the batch form."""
    steps = requestlog.health_steps(requests.withWatermark("ts", lateness)).where(F.col("micros").isNotNull()).select(
        "key", "ts", F.coalesce("event_id", F.lit(-(1 << 63))).alias("event_id"), "micros", "health_step", "failure_step")
    return steps.groupBy("key").transformWithStateInPandas(
        KeyHealth(idle_hours), HEALTH, outputMode="Update", timeMode="EventTime")


#: Job states are kept in so many buckets by hash; a micro-batch rewrites only those it touches.
STATUS_BUCKETS = 64


def _latest(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("analysis_id").agg(F.max(F.struct("created_at", "event_id", "status")).alias("s")) \
        .select("analysis_id", "s.created_at", "s.event_id", "s.status")


def _within(jobs: DataFrame, newest, hours: int) -> DataFrame:
    """Rows at most ``hours`` older than ``newest``, a literal."""
    return jobs.where(F.col("created_at") >= F.lit(newest) - F.make_interval(hours=F.lit(hours)))


def upsert_status(batch: DataFrame, path: str, hours: int = rules.RETENTION_HOURS, buckets: int = STATUS_BUCKETS) -> None:
    """Merge a micro-batch into the table of latest job states; states past retention are not kept.

    ``data/v=N`` holds the buckets that batch ``N`` rewrote, ``manifest/v=N`` one row per bucket with the version that
    holds it and its newest time. A version counts once its manifest is complete, so readers never see half a batch and
    a repeated batch gives the same table. Versions that the last two manifests do not name are removed. ``buckets``
    must stay the same for the life of a table.
    """
    spark = batch.sparkSession
    version = current_version(spark, path)
    fresh = _latest(batch).withColumn("bucket", F.pmod(F.xxhash64("analysis_id"), F.lit(buckets)).cast("int")).persist()
    try:
        touched = {r.bucket: r.newest for r in fresh.groupBy("bucket").agg(F.max("created_at").alias("newest")).collect()}
        if not touched:
            return
        before = [] if version is None else spark.read.parquet(f"{path}/manifest/v={version}").collect()
        times = [r.newest for r in before] + [t for t in touched.values() if t is not None]
        if not times:
            return
        old = [f"{path}/data/v={r.version}/bucket={r.bucket}" for r in before if r.bucket in touched]
        merged = fresh.drop("bucket")
        if old:
            merged = _latest(merged.unionByName(spark.read.schema(merged.schema).parquet(*old)))
        following = (version or 0) + 1
        data = f"{path}/data/v={following}"
        _within(merged, max(times), hours) \
            .withColumn("bucket", F.pmod(F.xxhash64("analysis_id"), F.lit(buckets)).cast("int")) \
            .repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        written = spark.read.schema(fresh.schema).parquet(data).groupBy("bucket").agg(F.max("created_at").alias("newest")) \
            .select("bucket", F.lit(following).alias("version"), "newest")
        entries = [tuple(r) for r in before if r.bucket not in touched]
        kept = _within(spark.createDataFrame(entries, written.schema).withColumnRenamed("newest", "created_at"),
                       max(times), hours).withColumnRenamed("created_at", "newest")
        written.unionByName(kept).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={following}")
    finally:
        fresh.unpersist()
    _drop_unnamed(spark, path, following)


def _folder(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return [int(n.split("=")[1]) for n in names if n.startswith("v=")]


def _drop_unnamed(spark: SparkSession, path: str, newest: int) -> None:
    """Remove versions that neither the newest manifest nor the one before it names."""
    held = [v for v in _versions(spark, f"{path}/manifest") if v >= newest - 1]
    named = {r.version for v in held for r in spark.read.parquet(f"{path}/manifest/v={v}").select("version").collect()}
    for kind, keep in (("manifest", set(held)), ("data", named)):
        for v in set(_versions(spark, f"{path}/{kind}")) - keep:
            folder, fs = _folder(spark, f"{path}/{kind}/v={v}")
            fs.delete(folder, True)


def current_version(spark: SparkSession, path: str) -> int | None:
    """Newest complete version: the highest one whose manifest was committed."""
    done = []
    for v in _versions(spark, f"{path}/manifest"):
        mark, fs = _folder(spark, f"{path}/manifest/v={v}/_SUCCESS")
        if fs.exists(mark):
            done.append(v)
    return max(done) if done else None


def latest_status(spark: SparkSession, path: str, hours: int = rules.RETENTION_HOURS) -> DataFrame:
    """The latest state of every job within retention."""
    named = spark.read.parquet(f"{path}/manifest/v={current_version(spark, path)}").collect()
    rows = spark.read.parquet(*[f"{path}/data/v={r.version}/bucket={r.bucket}" for r in named])
    return _within(rows, max(r.newest for r in named), hours)


def status_stream(jobs: DataFrame, path: str, checkpoint: str):
    """Start the upsert of job states; restartable from ``checkpoint``."""
    return jobs.writeStream.foreachBatch(lambda batch, _: upsert_status(batch, path)) \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
