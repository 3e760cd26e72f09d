"""Streams give the batch results once their input is complete."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from repolumen.operators import facts, requestlog
from repolumen.plans import QUERIES, stream_queries
from repolumen.streaming import streams

REQUEST = "event_id long, key long, ts timestamp, tokens long, ok boolean, error_code int"


def requests(spark):
    rows = [(i, i % 3, 1_700_000_000 + i * 7, i % 50, i % 4 != 0, [429, 503, 400][i % 3] if i % 4 == 0 else None)
            for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, key long, at long, tokens long, ok boolean, error_code int")
    return df.withColumn("ts", F.timestamp_seconds("at")).select("event_id", "key", "ts", "tokens", "ok", "error_code")


def closing(spark):
    """A much later request that moves the watermark past everything else."""
    return spark.sql("SELECT 999L AS event_id, -1L AS key, timestamp_seconds(1800000000) AS ts, 0L AS tokens, true AS ok, "
                     "CAST(NULL AS INT) AS error_code")


def feed(df, path):
    df.coalesce(1).write.mode("append").parquet(str(path))


def drain(stream, spark, name, tmp_path, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode) \
        .option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    query.processAllAvailable()
    return query


def test_minute_and_sliding_usage(spark, tmp_path):
    batch = requests(spark)
    feed(batch, tmp_path / "in")
    source = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in"))
    minute = drain(streams.minute_usage_stream(source), spark, "minute", tmp_path, "append")
    sliding = drain(streams.sliding_usage_stream(source), spark, "sliding", tmp_path, "append")
    feed(closing(spark), tmp_path / "in")
    late = batch.limit(1).withColumn("event_id", F.lit(5000).cast("long")).withColumn("tokens", F.lit(10_000).cast("long"))
    minute.processAllAvailable()
    sliding.processAllAvailable()
    feed(late, tmp_path / "in")
    minute.processAllAvailable()
    sliding.processAllAvailable()
    minute.stop()
    sliding.stop()
    want = {(r.key, r.minute, r.requests, r.tokens) for r in requestlog.minute_usage(batch).collect()}
    assert {(r.key, r.minute, r.requests, r.tokens) for r in spark.table("minute").where("key >= 0").collect()} == want
    assert spark.table("sliding").where("key >= 0").agg(F.sum("used")).first()[0] == 6 * batch.agg(F.sum("tokens")).first()[0]


def test_key_health_stream(spark, tmp_path):
    batch = requests(spark)
    for half in (batch.where("event_id >= 100"), batch.where("event_id < 100")):
        feed(half, tmp_path / "in")  # arrives out of order, within the lateness
    source = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = drain(streams.key_health_stream(source, "1 hour"), spark, "health", tmp_path, "update")
    feed(closing(spark), tmp_path / "in")
    query.processAllAvailable()
    query.stop()
    got = {r.key: (r.health, r.failures) for r in spark.table("health").orderBy("requests").collect()}
    want = {r.key: (r.health, r.failures) for r in requestlog.key_health(batch).collect()}
    assert {k: v for k, v in got.items() if k >= 0} == want


def test_key_health_order_within_a_millisecond(spark, tmp_path):
    """Two requests of one millisecond, ids against time: the fold follows microseconds."""
    rows = [(9, 1, 1_700_000_000_000_100, True, None), (3, 1, 1_700_000_000_000_900, False, 429),
            (4, 2, 1_700_000_000_000_100, False, 429), (1, 2, 1_700_000_000_000_900, True, None)]
    batch = spark.createDataFrame(rows, "event_id long, key long, at long, ok boolean, error_code int").select(
        "event_id", "key", F.timestamp_micros("at").alias("ts"), F.lit(1).cast("long").alias("tokens"), "ok", "error_code")
    feed(batch, tmp_path / "in")
    source = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in"))
    query = drain(streams.key_health_stream(source), spark, "fine_order", tmp_path, "update")
    feed(closing(spark), tmp_path / "in")
    query.processAllAvailable()
    query.stop()
    got = {r.key: (r.health, r.failures) for r in spark.table("fine_order").where("key >= 0").collect()}
    assert got == {1: (75, 2), 2: (80, 1)}
    assert got == {r.key: (r.health, r.failures) for r in requestlog.key_health(batch).collect()}


class _Calls:
    """State variables and timers of one key in memory, and how often they are called."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getValueState(self, name, *schemas):
        return _Held(self)

    getMapState = getValueState

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


class _Held:
    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def _at(self, key=()):
        self.calls.calls += 1
        return key

    def get(self):
        return self.rows.get(self._at())

    def update(self, value):
        self.rows[self._at()] = value

    def clear(self):
        self.rows.pop(self._at(), None)

    def getValue(self, key):
        return self.rows[self._at(key)]

    def updateValue(self, key, value):
        self.rows[self._at(key)] = value

    def removeKey(self, key):
        del self.rows[self._at(key)]


class _Mark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


@pytest.mark.parametrize("chunk", [4096, 7])
def test_key_health_calls_the_store_per_chunk(monkeypatch, chunk):
    """Requests of many seconds, out of order, in several batches and advances: few calls, and the order of time."""
    monkeypatch.setattr(streams, "CHUNK_ROWS", chunk)
    rng, calls = random.Random(5), _Calls()
    rows = [(rng.randrange(3000) * 500_000, k, *rng.choice([(5, -1), (-25, 2), (-10, 1)])) for k in range(3000)]
    health = streams.KeyHealth()
    health.init(calls)
    frames = [pd.DataFrame(rows[at:at + 500], columns=streams.WAITING) for at in range(0, 3000, 500)]
    list(health.handleInputRows((1,), iter(frames), _Mark(0)))
    got = []
    for mark in (300_250, 300_900, 900_000, 1_500_000):  # the second advance ends no bucket
        for frame in health.handleExpiredTimer((1,), _Mark(mark), None):
            got.append(tuple(frame.iloc[0]))
    want, state = [], (100, 0, 0)
    for before, until in ((0, 300), (300, 900), (900, 1500)):
        for micros, _, gain, step in sorted(r for r in rows if before <= r[0] // 1_000_000 < until):
            state = max(0, min(100, state[0] + gain)), max(0, state[1] + step), state[2] + 1
        want.append((1, *state))
    assert got == want and not health.waiting.rows and not health.open.rows
    assert calls.calls < (100 if chunk == 4096 else 3000)


def test_key_health_forgets_idle_keys(spark, tmp_path):
    def at(event, seconds):
        return spark.sql(f"SELECT {event}L AS event_id, 1L AS key, timestamp_seconds({seconds}) AS ts, 1L AS tokens, "
                         "false AS ok, 429 AS error_code")

    start = 1_700_000_000
    feed(at(1, start), tmp_path / "in")
    source = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in"))
    query = drain(streams.key_health_stream(source, "1 minute", idle_hours=1), spark, "idle", tmp_path, "update")
    for part in (at(2, start + 600), at(3, start + 600 + 3600), closing(spark)):
        feed(part, tmp_path / "in")
        query.processAllAvailable()
    query.stop()
    got = sorted((r.requests, r.health) for r in spark.table("idle").where("key = 1").collect())
    assert got == [(1, 75), (1, 75), (2, 50)]


def test_facts_stream(spark, files, tmp_path):
    batch = files({"a.py": '@app.get("/x")\ndef f(): pass', "b.js": "function g() {}"})
    feed(batch, tmp_path / "in")
    source = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    drain(streams.facts_stream(source), spark, "facts", tmp_path, "append").stop()
    drain(streams.endpoint_stream(source), spark, "endpoints", tmp_path, "append").stop()
    assert sorted(spark.table("facts").collect()) == sorted(facts.file_facts(batch).collect())
    assert [r.path for r in spark.table("endpoints").collect()] == ["/x"]


def test_status_upserts(spark, tmp_path):
    def jobs(*rows):
        return spark.createDataFrame(rows, "analysis_id long, at long, status string, event_id long").select(
            "analysis_id", F.timestamp_seconds("at").alias("created_at"), "status", "event_id")

    day = 86_400
    path, cp = str(tmp_path / "table"), str(tmp_path / "cp")
    schema = jobs((1, 1, "x", 1)).schema
    feed(jobs((1, 1000, "pending", 1), (2, 1000, "pending", 2), (1, 1000, "processing", 3)), tmp_path / "in")
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.status_stream(source, path, cp).awaitTermination()
    assert {(r.analysis_id, r.status) for r in streams.latest_status(spark, path).collect()} == {(1, "processing"), (2, "pending")}
    feed(jobs((1, 1000 + day // 2, "completed", 4), (3, 1001 + day, "pending", 5)), tmp_path / "in")
    streams.status_stream(source, path, cp).awaitTermination()
    assert {(r.analysis_id, r.status) for r in streams.latest_status(spark, path).collect()} == {(1, "completed"), (3, "pending")}


def test_status_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    def jobs(*rows):
        return spark.createDataFrame(rows, "analysis_id long, at long, status string, event_id long").select(
            "analysis_id", F.timestamp_seconds("at").alias("created_at"), "status", "event_id")

    path = str(tmp_path / "table")
    streams.upsert_status(jobs(*[(i, 1000 + i, "pending", i) for i in range(40)]), path, buckets=8)
    again = jobs((7, 2000, "completed", 100))
    for _ in range(3):  # a repeated batch changes nothing
        streams.upsert_status(again, path, buckets=8)
        got = {r.analysis_id: r.status for r in streams.latest_status(spark, path).collect()}
        assert got == {i: "completed" if i == 7 else "pending" for i in range(40)}
    manifest = spark.read.parquet(f"{path}/manifest/v=4").collect()
    assert len(manifest) == 8 and sorted(r.version for r in manifest) == [1] * 7 + [4]
    assert sorted(p.name for p in (tmp_path / "table" / "data").iterdir() if p.name.startswith("v=")) == ["v=1", "v=3", "v=4"]


@pytest.mark.parametrize("name", ["sliding_usage_stream", "minute_usage_stream"])
def test_usage_queries_keep_state_on_disk(spark, tmp_path, monkeypatch, name):
    """Open windows outgrow a heap; the session's own store stays as it was."""
    rows = [(i, 1_700_000_000 + 40 * i, i % 3, "view", 1.5) for i in range(100)]
    spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double").select(
        "event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value") \
        .write.parquet(str(tmp_path / "events.parquet"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before, plain = spark.conf.get(store), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    monkeypatch.setattr(stream_queries, "scratch_path", lambda spark, label: str(tmp_path / label))
    spark.conf.set(store, plain)
    try:
        assert QUERIES[name](spark, str(tmp_path)).count() > 0
        assert spark.conf.get(store) == plain
    finally:
        spark.conf.set(store, before)
    kept = [p.suffix for p in tmp_path.glob("stream-*/checkpoint/state/**/*") if p.is_file()]
    assert ".zip" in kept and ".delta" not in kept
