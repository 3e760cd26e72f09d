"""Queries on the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, requestlog
from ..session import materialize
from . import inputs
from .registry import query


def _now(requests):
    """The end of the log, so that all of it is read."""
    return F.lit(requests.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")


def _shared_keys(spark, sf):
    """The log keyed by event type: few, dense keys."""
    return inputs.requests(spark, sf).drop("key").withColumnRenamed("event_type", "key")


@query("rolling_usage")
def _(spark, sf):
    return requestlog.rolling_usage(_shared_keys(spark, sf))


@query("minute_usage")
def _(spark, sf):
    return requestlog.minute_usage(inputs.requests(spark, sf))


@query("min_interval_violations")
def _(spark, sf):
    return requestlog.min_interval_violations(_shared_keys(spark, sf))


@query("key_health_fold")
def _(spark, sf):
    return requestlog.key_health(inputs.requests(spark, sf))


@query("cooldown_intervals")
def _(spark, sf):
    return requestlog.cooldown_intervals(inputs.requests(spark, sf)) \
        .select("event_id", "key", "ts", "failures", "seconds", "until_micros")


@query("cooldown_conflicts")
def _(spark, sf):
    log = _one_key(spark, sf)
    return requestlog.cooldown_conflicts(log, requestlog.cooldown_intervals(log))


def _one_key(spark, sf):
    """The log as if a few services shared the keys, so that cool-downs meet requests."""
    return inputs.requests(spark, sf).withColumn("key", F.col("key") % 3)


@query("consecutive_errors")
def _(spark, sf):
    return requestlog.consecutive_errors(inputs.requests(spark, sf))


@query("key_score_rank")
def _(spark, sf):
    requests = inputs.requests(spark, sf)
    return requestlog.ranked_keys(requestlog.key_state(requests, _now(requests))).select(
        "key", "place", "usage_place", F.round("health_score", 6).alias("health_score"),
        F.round("usage_score", 6).alias("usage_score"))


@query("key_stats")
def _(spark, sf):
    requests = inputs.requests(spark, sf)
    return requestlog.key_state(requests, _now(requests)).select(
        "key", "successes", "errors", "tokens", "recent_tokens", "streak", "health", "failures", "available", "ready",
        "in_cooldown", F.round("cooldown_seconds", 6).alias("cooldown_seconds"), "minute_requests", "minute_tokens",
        "requests_limit", "tokens_limit")


@query("token_estimate")
def _(spark, sf):
    rows = inputs.corpus(spark, sf)
    estimates = requestlog.token_estimates(F.col("content"))
    return rows.select("repo", "file_path", "file_id", estimates["quarter"].alias("quarter"),
                       estimates["half"].alias("half"), F.round(estimates["words"], 6).alias("words"))


@query("batch_by_budget")
def _(spark, sf):
    return requestlog.token_slots(_one_key(spark, sf), budget=100)


@query("file_batches")
def _(spark, sf):
    stored = materialize(facts.file_facts(inputs.corpus(spark, sf)), "facts")
    return requestlog.file_batches(stored.where("function_count > 0 OR api_count > 0"))


@query("time_estimate")
def _(spark, sf):
    counts = facts.select_files(inputs.corpus(spark, sf)).groupBy("repo").agg(F.count("*").alias("files"))
    keyed = counts.select("repo", "files", F.explode(F.array(*[F.lit(k) for k in (0, 1, 3, 5)])).alias("keys"))
    return keyed.select("repo", "files", "keys", requestlog.time_estimate(F.col("files"), F.col("keys")).alias("estimate"))
