"""Usage, health and cool-down calculations on a request log.

Input: ``requests(event_id, key, ts, tokens, ok, error_code)``. Look-backs of limited length
run per key and time bucket with a halo; unlimited ones use block-wise scans, so a key that
makes a third of all requests is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..session import materialize
from .ordering import (CLAMPED, clamped, clamped_at, clamped_fold, clamped_then, fold_in_blocks, in_blocks, ordinal,
                       running, unchanged, with_halo)
from .packing import greedy_slots

ORDER = ["micros", "event_id"]
MAX_COOLDOWN = 150


def _micros(ts: Column, requests: DataFrame) -> Column:
    """Microseconds; a timestamp without zone is counted as it stands, whatever the session's zone."""
    if isinstance(requests.schema["ts"].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)
    return F.unix_micros(ts)


def _timed(requests: DataFrame) -> DataFrame:
    return requests.withColumn("micros", _micros(F.col("ts"), requests))


def _server_error() -> Column:
    return F.coalesce(F.col("error_code").isin(rules.SERVER_ERRORS), F.lit(False))


def _rate_limited() -> Column:
    return F.coalesce(F.col("error_code") == 429, F.lit(False))


def rolling_usage(requests: DataFrame, seconds: int = 60, bucket_seconds: int = 600) -> DataFrame:
    """Tokens of the key in the ``seconds`` up to each request (a request exactly that old is out).

    Every request adds its tokens when it comes and takes them away when it is that old, so one running sum over both
    gives the use: linear in the requests, however many fall into the look-back.
    """
    rows = with_halo(_timed(requests), "micros", seconds, bucket_seconds)
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    turns = F.array(F.struct(F.col("micros").alias("at"), tokens.alias("change"), F.lit(True).alias("comes")),
                    F.struct((F.col("micros") + seconds * 1_000_000).alias("at"), (-tokens).alias("change"),
                             F.lit(False).alias("comes")))
    turned = rows.withColumn("_t", F.explode(turns))
    so_far = W.partitionBy("key", "_bucket").orderBy("_t.at").rangeBetween(W.unboundedPreceding, W.currentRow)
    return turned.withColumn("used", F.sum("_t.change").over(so_far)).where(~F.col("_halo") & F.col("_t.comes")) \
        .select("event_id", "key", "ts", "tokens", "used")


def minute_usage(requests: DataFrame) -> DataFrame:
    used = requests.groupBy("key", F.window("ts", "1 minute").alias("w")).agg(
        F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))
    return used.select(
        "key", F.col("w.start").alias("minute"), "requests", "tokens",
        (F.col("requests") > rules.MINUTE_REQUESTS).alias("over_requests"),
        (F.col("tokens") > rules.MINUTE_TOKENS).alias("over_tokens"),
        (F.col("requests") > rules.CORE_MINUTE_REQUESTS).alias("over_core"))


def min_interval_violations(requests: DataFrame, seconds: int = rules.MIN_CALL_SECONDS,
                            bucket_seconds: int = 600) -> DataFrame:
    """Requests that follow the key's previous one by less than ``seconds``."""
    rows = with_halo(_timed(requests), "micros", seconds, bucket_seconds)
    previous = F.lag("micros").over(W.partitionBy("key", "_bucket").orderBy(*ORDER))
    return rows.withColumn("gap_micros", F.col("micros") - previous) \
        .where(~F.col("_halo") & (F.col("gap_micros") < seconds * 1_000_000)) \
        .select("event_id", "key", "ts", "gap_micros")


def _failure_step() -> Column:
    """Change of the failure count: a rate limit is counted by the mark and by the record."""
    return F.when(F.col("ok"), -1).when(_rate_limited(), 2).otherwise(1)


def _health_step() -> Column:
    return F.when(F.col("ok"), 5).when(_rate_limited(), -25).when(_server_error(), -15).otherwise(-10)


def health_steps(requests: DataFrame) -> DataFrame:
    """Requests with ``micros`` and what each adds to its key's health and failure count."""
    return _timed(requests).withColumns({"health_step": _health_step().cast("long"),
                                         "failure_step": _failure_step().cast("long")})


def key_health(requests: DataFrame) -> DataFrame:
    """Final health (100 at the start, kept within 0 and 100) and failure count (never below 0)."""
    blocked = in_blocks(_timed(requests), ["key"], ORDER, "health")
    return clamped_fold(blocked, ["key"], ORDER, {
        "health": (100, _health_step(), 0, 100), "failures": (0, _failure_step(), 0, 1 << 40)})


def cooldown_intervals(requests: DataFrame) -> DataFrame:
    """Cool-downs started by rate limits and server errors: base seconds times failures, at most five.

    A count that never drops below zero is the running sum minus its lowest value so far.
    """
    blocked = in_blocks(_timed(requests), ["key"], ORDER, "cooldown")
    summed = running(blocked, ["key"], ORDER, "_s", _failure_step().cast("long"))
    lowest = running(summed, ["key"], ORDER, "_low", F.col("_s"), "min")
    count = F.col("_s") - F.least(F.col("_low"), F.lit(0))
    at_mark = F.when(_rate_limited(), count - 1).otherwise(count)
    seconds = F.when(_rate_limited(), 30).otherwise(10) * F.least(at_mark, F.lit(5))
    return lowest.where(_rate_limited() | _server_error()).select(
        "event_id", "key", "ts", "micros", at_mark.alias("failures"), seconds.alias("seconds"),
        (F.col("micros") + seconds * 1_000_000).alias("until_micros"))


def cooldown_conflicts(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """Requests made while the key's latest cool-down was still running.

    A new mark replaces the previous one, so only the last mark before a request counts. No
    interval is longer than ``MAX_COOLDOWN`` seconds, which bounds the look-back.
    """
    calls = _timed(requests).select("event_id", "key", "ts", "micros", F.lit(None).cast("long").alias("until_micros"))
    marks = intervals.select("event_id", "key", "ts", "micros", "until_micros")
    # a request that is itself a mark must be judged by the marks before it: calls sort first on equal time
    both = calls.withColumn("mark", F.lit(0)).unionByName(marks.withColumn("mark", F.lit(1)))
    rows = with_halo(both, "micros", MAX_COOLDOWN, 4 * MAX_COOLDOWN)
    before = W.partitionBy("key", "_bucket").orderBy("micros", "event_id", "mark") \
        .rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("latest", F.last("until_micros", ignorenulls=True).over(before)) \
        .where(~F.col("_halo") & (F.col("mark") == 0) & (F.col("micros") < F.col("latest"))) \
        .select("event_id", "key", "ts", (F.col("latest") - F.col("micros")).alias("remaining_micros"))


def consecutive_errors(requests: DataFrame) -> DataFrame:
    """Errors since the key's last success, at every request: running errors minus the running
    errors at that success."""
    blocked = in_blocks(_timed(requests), ["key"], ORDER, "streak")
    failed = running(blocked, ["key"], ORDER, "_f", F.when(F.col("ok"), 0).otherwise(1).cast("long"))
    marked = running(failed, ["key"], ORDER, "_m", F.when(F.col("ok"), F.col("_f")), "max")
    return marked.select("event_id", "key", "ts", "ok",
                         (F.col("_f") - F.coalesce("_m", F.lit(0))).alias("streak"))


_SUMS = ["successes", "errors", "tokens", "recent_tokens", "minute_requests", "minute_tokens"]


def _key_unit(now: Column) -> Column:
    """What one request does to the state of its key."""
    def count(condition):
        return F.coalesce(condition, F.lit(False)).cast("long")

    def sum_if(condition):
        return F.when(condition, F.coalesce("tokens", F.lit(0))).otherwise(0).cast("long")
    recent = F.col("ts") > now - F.make_interval(secs=F.lit(60))
    minute = F.date_trunc("minute", "ts") == F.date_trunc("minute", now)
    marked = _rate_limited() | _server_error()
    sums = {"successes": count(F.col("ok")), "errors": count(~F.col("ok")), "tokens": sum_if(F.lit(True)),
            "recent_tokens": sum_if(recent), "minute_requests": count(minute), "minute_tokens": sum_if(minute)}
    return F.struct(
        *[value.alias(name) for name, value in sums.items()], F.col("ok").alias("any_ok"), count(~F.col("ok")).alias("streak"),
        clamped(_health_step(), 0, 100).alias("health"), clamped(_failure_step(), 0).alias("failures"),
        F.when(marked, F.struct(clamped(F.lit(1), 0).alias("count"), F.col("micros").alias("at"),
                                F.when(_rate_limited(), 30).otherwise(10).cast("long").alias("base"))).alias("mark"),
        F.col("micros").alias("last"))


def _key_same() -> Column:
    none = f"struct<count:{CLAMPED},at:bigint,base:bigint>"
    return F.struct(*[F.lit(0).cast("long").alias(name) for name in _SUMS], F.lit(False).alias("any_ok"),
                    F.lit(0).cast("long").alias("streak"), unchanged().alias("health"), unchanged().alias("failures"),
                    F.lit(None).cast(none).alias("mark"), F.lit(None).cast("long").alias("last"))


def _key_then(a: Column, b: Column) -> Column:
    """State after ``a`` and then ``b``. The count at the last mark follows from the count that ``a`` leaves."""
    mark = F.when(b["mark"].isNotNull(), F.struct(
        clamped_then(a["failures"], b["mark"]["count"]).alias("count"), b["mark"]["at"].alias("at"),
        b["mark"]["base"].alias("base"))).otherwise(a["mark"])
    return F.struct(
        *[(a[name] + b[name]).alias(name) for name in _SUMS], (a["any_ok"] | b["any_ok"]).alias("any_ok"),
        F.when(b["any_ok"], b["streak"]).otherwise(a["streak"] + b["streak"]).alias("streak"),
        clamped_then(a["health"], b["health"]).alias("health"), clamped_then(a["failures"], b["failures"]).alias("failures"),
        mark.alias("mark"), F.greatest(a["last"], b["last"]).alias("last"))


def key_state(requests: DataFrame, now: Column) -> DataFrame:
    """State of every key at ``now``: totals, health, failures, error streak, cool-down, use of the minute against its
    limits, and both selection scores. One ordered pass: counts, streak, clamped scores and the last cool-down mark are
    one state that combines, so a key with a third of all requests is folded in chunks and nothing is joined."""
    past = _timed(requests.where(F.col("ts") <= now))
    folded = fold_in_blocks(in_blocks(past, ["key"], ORDER, "key-state"), ["key"], ORDER, _key_unit(now), _key_same(), _key_then)
    state, mark = F.col("state"), F.col("state.mark")
    now_micros = _micros(now, requests)
    until = mark["at"] + mark["base"] * F.least(clamped_at(mark["count"], 0), F.lit(5)) * 1_000_000
    flat = folded.select(
        "key", *[state[name].alias(name) for name in _SUMS], state["streak"].alias("streak"),
        clamped_at(state["health"], 100).alias("health"), clamped_at(state["failures"], 0).alias("failures"),
        F.greatest(F.coalesce(until - now_micros, F.lit(0)), F.lit(0)).alias("cooldown_micros"),
        (now_micros - state["last"]).alias("idle_micros"))
    health_score = F.col("health") - F.col("recent_tokens") / rules.TOKENS_PER_MINUTE * 50 - F.col("failures") * 10
    usage_score = (F.col("minute_requests") / rules.MINUTE_REQUESTS + F.col("minute_tokens") / rules.MINUTE_TOKENS
                   + F.col("streak") * 0.5)
    free = ((F.col("minute_requests") < rules.MINUTE_REQUESTS) & (F.col("minute_tokens") < rules.MINUTE_TOKENS)
            & (F.col("streak") < 3))
    ready = (F.col("cooldown_micros") == 0) & (F.col("recent_tokens") <= rules.TOKENS_PER_MINUTE) \
        & (F.col("idle_micros") >= rules.MIN_CALL_SECONDS * 1_000_000)
    return flat.select("*", (F.col("cooldown_micros") > 0).alias("in_cooldown"),
                       (F.col("cooldown_micros") / 1_000_000).alias("cooldown_seconds"),
                       F.lit(rules.MINUTE_REQUESTS).alias("requests_limit"), F.lit(rules.MINUTE_TOKENS).alias("tokens_limit"),
                       health_score.alias("health_score"), usage_score.alias("usage_score"), free.alias("available"),
                       ready.alias("ready"))


def ranked_keys(state: DataFrame) -> DataFrame:
    """Every key with its ``place`` by health score (highest first) and its ``usage_place`` by usage score (lowest
    first); ties go to the smaller key. Places are counted in blocks, so no task sorts all keys."""
    stored = materialize(state, "key-state")
    for name, order in (("place", F.desc("health_score")), ("usage_place", F.asc("usage_score"))):
        placed = ordinal(stored.select("key", "health_score", "usage_score"), [], [order, F.asc("key")], name, name)
        stored = stored.join(placed.select("key", (F.col(name) + 1).cast("int").alias(name)), "key")
    return stored


def file_batches(files: DataFrame, size: int = rules.BATCH_FILES) -> DataFrame:
    """Batches of ``size`` files per repository in path order."""
    return ordinal(files.select("repo", "file_path"), ["repo"], ["file_path"], "at", "batches") \
        .select("repo", "file_path", F.floor(F.col("at") / size).cast("long").alias("batch"))


def token_slots(requests: DataFrame, budget: int = rules.MINUTE_TOKENS) -> DataFrame:
    """Slot of each request when a key's requests of a minute fill slots of ``budget`` tokens one after the other, with
    the tokens its slot has ``used`` by then: at most the budget, or one request alone."""
    minutes = _timed(requests).select(
        "event_id", "key", "micros", "tokens", F.date_trunc("minute", "ts").cast(requests.schema["ts"].dataType).alias("minute"))
    return greedy_slots(minutes, ["key", "minute"], ORDER, F.col("tokens"), budget, "slots") \
        .select("event_id", "key", "minute", "tokens", "slot", "used")


def token_estimates(text: Column) -> dict[str, Column]:
    return {"quarter": F.floor(F.length(text) / 4).cast("long") + 100,
            "half": F.floor(F.length(text) / 2).cast("long") + 200,
            "words": F.regexp_count(text, F.lit(r"\S+")) * 1.3}


def time_estimate(files: Column, keys: Column) -> Column:
    """Readable processing time: 30 seconds per file, at most eight-fold parallel."""
    seconds = files * 30 / F.least(keys * 2, F.lit(8))
    whole = F.floor(seconds).cast("long")
    return (F.when(keys == 0, "No LLM processing")
            .when(seconds < 60, F.concat(F.lit("~"), whole, F.lit("s")))
            .when(seconds < 3600, F.concat(F.lit("~"), F.floor(seconds / 60), F.lit("m "), whole % 60, F.lit("s")))
            .otherwise(F.concat(F.lit("~"), F.floor(seconds / 3600), F.lit("h "),
                                F.floor((whole % 3600) / 60), F.lit("m"))))
