"""State of keys in one combinable pass, and the rolling sum, against a replay of the log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_scale_paths import by_key, frame, log

from repolumen.operators import requestlog


def replay(items, now):
    state = {"successes": 0, "errors": 0, "tokens": 0, "recent": 0, "minute": 0, "used": 0, "streak": 0, "health": 100, "failures": 0}
    until, last = 0, 0
    for _, _, at, tokens, ok, code in items:
        if at > now:
            break
        last = at
        state["successes" if ok else "errors"] += 1
        state["tokens"] += tokens
        state["recent"] += tokens if at > now - 60_000_000 else 0
        if at // 60_000_000 == now // 60_000_000:
            state["minute"] += 1
            state["used"] += tokens
        state["streak"] = 0 if ok else state["streak"] + 1
        if ok:
            state["health"], state["failures"] = min(100, state["health"] + 5), max(0, state["failures"] - 1)
            continue
        if code in (429, 503):
            state["failures"] += 1
            until = at + (30 if code == 429 else 10) * min(state["failures"], 5) * 1_000_000
            state["health"] = max(0, state["health"] - 15)
        if code != 503:
            state["failures"] += 1
            state["health"] = max(0, state["health"] - 10)
    left = max(0, until - now)
    return (*state.values(), left, left == 0 and state["recent"] <= 3000 and now - last >= 1_000_000) if last else None


@pytest.mark.parametrize("chunk", [5, 4096])
def test_key_state_equals_replay(spark, monkeypatch, chunk):
    monkeypatch.setattr("repolumen.operators.ordering.CHUNK_ROWS", chunk)
    rows = log(2500, 21)
    df = frame(spark, rows)
    cooling = 0
    for at in (rows[900][2] + 300_000, rows[2000][2], rows[-1][2] + 7_000_000):
        state = requestlog.key_state(df, F.timestamp_micros(F.lit(at)))
        got = {r.key: (r.successes, r.errors, r.tokens, r.recent_tokens, r.minute_requests, r.minute_tokens, r.streak,
                       r.health, r.failures, r.cooldown_micros, r.ready) for r in state.collect()}
        want = {key: replay(items, at) for key, items in by_key(rows).items()}
        assert got == {key: v for key, v in want.items() if v}
        assert all((r.in_cooldown, r.cooldown_seconds) == (r.cooldown_micros > 0, r.cooldown_micros / 1e6) for r in state.collect())
        cooling += sum(v[-2] > 0 for v in got.values())
    assert cooling > 3


def test_key_state_joins_nothing(spark):
    plan = requestlog.key_state(frame(spark, log(50)), F.lit("2030-01-01").cast("timestamp"))._jdf.queryExecution().toString()
    assert "Join" not in plan


def test_rolling_sum_is_exact_and_linear(spark):
    rows = [(i, i % 2, 1_700_000_000_000_000 + (i // 3) * 250_000, i % 17, True, None) for i in range(6000)]
    df = frame(spark, rows)
    got = {r.event_id: r.used for r in requestlog.rolling_usage(df).collect()}
    for items in by_key(rows).values():
        lo = total = 0
        for n, r in enumerate(items):
            total += r[3]
            while items[lo][2] <= r[2] - 60_000_000:
                total -= items[lo][3]
                lo += 1
            later = sum(x[3] for x in items[n + 1: n + 4] if x[2] == r[2])
            assert got[r[0]] == total + later
    plan = requestlog.rolling_usage(df)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan.lower() and "-59999999" not in plan
