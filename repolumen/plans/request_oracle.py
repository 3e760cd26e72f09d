"""Checking SQL for the request log."""

from __future__ import annotations

from . import inputs
from .registry import oracle, part
from .rollup_oracle import big

part("requests", "", inputs.REQUESTS_SQL)
part("shared", "requests", "SELECT * EXCLUDE (event_type) REPLACE (event_type AS key) FROM requests")
part("few", "requests", "SELECT * REPLACE (key % 3 AS key) FROM requests")
STEP = "CASE WHEN ok THEN -1 WHEN error_code = 429 THEN 2 ELSE 1 END"
HEALTH = "CASE WHEN ok THEN 5 WHEN error_code = 429 THEN -25 WHEN error_code = 503 THEN -15 ELSE -10 END"

oracle("rolling_usage", "shared", f"""SELECT event_id, key, ts, tokens, {big('sum(tokens) OVER w')} AS used FROM shared
  WINDOW w AS (PARTITION BY key ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)""")
oracle("minute_usage", "requests", f"""SELECT key, minute, requests, tokens, requests > 60 AS over_requests, tokens > 6000 AS over_tokens,
  requests > 15 AS over_core FROM (SELECT key, date_trunc('minute', ts) AS minute, count(*) AS requests, {big('sum(tokens)')} AS tokens
  FROM requests GROUP BY ALL)""")
oracle("min_interval_violations", "shared", """SELECT event_id, key, ts, gap_micros FROM (
  SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY key ORDER BY ts, event_id) AS gap_micros FROM shared)
  WHERE gap_micros < 1000000""")


def folded(source: str) -> str:
    """Row-by-row fold with a recursive query over each key's requests."""
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM {source}),
f AS (SELECT key, 0::BIGINT AS n, 100::BIGINT AS health, 0::BIGINT AS failures, 0::BIGINT AS event_id FROM (SELECT DISTINCT key FROM o)
  UNION ALL SELECT f.key, o.n, least(100, greatest(0, health + {HEALTH})), greatest(0, failures + {STEP}), o.event_id
  FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1)
SELECT * FROM f WHERE n > 0"""


part("fold", "requests", folded("requests"))
part("fold_few", "few", folded("few"))
oracle("key_health_fold", "fold", f"""SELECT key, {big('arg_max(health, n)')} AS health, {big('arg_max(failures, n)')} AS failures
  FROM fold GROUP BY key""")


def intervals(source: str, fold: str) -> str:
    return f"""SELECT *, epoch_us(ts) + seconds * 1000000 AS until_micros FROM (
  SELECT event_id, key, ts, marked AS failures, CASE WHEN error_code = 429 THEN 30 ELSE 10 END * least(marked, 5) AS seconds FROM (
    SELECT r.*, CASE WHEN error_code = 429 THEN failures - 1 ELSE failures END AS marked FROM {source} r JOIN {fold} USING (event_id, key)
    WHERE error_code IN (429, 503)))"""


part("cooldowns", "requests fold", intervals("requests", "fold"))
part("cooldowns_few", "few fold_few", intervals("few", "fold_few"))
oracle("cooldown_intervals", "cooldowns", """SELECT event_id, key, ts, CAST(failures AS BIGINT) AS failures,
  CAST(seconds AS BIGINT) AS seconds, CAST(until_micros AS BIGINT) AS until_micros FROM cooldowns""")
oracle("cooldown_conflicts", "few cooldowns_few", """
SELECT event_id, key, ts, CAST(until_micros - epoch_us(ts) AS BIGINT) AS remaining_micros FROM (
  SELECT r.*, (SELECT arg_max(until_micros, (c.ts, c.event_id)) FROM cooldowns_few c
    WHERE c.key = r.key AND (c.ts, c.event_id) < (r.ts, r.event_id)) AS until_micros FROM few r)
WHERE epoch_us(ts) < until_micros""")
oracle("consecutive_errors", "requests", """SELECT event_id, key, ts, ok,
  CAST(CASE WHEN ok THEN 0 ELSE count(*) FILTER (NOT ok) OVER (PARTITION BY key, island ORDER BY ts, event_id) END AS BIGINT) AS streak
FROM (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY key ORDER BY ts, event_id) AS island FROM requests)""")
part("past", "requests", "SELECT *, max(ts) OVER () AS now FROM requests")
part("fold_past", "past", folded("past"))
part("state", "past fold_past", f"""SELECT *, health - recent_tokens / 3000 * 50 - failures * 10 AS health_score,
  minute_requests / 60 + minute_tokens / 6000 + streak * 0.5::DOUBLE AS usage_score,
  minute_requests < 60 AND minute_tokens < 6000 AND streak < 3 AS available FROM (
  SELECT key, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS errors, {big('sum(tokens)')} AS tokens,
    {big("coalesce(sum(tokens) FILTER (ts > now - INTERVAL 60 SECOND), 0)")} AS recent_tokens,
    count(*) FILTER (date_trunc('minute', ts) = date_trunc('minute', now)) AS minute_requests,
    {big("coalesce(sum(tokens) FILTER (date_trunc('minute', ts) = date_trunc('minute', now)), 0)")} AS minute_tokens,
    count(*) FILTER (NOT ok AND (last_ok IS NULL OR (ts, event_id) > last_ok)) AS streak
  FROM past LEFT JOIN (SELECT key, max((ts, event_id)) AS last_ok FROM past WHERE ok GROUP BY key) USING (key) GROUP BY key)
JOIN (SELECT key, {big('arg_max(health, n)')} AS health, {big('arg_max(failures, n)')} AS failures FROM fold_past GROUP BY key) USING (key)""")
oracle("key_score_rank", "state", """SELECT key, CAST(row_number() OVER (ORDER BY health_score DESC, key) AS INTEGER) AS place,
  CAST(row_number() OVER (ORDER BY usage_score, key) AS INTEGER) AS usage_place, round(health_score, 6) AS health_score, round(usage_score, 6) AS usage_score FROM state""")
part("cooldowns_past", "past fold_past", intervals("past", "fold_past"))
part("remaining", "cooldowns_past past", """SELECT key, greatest(0, arg_max(until_micros, (ts, event_id)) - any_value(m)) AS micros
  FROM cooldowns_past, (SELECT epoch_us(max(now)) AS m FROM past) GROUP BY key""")
oracle("key_stats", "state remaining past", f"""SELECT key, successes, errors, tokens, recent_tokens, streak, health, failures, available,
  coalesce(micros, 0) = 0 AND recent_tokens <= 3000 AND idle >= 1000000 AS ready, coalesce(micros, 0) > 0 AS in_cooldown,
  round(coalesce(micros, 0) / 1000000, 6) AS cooldown_seconds, minute_requests, minute_tokens, 60::INTEGER AS requests_limit,
  6000::INTEGER AS tokens_limit
FROM state JOIN (SELECT key, epoch_us(max(now)) - epoch_us(max(ts)) AS idle FROM past GROUP BY key) USING (key) LEFT JOIN remaining USING (key)""")
oracle("token_estimate", "files", r"""SELECT repo, file_path, file_id, length(content) // 4 + 100 AS quarter, length(content) // 2 + 200 AS half,
  round(len(regexp_extract_all(content, '\S+')) * 1.3::DOUBLE, 6) AS words FROM files""")
# Row by row: a request that does not fit into the open slot begins the next one.
oracle("batch_by_budget", "few", """SELECT event_id, key, minute, tokens, slot, used FROM (
  WITH RECURSIVE o AS (SELECT event_id, key, date_trunc('minute', ts) AS minute, tokens,
    row_number() OVER (PARTITION BY key, date_trunc('minute', ts) ORDER BY ts, event_id) AS n FROM few),
  f AS (SELECT event_id, key, minute, tokens, n, 0::BIGINT AS slot, tokens::BIGINT AS used FROM o WHERE n = 1
    UNION ALL SELECT o.event_id, o.key, o.minute, o.tokens, o.n, slot + CASE WHEN used + o.tokens > 100 THEN 1 ELSE 0 END,
      CASE WHEN used + o.tokens > 100 THEN o.tokens ELSE used + o.tokens END
    FROM f JOIN o ON o.key = f.key AND o.minute = f.minute AND o.n = f.n + 1)
  SELECT * FROM f)""")
oracle("file_batches", "facts", """SELECT repo, file_path,
  (row_number() OVER (PARTITION BY repo ORDER BY file_path) - 1) // 5 AS batch FROM facts WHERE function_count + api_count > 0""")
oracle("time_estimate", "kept", """SELECT repo, files, keys, CASE WHEN keys = 0 THEN 'No LLM processing'
  WHEN s < 60 THEN '~' || floor(s)::BIGINT || 's' WHEN s < 3600 THEN '~' || floor(s / 60)::BIGINT || 'm ' || (floor(s)::BIGINT % 60) || 's'
  ELSE '~' || floor(s / 3600)::BIGINT || 'h ' || floor((floor(s)::BIGINT % 3600) / 60)::BIGINT || 'm' END AS estimate
FROM (SELECT *, files * 30 / least(keys * 2, 8) AS s FROM (SELECT repo, count(*) AS files FROM kept GROUP BY repo),
  (SELECT unnest([0, 1, 3, 5])::INTEGER AS keys))""")
