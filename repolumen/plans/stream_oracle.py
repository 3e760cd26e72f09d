"""Checking SQL of the streaming forms: what a watermark five minutes behind the last request lets through."""

from __future__ import annotations

from .registry import oracle, part
from .request_oracle import folded
from .rollup_oracle import big

part("mark", "requests", "SELECT *, max(ts) OVER () - INTERVAL 5 MINUTE AS mark FROM requests")
oracle("facts_stream", "facts", """SELECT repo, file_path, function_count, api_count, lines_of_code, is_backend, file_purpose FROM facts""")
oracle("minute_usage_stream", "mark", f"""SELECT key, minute, requests, tokens, requests > 60 AS over_requests, tokens > 6000 AS over_tokens
  FROM (SELECT key, date_trunc('minute', ts) AS minute, count(*) AS requests, {big('sum(tokens)')} AS tokens, any_value(mark) AS mark
    FROM mark GROUP BY ALL) WHERE minute + INTERVAL 1 MINUTE <= mark""")
oracle("sliding_usage_stream", "mark", f"""SELECT key, s AS start, s + INTERVAL 60 SECOND AS "end", {big('sum(tokens)')} AS used FROM (
  SELECT key, tokens, mark, time_bucket(INTERVAL 10 SECOND, ts) - INTERVAL 1 SECOND * (10 * unnest(range(6))) AS s FROM mark)
  GROUP BY key, s HAVING s + INTERVAL 60 SECOND <= any_value(mark)""")
part("passed", "mark", """SELECT * FROM mark WHERE (epoch_us(ts) // 1000000 + 1) * 1000 <= epoch_us(mark) // 1000""")
part("fold_passed", "passed", folded("passed"))
oracle("key_health_stream", "fold_passed", f"""SELECT key, {big('arg_max(health, n)')} AS health, {big('arg_max(failures, n)')} AS failures,
  {big('max(n)')} AS requests FROM fold_passed GROUP BY key""")
oracle("job_status_stream", "jobs", """SELECT analysis_id, created_at, event_id, status FROM (
  SELECT *, max(created_at) OVER () AS newest FROM jobs
  QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY created_at DESC, event_id DESC) = 1)
  WHERE created_at >= newest - INTERVAL 24 HOUR""")
