"""Input views for the registered queries, derived from the given tables.

Each SQL text below runs unchanged in Spark and in the checking engine, so both sides of
a comparison start from the same rows. The texts contain no backslashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

FILES_SQL = """
SELECT doc_id AS file_id,
  'repo' || CAST(doc_id % 20 AS VARCHAR(20)) AS repo,
  CASE CAST(floor(doc_id / 20) AS BIGINT) % 10
    WHEN 0 THEN 'src/api/' WHEN 1 THEN 'src/components/' WHEN 2 THEN 'backend/services/'
    WHEN 3 THEN 'backend/models/' WHEN 4 THEN 'web/pages/api/' WHEN 5 THEN 'lib/utils/'
    WHEN 6 THEN 'config/' WHEN 7 THEN 'web/node_modules/pkg/' WHEN 8 THEN 'core/' ELSE '' END
  || 'f' || CAST(doc_id AS VARCHAR(20))
  || CASE doc_id % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.ts' WHEN 3 THEN '.tsx'
       WHEN 4 THEN '.py' WHEN 5 THEN '.jsx' ELSE '.md' END AS file_path,
  CASE WHEN doc_id % 7 IN (0, 4) THEN
       'import os' || chr(10) || 'from fastapi import FastAPI' || chr(10)
    || 'import lib' || CAST(doc_id % 13 AS VARCHAR(20)) || chr(10)
    || 'KEY = os.getenv("KEY_' || CAST(doc_id % 5 AS VARCHAR(20)) || '")' || chr(10) || chr(10)
    || '@app.get("/items' || CAST(doc_id % 11 AS VARCHAR(20)) || '/{item_id}")' || chr(10)
    || 'def get_item_' || CAST(doc_id AS VARCHAR(20)) || '(item_id: int, q: str) -> dict:' || chr(10)
    || '    ' || repeat(chr(34), 3) || 'Return one item.' || repeat(chr(34), 3) || chr(10)
    || '    if q:' || chr(10) || '        return {}' || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN
         '@app.route("/old/<uid>", methods=["GET", "POST"])' || chr(10)
      || 'def old_' || CAST(doc_id AS VARCHAR(20)) || '(uid):' || chr(10)
      || '    for a in b:' || chr(10) || '        while c:' || chr(10)
      || '            if d:' || chr(10) || '                pass' || chr(10) ELSE '' END
    || '# ' || replace(text, chr(10), chr(10) || '# ')
  ELSE
       'import React from "react";' || chr(10)
    || 'import x from "./f' || CAST(doc_id - 200 AS VARCHAR(20)) || '";' || chr(10)
    || 'const e = process.env.VAR_' || CAST(doc_id % 6 AS VARCHAR(20)) || ';' || chr(10)
    || 'app.post("/v' || CAST(doc_id % 9 AS VARCHAR(20)) || '/:uid/:pid", h);' || chr(10)
    || '// note ' || CAST(doc_id AS VARCHAR(20)) || chr(10)
    || 'const h' || CAST(doc_id AS VARCHAR(20)) || ' = (req, res) => {' || chr(10)
    || '  if (req) { return res; }' || chr(10) || '};' || chr(10)
    || CASE WHEN doc_id % 4 = 0 THEN 'export default function handler(req, res) {}' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 2 = 0 THEN 'return <Panel><Row/></Panel>;' || chr(10) ELSE '' END
    || '// ' || replace(text, chr(10), chr(10) || '// ')
  END
  || CASE WHEN doc_id % 97 = 0 THEN chr(10) || '# ' || repeat('x', 100001) ELSE '' END AS content
FROM documents
WHERE text IS NOT NULL
"""

# Files that the first text lacks: pages and components without routes, and named services.
MORE_FILES_SQL = """
SELECT doc_id + 1000000000 AS file_id,
  'repo' || CAST(CAST(floor(doc_id / 5) AS BIGINT) % 20 AS VARCHAR(20)) AS repo,
  CASE doc_id % 3 WHEN 0 THEN 'web/components/C' WHEN 1 THEN 'web/pages/P' ELSE 'ui/w' END
    || CAST(doc_id AS VARCHAR(20)) || '.jsx' AS file_path,
  'import Chart from "chart.js/auto";' || chr(10) || 'import { a } from "@scope/pkg";' || chr(10)
    || 'import next from "next/link";' || chr(10) || '/* view ' || CAST(doc_id AS VARCHAR(20)) || ' */' || chr(10)
    || 'export const View' || CAST(doc_id AS VARCHAR(20)) || ' = (props, size = 2) => {' || chr(10)
    || '  return <Card/>;' || chr(10) || '};' || chr(10)
    || 'function help' || CAST(doc_id AS VARCHAR(20)) || '(a, b) { return a; }' || chr(10)
    || 'const wait' || CAST(doc_id AS VARCHAR(20)) || ' = async (a) => {};' || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN 'export class Model' || CAST(doc_id AS VARCHAR(20)) || ' {}' || chr(10) ELSE '' END
    || '// ' || replace(text, chr(10), chr(10) || '// ') AS content
FROM documents
WHERE text IS NOT NULL AND doc_id % 5 = 1
UNION ALL
SELECT doc_id + 2000000000 AS file_id,
  'repo' || CAST(CAST(floor(doc_id / 9) AS BIGINT) % 15 AS VARCHAR(20)) AS repo,
  'services/' || CASE doc_id % 4 WHEN 0 THEN 'chat_' WHEN 1 THEN 'auth_' WHEN 2 THEN 'video_' ELSE 'document_' END
    || CAST(doc_id AS VARCHAR(20)) || '.py' AS file_path,
  'from flask import Flask' || chr(10) || 'import groq' || chr(10)
    || CASE WHEN doc_id % 3 < 2 THEN 'port = ' || CAST(8000 + doc_id % 90 AS VARCHAR(20)) || chr(10) ELSE '' END
    || CASE WHEN doc_id % 5 = 0 THEN 'class Store' || CAST(doc_id AS VARCHAR(20)) || ':' || chr(10) || '    def load(self, key):' || chr(10)
      || '        return key' || chr(10) || '    def keep(self):' || chr(10) || '        pass' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 11 = 3 THEN 'return (' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 2 = 0 THEN 'import tensorflow' ELSE 'from google import maps' END || chr(10) || chr(10)
    || '@app.route("/s' || CAST(doc_id % 7 AS VARCHAR(20)) || '")' || chr(10)
    || 'def serve_' || CAST(doc_id AS VARCHAR(20)) || '():' || chr(10) || '    pass' || chr(10) || chr(10)
    || 'def help_' || CAST(doc_id AS VARCHAR(20)) || '(request, n: int = 1):' || chr(10)
    || '    ' || repeat(chr(34), 3) || 'Help' || chr(10) || '    more' || chr(10) || '    ' || repeat(chr(34), 3) || chr(10)
    || '    return n' || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') AS content
FROM documents
WHERE text IS NOT NULL AND doc_id % 9 = 4
"""

CORPUS_SQL = FILES_SQL + "UNION ALL" + MORE_FILES_SQL

JAVA_SQL = """
SELECT doc_id AS file_id,
  'repo' || CAST(doc_id % 20 AS VARCHAR(20)) AS repo,
  'src/main/C' || CAST(doc_id AS VARCHAR(20)) || CASE doc_id % 4 WHEN 0 THEN '.py' ELSE '.java' END AS file_path,
  'import java.util.List;' || chr(10)
    || 'import org.lib' || CAST(doc_id % 13 AS VARCHAR(20)) || '.Thing;' || chr(10)
    || 'import com.acme.Tool;' || chr(10)
    || 'public class C' || CAST(doc_id AS VARCHAR(20)) || ' {' || chr(10)
    || '  public static int run' || CAST(doc_id AS VARCHAR(20)) || '(int a, String b) {' || chr(10)
    || '    return a;' || chr(10) || '  }' || chr(10)
    || '  private void stop(' || chr(10) || '      long t) { }' || chr(10)
    || '  /* ' || text || ' */' || chr(10) || '}' || chr(10) AS content
FROM documents
WHERE text IS NOT NULL
"""

REQUESTS_SQL = """
SELECT event_id, user_id AS key, event_type, ts, CAST(floor(value) AS BIGINT) AS tokens, event_type <> 'error' AS ok,
  CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 400 END END AS error_code
FROM events
"""

JOBS_SQL = """
SELECT user_id AS analysis_id, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed'
    ELSE 'completed' END AS status, event_id
FROM events
"""

OUTPUTS_SQL = """
SELECT event_id, 'repo' || CAST(user_id % 20 AS VARCHAR(20)) AS repo,
  CASE WHEN event_type = 'error' THEN 'docs_partial'
    ELSE 'docs_u' || CAST(user_id AS VARCHAR(20)) || '_' || CAST(1704067200 + event_id * 60 AS VARCHAR(20)) END AS name
FROM events
"""

RESPONSES_SQL = """
SELECT 'repo' || CAST(doc_id % 20 AS VARCHAR(20)) AS repo,
  'src/f' || CAST(doc_id AS VARCHAR(20)) || '.py' AS file_path,
  CASE WHEN doc_id % 5 = 0 THEN text ELSE
     'SUMMARY: file ' || CAST(doc_id AS VARCHAR(20)) || chr(10) || '  ' || text || chr(10) || chr(10)
     || 'API_ENDPOINTS: none' || chr(10) || '- GET /x' || CAST(doc_id % 7 AS VARCHAR(20)) || chr(10)
     || 'SETUP_INSTRUCTIONS:' || chr(10) || text || chr(10)
     || CASE WHEN doc_id % 2 = 0 THEN 'SUMMARY: again' || chr(10) || 'more' || chr(10) ELSE '' END
     || 'USAGE_EXAMPLES:' || chr(10) || 'curl ' || CAST(doc_id AS VARCHAR(20)) END AS response
FROM documents
WHERE text IS NOT NULL
"""

ERRORS_SQL = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'busy, try again in ' || CAST(value AS VARCHAR(40)) || 's.'
    WHEN 1 THEN 'try again in ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR(40)) || 'ms' ELSE 'denied' END AS message
FROM events
"""

KEY_LISTS_SQL = """
SELECT doc_id, replace(text, '. ', ';') AS keys FROM documents WHERE text IS NOT NULL
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, source: str, sql: str, *keys: str) -> DataFrame:
    """Run one of the texts above on a given table, spread over the cores by its key."""
    spread(table(spark, sf_dir, source), *keys).createOrReplaceTempView(source)
    return spark.sql(sql)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "documents", CORPUS_SQL, "doc_id")


def java_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "documents", JAVA_SQL, "doc_id")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "documents", RESPONSES_SQL, "doc_id")


def key_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "documents", KEY_LISTS_SQL, "doc_id")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "events", REQUESTS_SQL, "event_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "events", JOBS_SQL, "event_id")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "events", OUTPUTS_SQL, "event_id")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, "events", ERRORS_SQL, "event_id")
