"""Checking SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

from . import mixing, token_rollup

#: Base32 of a hexadecimal SHA-1: four times five bytes, eight digits of five bits each.
_DIGEST = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    (((('0x' || substr(h, (1 + 10 * (i // 8))::BIGINT, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31))::BIGINT, 1)), '')"""

OP7 = f"""SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_DIGEST} AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
  max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)"""

_WEIGHTS = ", ".join(f"{w}.0::DOUBLE" for w in mixing.WEIGHTS)
OP9 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|17'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
    [{_WEIGHTS}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)}] AS w FROM d GROUP BY source),
t AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM s WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN cap <= level * w THEN cap
    ELSE (SELECT arg_min(level, cap / w) FROM t WHERE cap > level * w) * w END AS target FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM g),
k AS (SELECT d.doc_id, d.size, r.*, floor(ratio)::BIGINT AS whole, target - floor(ratio)::BIGINT * source_size AS owed,
    (u / (1 - u)) / (p / (1 - p)) AS key FROM (SELECT *, greatest(1e-9, least(1 - 1e-9::DOUBLE, ratio - floor(ratio))) AS p FROM r) r
  JOIN d ON d.source IS NOT DISTINCT FROM r.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key)::BIGINT AS upto, sum(size) OVER (PARTITION BY source, key)::BIGINT AS tied FROM k)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN owed > 0 AND upto - tied / 2.0::DOUBLE <= owed THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""


def _counted(body: str) -> str:
    return (f"len(regexp_extract_all({body}, '[^\\x20\\x09-\\x0D]+')) AS words, len(regexp_extract_all({body}, "
            f"'[A-Za-z\\x{{80}}-\\x{{10FFFF}}]+|[^\\x20\\x09-\\x0DA-Za-z\\x{{80}}-\\x{{10FFFF}}]')) AS pieces")


#: What remains after all commits: one of each group of equal texts, counted without licence lines; null texts stay.
OP4 = f"""SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens FROM (
  SELECT source, lang, unnest(['words-v1', 'pieces-v1']) AS tokenizer, unnest([words, pieces]) AS tokens FROM (
    SELECT source, lang, {_counted("body")} FROM (
      SELECT source, lang, coalesce(regexp_replace(text, 'Licensed under[^\\n]*', '', 'g'), '') AS body FROM documents
      QUALIFY text IS NULL OR doc_id = min(doc_id) OVER (PARTITION BY text))))
GROUP BY ALL"""

#: The crc32 polynomial applied to each half byte.
_HALVES = []
for _half in range(16):
    for _ in range(4):
        _half = _half >> 1 ^ (0xEDB88320 if _half & 1 else 0)
    _HALVES.append(_half)


def _crc32(text: str) -> str:
    """crc32 of the UTF-8 bytes of a text of letters below U+0100, half byte by half byte, the low half first."""
    halves = (f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c) & 15, ord(c) >> 4] "
              "ELSE [(192 + (ord(c) >> 6)) & 15, 12, ord(c) & 15, 8 + ((ord(c) >> 4) & 3)] END))")
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {halves}::BIGINT[]), lambda a, b: "
            f"xor(a >> 4, list_extract({_HALVES}::BIGINT[], 1 + (xor(a, b) & 15)))))")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP13 = f"""WITH RECURSIVE runs AS (SELECT doc_id, translate(r, '{_UPPER}', '{_UPPER.lower()}') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS r FROM documents)
  WHERE length(r) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32("concat(doc_id, ':', run)")} AS h, doc_id FROM runs),
thin AS (SELECT CASE WHEN doc_id IS NOT NULL AND h % 97 = 0
    THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM thin WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(near, (-x.n, near)) AS near, max(x.n) AS near_n
  FROM near JOIN w x ON x.word = near.near GROUP BY near.word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
  CASE WHEN near_n >= 2 * n THEN near_n END::BIGINT AS form_n FROM w LEFT JOIN best ON best.word = w.word),
walk AS (SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN walk ON walk.word = f.word AND next IS NULL"""

ORACLE = {"op4_token_rollup": OP4, "op7_warc": OP7, "op9_mixing": OP9, "op13_spelling": OP13}
assert set(token_rollup.TOKENIZERS) == {"words-v1", "pieces-v1"}
