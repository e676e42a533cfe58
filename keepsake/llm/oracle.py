"""DuckDB statements that state the same rows as the registered queries."""

from __future__ import annotations

from keepsake.llm import mixing, token_counts

_MIX = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(source, chr(0)) AS s, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         md5(coalesce(text, '')) AS h, greatest(coalesce(length(text), 0), 1)::BIGINT AS c FROM documents
), placed AS (
  SELECT *, sum(c) OVER (PARTITION BY s ORDER BY k, doc_id, h ROWS UNBOUNDED PRECEDING) - c AS start FROM sized
), totals AS (
  SELECT s, sum(c)::BIGINT AS total FROM sized GROUP BY s
), weighed AS (
  SELECT s, total, greatest(round(sqrt(total) * sqrt(sqrt(total)) / sum(sqrt(total) * sqrt(sqrt(total))) OVER ()
         * {mixing.CYCLE}), 1)::BIGINT AS w, row_number() OVER (ORDER BY s) AS i FROM totals
), listed AS (
  SELECT list(w ORDER BY i) AS ws, sum(w)::BIGINT AS a, count(*) AS n FROM weighed
), sched AS (
  SELECT 0::BIGINT AS t, [0::BIGINT for x in ws] AS served, NULL::BIGINT AS pick, ws, a, n FROM listed
  UNION ALL
  SELECT t + 1, [served[j] + (j = pick)::BIGINT for j in range(1, n + 1)], pick, ws, a, n FROM (
    SELECT t, served, ws, a, n, list_min([((served[j] + 1) * a + ws[j] - 1) // ws[j] * 1000000 + j
      for j in range(1, n + 1) if served[j] < ws[j] AND served[j] * a // ws[j] <= t]) % 1000000 AS pick
    FROM sched WHERE t < a)
), slots AS (
  SELECT pick AS i, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS nth FROM sched WHERE pick IS NOT NULL
), once AS (
  SELECT w.*, l.a, (total + {mixing.BLOCK_CHARS - 1}) // {mixing.BLOCK_CHARS} AS need FROM weighed w, listed l
), horizon AS (
  SELECT max((need - 1) // w * a + slot + 1) AS t FROM once JOIN slots ON once.i = slots.i AND nth = (need - 1) % w
), served AS (
  SELECT o.s, o.i, o.w, o.total, o.a, t // o.a * o.w + count(slot) FILTER (slot < t % o.a) AS blocks
  FROM once o JOIN slots ON o.i = slots.i, horizon GROUP BY o.s, o.i, o.w, o.total, o.a, t
), copies AS (
  SELECT p.doc_id, p.source, v.*, p.start, unnest(range((blocks * {mixing.BLOCK_CHARS} - 1 - start)::BIGINT // total + 1)) AS e
  FROM placed p JOIN served v ON p.s = v.s
), blocked AS (
  SELECT *, (start + e * total)::BIGINT AS begin, (start + e * total)::BIGINT // {mixing.BLOCK_CHARS} AS b FROM copies
)
SELECT doc_id, source, e::BIGINT AS mix_epoch, b AS mix_block, (b // w * a + slot)::BIGINT AS mix_slot, begin AS mix_start
FROM blocked JOIN slots ON blocked.i = slots.i AND nth = b % w
"""

_URLS = r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r(h, q, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT p.*, h || q AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || q) DESC NULLS LAST) AS nth
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE nth = 1
"""


_ARCHIVE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS x,
         max(page_id) OVER w AS top, row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) AS nth
  FROM p WINDOW w AS (PARTITION BY body)
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT
    >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN nth > 1 THEN top END AS refers_to
FROM d
"""


def _counts() -> str:
    words, pieces = token_counts.PATTERNS["words-1"], token_counts.PATTERNS["pieces-1"]
    return f"""
WITH kept AS (
  SELECT source, lang, regexp_replace(coalesce(text, ''), '[*%$&#!]{{2,}}', '', 'g') AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1
), counted AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(text, '{words}')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(text, '{pieces}')) FROM kept
)
SELECT source, lang, version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM counted GROUP BY ALL
"""


def statements() -> dict[str, str]:
    return {"op1_mixing": _MIX, "op6_url_rules": _URLS, "rollup_by_rule": _counts(), "op11_warc": _ARCHIVE}
