"""DuckDB SQL for the near-duplicate join and the suffix dedup, written from their contracts and not from their methods."""

from __future__ import annotations

from granary.llm.common import WORD

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(words: int = 5, percent: int = 75) -> str:
    """All pairs that share a shingle are counted, so this is for small tables. Equal sets are one class, whose pairs aren't spelled out."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words - 1}], ' ')))) END AS s FROM d),
classes AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
met AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c
  AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n GROUP BY ALL),
links AS (SELECT a, b FROM met WHERE 100 * k >= {percent} * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT edges.b, reach.r FROM reach JOIN edges ON edges.a = reach.c WHERE reach.r < edges.b),
least AS (SELECT c, min(r) AS component_id FROM reach GROUP BY c)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least USING (c)"""


def suffix_dedup(span: int = 50) -> str:
    """Every string of `span` bytes of every document meets its equals, as hex digits."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, unnest(range(0, length(h) // 2 - {span} + 1)) AS p, h FROM d WHERE length(h) >= {2 * span}),
hashed AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * span})) AS k FROM strings),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM hashed) WHERE least < doc_id),
steps AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM hits),
runs AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > {span} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM steps),
spans AS (SELECT doc_id, r, min(p) AS a, max(p) + {span} AS b FROM runs GROUP BY doc_id, r),
kept AS (SELECT doc_id, r, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY r), 0) AS since, a FROM spans),
parts AS (SELECT kept.doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY r) AS before, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM kept JOIN d ON kept.doc_id = d.doc_id GROUP BY kept.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN parts ON d.doc_id = parts.doc_id"""
