"""Query op9_set_join and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.llm.common import table
from citeweave.llm.licences import BLOCK, PHRASES, STRIDE, TEMPLATES, scan_licences


def op9_set_join(spark, sf_dir):
    out = scan_licences(table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["word"])
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), "base_labels", "labels", F.round("score", 9).alias("score"))


_phrases = ", ".join(f"('{p}', {len(p.split())}, '{x}')" for p, x in PHRASES.items())
_templates = ", ".join(f"({k}, {t.split()!r}, '{x}')" for k, (t, x) in enumerate(TEMPLATES.items()))
#: The smallest template takes so many shared words.
_vocabulary = sorted({w for t in TEMPLATES for w in t.split()})
_least = min(-(-len(set(t.split())) * 4 // 5) for t in TEMPLATES)
QUERIES = {"op9_set_join": op9_set_join}
ORACLE = {
    "op9_set_join": rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
ph(p, n, label) AS (VALUES {_phrases}),
pl AS (SELECT doc_id, i - 1 AS word, label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0) x JOIN ph ON ws[i] = split_part(p, ' ', 1) AND array_to_string(ws[i:i+n-1], ' ') = p),
b AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM pl GROUP BY 1),
l AS (SELECT doc_id, ln, regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS ln FROM d)),
k AS (SELECT doc_id, ln, a, list_distinct(ws[a+1:a+{BLOCK}]) AS s FROM (SELECT doc_id, ln, ws, unnest(CASE WHEN len(ws) > {BLOCK} THEN range(0, len(ws) - {BLOCK} + {STRIDE}, {STRIDE}) ELSE [0] END) AS a FROM l)),
te(k, words, label) AS (VALUES {_templates}),
m AS (SELECT doc_id, ln, a, te.k, label, len(list_intersect(s, list_distinct(words))) AS shared, len(list_distinct(words)) AS size FROM (SELECT * FROM k WHERE len(list_intersect(s, {_vocabulary!r})) >= {_least}) k JOIN te ON true),
best AS (SELECT doc_id, label, shared / size AS share FROM m WHERE 1000 * shared >= 800 * size QUALIFY row_number() OVER (PARTITION BY doc_id, ln, a ORDER BY shared DESC, shared / size DESC, k) = 1),
bb AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(share) AS share FROM best GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(coalesce(b.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(bb.labels, [])))), ',') AS labels,
  round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END, 9)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN bb USING (doc_id)
"""
}
