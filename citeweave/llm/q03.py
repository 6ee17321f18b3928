"""Query op3_odd_sketches and its SQL."""

from __future__ import annotations

from citeweave.llm.common import table
from citeweave.llm.near_dedup import near_duplicates


def op3_odd_sketches(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


QUERIES = {"op3_odd_sketches": op3_odd_sketches}
ORACLE = {
    "op3_odd_sketches": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 2 THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1])) WHEN len(ws) = 1 THEN ws ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
l2 AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS id, doc_id AS seen FROM n UNION SELECT r.id, l2.b FROM reach r JOIN l2 ON l2.a = r.seen)
SELECT id AS doc_id, any_value(n.n) AS n_shingles, min(seen) AS component_id, id = min(seen) AS kept FROM reach JOIN n ON n.doc_id = id GROUP BY id
"""
}
