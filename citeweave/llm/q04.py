"""Query op4_phrase_automata and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.llm.common import table
from citeweave.llm.repeated_phrases import remove_repeats


def op4_phrase_automata(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op4_phrase_automata": op4_phrase_automata}
ORACLE = {
    "op4_phrase_automata": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i+34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM p) WHERE c > 1),
st AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 35) AS gap FROM r),
cov AS (SELECT doc_id, list_distinct(flatten(list(list_transform(range(greatest(i, i + 35 - gap), i + 35), lambda x: x)))) AS c FROM st GROUP BY doc_id),
k AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(c), 0)::BIGINT AS n_removed,
      CASE WHEN c IS NULL THEN array_to_string(ws, ' ') END AS whole FROM w LEFT JOIN cov USING (doc_id)),
e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE doc_id IN (SELECT doc_id FROM cov)),
ce AS (SELECT doc_id, unnest(c) AS i FROM cov),
kw AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN ce ON e.doc_id = ce.doc_id AND e.i = ce.i GROUP BY e.doc_id)
SELECT k.doc_id, n_words, n_removed, sha256(coalesce(whole, kept, '')) AS kept_sha256 FROM k LEFT JOIN kw ON kw.doc_id = k.doc_id
"""
}
