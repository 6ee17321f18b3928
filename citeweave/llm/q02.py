"""Query op2_line_frequency and its SQL."""

from __future__ import annotations

from citeweave.llm import line_frequency as L
from citeweave.llm.common import table


def op2_line_frequency(spark, sf_dir):
    return L.line_frequency_rules(table(spark, sf_dir, "documents")).drop("clean_text")


QUERIES = {"op2_line_frequency": op2_line_frequency}
ORACLE = {
    "op2_line_frequency": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] AS gram
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, host, same, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
             len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
      FROM (SELECT doc_id, host, trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')) AS same, unnest(string_split(text, chr(10))) AS line FROM d)),
lw AS (SELECT * FROM l WHERE n > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
-- documents of one normalised text are one distinct document
f AS (SELECT lw.host, norm FROM lw JOIN (SELECT host, count(*) AS nh FROM d GROUP BY host) h ON h.host = lw.host
      GROUP BY lw.host, norm, nh HAVING count(DISTINCT same) >= 20 AND count(DISTINCT same) >= 0.005 * nh),
rem AS (SELECT lw.doc_id, sum(lw.n) AS n FROM lw JOIN f ON f.host = lw.host AND f.norm = lw.norm GROUP BY lw.doc_id),
o AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS removed_words
      FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rem USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words,
       n_words - removed_words < 0.3 * n_words AS depleted,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - removed_words < 0.3 * n_words) AS kept
FROM o
"""
}
