"""Query op1_template_windows and its SQL."""

from __future__ import annotations

from citeweave.llm.common import table
from citeweave.llm.templates import UNITS, contaminated


def op1_template_windows(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_template_windows": op1_template_windows}
ORACLE = {
    "op1_template_windows": rf"""
WITH raw AS (SELECT 0 AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark),
m AS (SELECT kind, id, regexp_replace(regexp_replace(t, '(^|[.!?:][\x20\x09-\x0D]+|\n)(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), '([0-9])[.,]([0-9])', '\1' || chr(2) || '\2', 'g') AS t FROM raw),
k AS (SELECT kind, id, regexp_extract_all(t, '[\p{{L}}\p{{N}}\x01\x02]+') AS ts FROM m),
s AS (SELECT kind, id, ts, list_transform(range(1, len(ts) + 1), lambda i:
        CASE WHEN ts[i][1] BETWEEN '0' AND '9' THEN '<num>'
             WHEN ts[i][1] = chr(1) THEN lower(ts[i][2:])
             WHEN lower(ts[i]) <> ts[i] AND lower(ts[i][1]) <> ts[i][1] AND upper(ts[i]) <> ts[i] THEN '<name>'
             WHEN i > 1 AND ts[i-1][1] BETWEEN '0' AND '9' AND list_contains({UNITS!r}, lower(ts[i])) THEN '<unit>'
             ELSE lower(ts[i]) END) AS c FROM k),
p AS (SELECT kind, id, pos, array_to_string(c[pos:pos+9], ' ') AS w, len(list_filter(c[pos:pos+9], lambda x: x NOT IN ('<num>', '<unit>', '<name>'))) AS lit
      FROM (SELECT kind, id, c, unnest(range(1, len(c) - 8)) AS pos FROM s WHERE len(c) >= 10)),
own AS (SELECT id AS item_id, pos AS item_at, w FROM p WHERE kind = 1 AND lit >= 5),
nw AS (SELECT item_id, count(*) AS n_windows FROM own GROUP BY 1),
l AS (SELECT p.id AS doc_id, own.item_id, p.pos - item_at AS shift, count(DISTINCT item_at) AS n_matched, min(item_at) AS low, max(item_at) AS high
      FROM p JOIN own ON p.w = own.w WHERE p.kind = 0 GROUP BY 1, 2, 3),
g AS (SELECT l.*, n_windows FROM l JOIN nw USING (item_id) WHERE n_matched >= least(4, n_windows)),
x AS (SELECT g.*, d.ts AS dts, i.ts AS its, i.c AS ic, unnest(range(low, high + 10)) AS j FROM g JOIN s d ON d.kind = 0 AND d.id = g.doc_id JOIN s i ON i.kind = 1 AND i.id = g.item_id),
sl AS (SELECT doc_id, item_id, shift, n_matched, n_windows, CASE WHEN ic[j] IN ('<num>', '<unit>', '<name>') THEN lower(its[j]) END AS of, CASE WHEN ic[j] IN ('<num>', '<unit>', '<name>') THEN lower(dts[j + shift]) END AS iz FROM x),
ag AS (SELECT doc_id, item_id, shift, n_matched, n_windows, count(of) AS n_slots, count(*) FILTER (of IS NOT NULL AND of <> iz) AS n_changed,
              count(DISTINCT of) AS nof, count(DISTINCT CASE WHEN of IS NOT NULL THEN of || chr(10) || iz END) AS npair FROM sl GROUP BY 1, 2, 3, 4, 5)
SELECT doc_id, item_id, n_matched, n_windows, n_slots, n_changed, CASE WHEN n_changed > 0 THEN 'reparameterised' ELSE 'verbatim' END AS kind
FROM ag WHERE nof = npair QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, shift) = 1
"""
}
