"""Queries on candidates, results, topics and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeweave.functions import sets as S
from citeweave.functions import text as X
from citeweave.operators import chain as H
from citeweave.operators import consensus as K
from citeweave.operators import evaluate as E
from citeweave.operators import linkage as L
from citeweave.operators import notes as N
from citeweave.operators import organize as O
from citeweave.operators import status as T
from citeweave.operators import summaries as U
from citeweave.operators.entries import settle
from citeweave.operators.resolve import first_stage
from citeweave.plans.synthetic import spark_entries
from citeweave.streaming import state as G

_STATUSES = [s[0] for s in T.STATUSES]
_n = len(_STATUSES)


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def results(spark, sf_dir):
    """A check result a document: status, scores and counts from its number."""
    i = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", F.get(F.array(*[F.lit(s) for s in _STATUSES]), (i % _n).cast("int")).alias("status"), ((i * 7) % 101 / 100).alias("score"), (i % 5).alias("n_queried"), F.least(i % 4, i % 5).alias("n_hits"), (i % 3).alias("n_errors"))


def candidates(spark, sf_dir):
    """Three candidates an entry from three sources, scores and flags from their numbers."""
    d = docs(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    i = F.col("doc_id") * 3 + F.col("k")
    return d.select("doc_id", F.col("k").alias("source_rank"), i.alias("ingest_ord"), (F.pmod(i * 37, F.lit(11)) / 100 + 0.85).alias("score"), (i % 4).alias("n_confirmed"), (i % 3).alias("n_mismatched"), (i % 2 == 0).alias("order_reliable"), (i % 7 == 0).alias("full"))


_cand = """cand AS (SELECT doc_id, k AS source_rank, doc_id * 3 + k AS i, ((doc_id * 3 + k) * 37 % 11) / 100 + 0.85 AS score, (doc_id * 3 + k) % 4 AS n_confirmed, (doc_id * 3 + k) % 3 AS n_mismatched,
  (doc_id * 3 + k) % 2 = 0 AS order_reliable, (doc_id * 3 + k) % 7 = 0 AS full_ FROM documents, (SELECT unnest([0, 1, 2]) AS k))"""
_dim = "dim(status, bucket, base, polarity, label) AS (VALUES " + ", ".join(repr(s) for s in T.STATUSES) + ")"
_res = f"{_dim}, res AS (SELECT doc_id, list_extract({_STATUSES!r}, (doc_id % {_n})::INT + 1) AS status, (doc_id * 7) % 101 / 100 AS score, doc_id % 5 AS n_queried, least(doc_id % 4, doc_id % 5) AS n_hits, doc_id % 3 AS n_errors FROM documents)"


def status_summary(spark, sf_dir):
    return U.status_summary(results(spark, sf_dir))


def bucket_rates(spark, sf_dir):
    out = U.bucket_rates(results(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith("_rate")})


def confidences(spark, sf_dir):
    r = results(spark, sf_dir)
    c = T.confidence(F.col("status"), F.col("score"), None, F.col("n_queried"), F.col("n_hits"), F.col("n_errors"))
    return r.withColumn("c", c).select("doc_id", "status", F.round("c", 9).alias("confidence"), F.round(T.p_valid(F.col("status"), F.col("c"), F.col("n_errors") > 0), 9).alias("p_valid"))


def numeric_confidence(spark, sf_dir):
    i = F.col("doc_id")
    out = T.numeric_confidence((i % 101).cast("double"), (i * 3 % 101).cast("double"), (i * 5 % 101).cast("double"), (i * 7 % 101).cast("double"), (i % 20).cast("double"), i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 4)
    return docs(spark, sf_dir).select("doc_id", F.round(out, 9).alias("confidence"))


def update_summary(spark, sf_dir):
    action = F.get(F.array(*[F.lit(a) for a in ("unchanged", "upgraded", "failed", "skipped_resolved", "skipped")]), (F.col("doc_id") % 5).cast("int"))
    return U.update_summary(docs(spark, sf_dir).select(action.alias("action")))


def pairs(spark, sf_dir):
    """Gold labels of quality, predictions of toxicity: labels joined with documents."""
    l, label = spark.read.parquet(f"{sf_dir}/labels.parquet"), lambda c: F.when(F.col(c) == 1, "HALLUCINATED").otherwise("VALID")
    d = docs(spark, sf_dir).select("doc_id", "lang", F.length("text").alias("n"))
    return l.join(d, "doc_id").select("doc_id", "lang", label("quality").alias("gold_label"), label("toxic").alias("pred_label"), F.when(F.col("n") % 2 == 0, "HALLUCINATED").otherwise("VALID").alias("other"), (F.col("n") % 10 == 0).alias("abstained"), (F.col("n") % 100 / 100).alias("p_valid"))


_pairs = """p AS (SELECT doc_id, lang, CASE WHEN quality = 1 THEN 'HALLUCINATED' ELSE 'VALID' END AS gold, CASE WHEN toxic = 1 THEN 'HALLUCINATED' ELSE 'VALID' END AS pred,
  CASE WHEN length(text) % 2 = 0 THEN 'HALLUCINATED' ELSE 'VALID' END AS other, length(text) % 10 = 0 AS abstained, length(text) % 100 / 100 AS p_valid FROM labels JOIN documents USING (doc_id))"""


def confusion(spark, sf_dir):
    return E.confusion_metrics(pairs(spark, sf_dir), ["lang"]).select("lang", "n", "tp", "fp", "tn", "fn", "detection_rate", "precision", "f1", "mcc", "coverage")


def type_rates(spark, sf_dir):
    out = E.rate_by_type(pairs(spark, sf_dir), "pred_label", "other", "lang")
    return out.select("type", "n", F.round("old", 9).alias("old"), F.round("new", 9).alias("new"), F.round("delta", 9).alias("delta"))


def error_statuses(spark, sf_dir):
    return E.error_statuses(pairs(spark, sf_dir).withColumn("status", F.col("lang")))


def calibration_error(spark, sf_dir):
    return E.calibration_error(pairs(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


def best_bands(spark, sf_dir):
    return L.band_select(candidates(spark, sf_dir), "doc_id").select("doc_id", "ingest_ord")


def stopped(spark, sf_dir):
    return L.stop_rank(candidates(spark, sf_dir), "doc_id").select("doc_id", "source_rank")


def top_two(spark, sf_dir):
    return L.top_k(candidates(spark, sf_dir), ["doc_id"], "score", "ingest_ord", 2).select("doc_id", "ingest_ord", "rank")


def staged(spark, sf_dir):
    """Stage results of each document: the first stage's best record."""
    c = candidates(spark, sf_dir)
    found = c.filter("ingest_ord % 3 <> doc_id % 4").select(F.col("doc_id").alias("entry_id"), F.col("ingest_ord").alias("record_id"), (F.col("ingest_ord") % 2).alias("stage_rank"), F.lit("m").alias("method"), F.col("score").alias("confidence"))
    recs = c.select(F.col("ingest_ord").alias("record_id"), "ingest_ord", F.when(F.col("n_confirmed") > 1, "1-2").alias("pages"), F.lit("1").alias("volume"), F.lit("").alias("number"))
    return first_stage(found, recs).select("entry_id", "record_id", "stage_rank")


def author_intersections(spark, sf_dir):
    """Word sets of three documents as one group's surnames by source."""
    w = docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 3).alias("g"), "doc_id", F.array_distinct(X.word_tokens(F.lower("text"))).alias("names"))
    g = w.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "names"))), lambda x: x["names"]).alias("lists"))
    return g.select("g", K.author_intersection(F.col("lists")).alias("x")).select("g", F.array_join("x.confirmed", " ").alias("confirmed"), F.size("x.suspect").cast("long").alias("n_suspect"), F.col("x.bonus").cast("long").alias("bonus"))


def venue_groups(spark, sf_dir):
    """Groups of four pieces of evidence, tied by shared numbers."""
    i = F.col("doc_id")
    ids = F.array(*[F.array((i % (k + 2)).cast("string"), ((i + k) % 5 + 10).cast("string")) for k in range(4)])
    return docs(spark, sf_dir).select("doc_id", F.posexplode(K.venue_groups(ids)).alias("piece", "group")).select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("group").cast("long").alias("group"))


def title_pairs(spark, sf_dir):
    """Titles in one block: overlap of words and edits. Equal titles are compared once, by lists of up to 256 documents."""
    e = spark_entries(spark, sf_dir).select("doc_id", X.title_key(F.col("title"), markup=False).alias("t")).filter("length(t) > 20")
    lists = e.withColumn("nth", F.row_number().over(Window.partitionBy("t").orderBy("doc_id"))).groupBy("t", F.floor((F.col("nth") - 1) / 256).alias("part")).agg(F.collect_list("doc_id").alias("ids"))
    lists = settle(lists.select(F.substring("t", 1, 6).alias("k"), "t", "part", "ids", F.array_distinct(F.split("t", " ")).alias("words")))
    a, b = L.in_cells(lists, ["t", "part"], F.size("ids"))
    a, b = (x.withColumnsRenamed({c: f"{c}_{side}" for c in ("t", "part", "ids", "words")}) for side, x in (("a", a), ("b", b)))
    p = a.join(b, ["k", "i", "j"]).filter("i < j or t_a < t_b or t_a = t_b and part_a <= part_b")
    p = p.select(F.round(S.jaccard(F.col("words_a"), F.col("words_b")), 9).alias("jaccard"), F.levenshtein("t_a", "t_b").cast("long").alias("edits"), F.expr("t_a = t_b and part_a = part_b").alias("one"), F.explode("ids_a").alias("x"), "ids_b")
    p = p.select("jaccard", "edits", "one", "x", F.explode("ids_b").alias("y")).filter("x < y or x > y and not one")
    return p.select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("other"), "jaccard", "edits")


def near_titles(spark, sf_dir):
    """The similarity join of entries with one another's titles, best three each."""
    e = spark_entries(spark, sf_dir).filter("length(title) > 20").select("entry_id", X.title_key(F.col("title"), markup=False).alias("title_key"), F.array(F.lit("a")).alias("names"))
    return L.best_later(e, 0.9, 3).select("entry_id", "record_id", F.round("score", 6).alias("score"), "rank")


def chain_trust(spark, sf_dir):
    i = F.col("doc_id")
    t = H.trust((i % 20 / 100 + 0.85), (i % 30 / 100 + 0.75), (i % 30 + 1990).cast("string"), i % 37 + 1988)
    return docs(spark, sf_dir).select("doc_id", t["trusted"].alias("trusted"), F.array_join(t["reasons"], ",").alias("reasons"), H.is_problematic(F.get(F.array(*[F.lit(s) for s in _STATUSES]), (i % _n).cast("int"))).alias("problem"))


def topics(spark, sf_dir):
    """The centroids of labels as topics, and each vector's best two."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c = v.select("label", F.posexplode("embedding").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("vector"))
    out = O.classify(v.select(F.col("vec_id").alias("paper_id"), F.col("embedding").alias("vector")), c.select(F.col("label").alias("topic_id"), "vector"), 0.3, 2)
    return out.select("paper_id", F.round("confidence", 5).alias("confidence"), "rank")


def taxonomy(spark, sf_dir):
    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    t = r.select(F.concat(F.lit("r"), "r_regionkey").alias("topic_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id")).union(n.select(F.concat(F.lit("n"), "n_nationkey"), "n_name", F.concat(F.lit("r"), "n_regionkey")))
    return O.taxonomy_paths(spark, t).select("topic_id", "path", F.col("depth").cast("long").alias("depth"))


def keywords(spark, sf_dir):
    i = F.col("doc_id")
    raw = F.array(F.lit("[[Machine Learning]]"), F.concat(F.lit("graph - topic "), i % 7), F.lit(" a / b "), F.when(i % 2 == 0, "[[x]]").otherwise(""))
    return docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(N.split_compound(N.plain_keywords(raw))), "|").alias("keywords"))


def enrich_limit(spark, sf_dir):
    d = docs(spark, sf_dir).select((F.col("doc_id") % 10).alias("part"), F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, "enriched").otherwise("skipped").alias("action"))
    return N.limit_enriched(d, 5, "ord", "part").groupBy("part").agg(F.count("*").alias("n"))


def request_windows(spark, sf_dir):
    return G.request_windows(events(spark, sf_dir), by="event_type", seconds=60).select(F.unix_seconds("start").alias("start"), "event_type", "n")


def breaker(spark, sf_dir):
    out = G.breaker(events(spark, sf_dir), "event_type", F.col("value") < 50, limit=2)
    return out.groupBy("event_type").agg(F.max("streak").alias("longest"), F.count_if("open").alias("n_open"))


def recent_requests(spark, sf_dir):
    out = G.recent_requests(events(spark, sf_dir), "user_id", seconds=3600)
    return out.groupBy("user_id").agg(F.max("recent").alias("most"))


def latest(spark, sf_dir):
    return G.latest_fresh(events(spark, sf_dir), "user_id", F.lit("9999-01-01").cast("timestamp"), "9000 years").select("user_id", "event_id")


def sessions(spark, sf_dir):
    return G.activity_sessions(events(spark, sf_dir), "user_id").select(F.unix_micros("start").alias("start"), "user_id", "n")


def properties(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


def unseen(spark, sf_dir):
    e = events(spark, sf_dir)
    return G.unseen(e, e.filter("value > 99.5"), "user_id").select("user_id")


_prob = " OR ".join(f"status LIKE '%{x}%'" for x in ("verified", "not_found"))
_names = ["status_summary", "bucket_rates", "confidences", "numeric_confidence", "update_summary", "confusion", "type_rates", "error_statuses", "calibration_error", "best_bands", "stopped", "top_two", "staged", "author_intersections", "venue_groups", "title_pairs", "near_titles", "chain_trust", "topics", "taxonomy", "keywords", "enrich_limit", "request_windows", "breaker", "recent_requests", "latest", "sessions", "properties", "unseen"]
QUERIES = {n: globals()[n] for n in _names}
_key = "trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(array_to_string((list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))[1:8], ' '), 'ß', 'ss'), 'ẞ', 'SS'))), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
ORACLE = {
    "status_summary": f"WITH {_res} SELECT dim.status, bucket, count(doc_id) AS n FROM dim LEFT JOIN res r ON r.status = dim.status GROUP BY 1, 2",
    "bucket_rates": f"WITH {_res}, c AS (SELECT count(*) AS total, count(*) FILTER (bucket = 'verified') AS verified, count(*) FILTER (bucket = 'problematic') AS problematic, count(*) FILTER (bucket = 'abstained') AS abstained FROM res JOIN dim USING (status)) SELECT *, round(verified / total, 9) AS verified_rate, round(problematic / total, 9) AS problematic_rate, round(abstained / total, 9) AS abstained_rate FROM c",
    "confidences": f"""WITH {_res}, b AS (SELECT *, CASE WHEN status IN {tuple(T.ABSTAIN)} THEN CASE WHEN score > 0.5 THEN base * 0.5 ELSE base END WHEN status = 'verified' THEN 0.7 * score + 0.3 * base
        WHEN status = 'hallucinated' THEN 0.7 * (1 - score) + 0.3 * base WHEN status IN {tuple(T.FIELD_SCORED)} AND score > 0.8 THEN base * 0.8 ELSE base END AS s,
        CASE WHEN status IN {tuple(T.ABSTAIN + T.SELF_EVIDENT)} THEN 1 WHEN status IN {tuple(T.COVERED)} THEN CASE WHEN n_hits = 0 THEN 0.5 ELSE 0.9 + 0.1 * n_hits / n_queried END ELSE 0.7 + 0.3 * n_hits / nullif(n_queried, 0) END AS f FROM res JOIN dim USING (status)),
        c AS (SELECT *, CASE WHEN n_queried = 0 THEN s * 0.3 ELSE greatest(0, least(1, s * f * (1 - 0.15 * n_errors))) END AS c FROM b)
        SELECT doc_id, status, round(c, 9)::DOUBLE AS confidence, round(CASE WHEN polarity = 'valid' THEN 0.5 + 0.5 * c WHEN polarity = 'problem' THEN 0.5 - 0.5 * c WHEN polarity = 'not_found' AND n_errors = 0 THEN 0.35 ELSE 0.5 END, 9)::DOUBLE AS p_valid FROM c""",
    "numeric_confidence": "WITH f AS (SELECT doc_id, doc_id % 101 AS t, doc_id * 3 % 101 AS a, doc_id * 5 % 101 AS y, doc_id * 7 % 101 AS v FROM documents) SELECT doc_id, round(greatest(0, least(100, CASE WHEN t > 80 AND a < 90 THEN t - 0.5 * (100 - a) ELSE (t + a + y + v) / 4 + least(doc_id % 20, 10) END - (CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 20 END) - (CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 20 END) - (CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 15 END) - least(10 * (doc_id % 4), 20))), 9)::DOUBLE AS confidence FROM f",
    "update_summary": "WITH c AS (SELECT count(*) AS total, count(*) FILTER (doc_id % 5 = 1) AS upgraded, count(*) FILTER (doc_id % 5 = 2) AS failed, count(*) FILTER (doc_id % 5 = 3) AS skipped_resolved FROM documents) SELECT *, total - upgraded - failed - skipped_resolved AS unchanged FROM c",
    "confusion": f"""WITH {_pairs}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (gold = 'HALLUCINATED' AND pred = 'HALLUCINATED') AS tp, count(*) FILTER (gold = 'VALID' AND pred = 'HALLUCINATED') AS fp, count(*) FILTER (gold = 'VALID' AND pred = 'VALID') AS tn, count(*) FILTER (gold = 'HALLUCINATED' AND pred = 'VALID') AS fn, count(*) FILTER (abstained) AS ab FROM p GROUP BY 1),
        r AS (SELECT *, tp / nullif(tp + fn, 0) AS dr, tp / nullif(tp + fp, 0) AS pr FROM c)
        SELECT lang, n, tp, fp, tn, fn, round(dr, 4) AS detection_rate, round(pr, 4) AS precision, round(2 * pr * dr / nullif(pr + dr, 0), 4) AS f1, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 4) AS mcc, round((n - ab) / n, 4) AS coverage FROM r""",
    "type_rates": f"WITH {_pairs}, c AS (SELECT lang AS type, count(*) AS n, avg((pred = 'HALLUCINATED')::INT) AS o, avg((other = 'HALLUCINATED')::INT) AS w FROM p WHERE gold = 'HALLUCINATED' GROUP BY 1) SELECT type, n, round(o, 9) AS old, round(w, 9) AS new, round(w - o, 9) AS delta FROM c",
    "error_statuses": f"WITH {_pairs} SELECT CASE WHEN gold = 'HALLUCINATED' THEN 'FN' ELSE 'FP' END AS error, lang AS status, count(*) AS n FROM p WHERE gold <> pred GROUP BY 1, 2",
    "calibration_error": f"WITH {_pairs}, b AS (SELECT least(floor(p_valid * 10), 9) AS bin, count(*) AS n, avg(p_valid) AS p, avg((gold = 'VALID')::INT) AS y FROM p GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 9) AS ece FROM b",
    "best_bands": f"WITH {_cand}, t AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM cand), n AS (SELECT *, score >= top - 0.02 AS tight FROM t WHERE score >= top - 0.05), r AS (SELECT *, bool_or(tight AND order_reliable) OVER (PARTITION BY doc_id) AS hr FROM n) SELECT doc_id, i AS ingest_ord FROM r WHERE NOT (hr AND tight AND NOT order_reliable) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_confirmed DESC, n_mismatched, score DESC, i) = 1",
    "stopped": f"WITH {_cand}, s AS (SELECT *, min(source_rank) FILTER (full_) OVER (PARTITION BY doc_id) AS stop FROM cand) SELECT doc_id, source_rank FROM s WHERE stop IS NULL OR source_rank <= stop",
    "top_two": f"WITH {_cand} SELECT doc_id, i AS ingest_ord, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rank FROM cand QUALIFY rank <= 2",
    "staged": f"WITH {_cand} SELECT doc_id AS entry_id, i AS record_id, i % 2 AS stage_rank FROM cand WHERE i % 3 <> doc_id % 4 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i % 2, score DESC, (n_confirmed > 1)::INT DESC, i) = 1",
    "author_intersections": r"""WITH f AS (SELECT floor(doc_id / 3)::BIGINT AS g, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS names FROM documents), e AS (SELECT DISTINCT g, doc_id, unnest(names) AS x FROM f), n AS (SELECT g, count(*) AS n FROM f GROUP BY 1),
        c AS (SELECT g, x, count(*) AS k FROM e GROUP BY 1, 2), o AS (SELECT c.g, count(*) FILTER (k = n) AS nc, string_agg(x, ' ' ORDER BY x) FILTER (k = n) AS confirmed, count(*) FILTER (k < n) AS ns, any_value(n) AS n FROM c JOIN n ON n.g = c.g GROUP BY 1)
        SELECT n.g, CASE WHEN n.n >= 2 THEN coalesce(confirmed, '') ELSE '' END AS confirmed, CASE WHEN n.n >= 2 THEN ns ELSE 0 END AS n_suspect, CASE WHEN n.n >= 2 AND nc >= 2 THEN 10 ELSE 0 END AS bonus FROM n JOIN o ON o.g = n.g""",
    "venue_groups": """WITH RECURSIVE x AS (SELECT doc_id, k, unnest([(doc_id % (k + 2))::VARCHAR, ((doc_id + k) % 5 + 10)::VARCHAR]) AS v FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k)),
        ed AS (SELECT DISTINCT a.doc_id, a.k AS a, b.k AS b FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.v = b.v), r AS (SELECT doc_id, a, b FROM ed UNION SELECT r.doc_id, r.a, ed.b FROM r JOIN ed ON ed.doc_id = r.doc_id AND ed.a = r.b)
        SELECT doc_id, a AS piece, min(b) AS "group" FROM r GROUP BY 1, 2""",
    "title_pairs": f"WITH e AS (SELECT doc_id, {_key} AS t FROM documents), f AS (SELECT * FROM e WHERE length(t) > 20), p AS (SELECT a.doc_id, b.doc_id AS other, a.t, b.t AS u FROM f a JOIN f b ON left(a.t, 6) = left(b.t, 6) AND a.doc_id < b.doc_id), s AS (SELECT *, list_distinct(string_split(t, ' ')) AS x, list_distinct(string_split(u, ' ')) AS y FROM p) SELECT doc_id, other, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS jaccard, levenshtein(t, u) AS edits FROM s",
    "chain_trust": f"WITH d AS (SELECT doc_id, doc_id % 20 / 100 + 0.85 AS t, doc_id % 30 / 100 + 0.75 AS a, doc_id % 30 + 1990 AS c, doc_id % 37 + 1988 AS y, list_extract({_STATUSES!r}, (doc_id % {_n})::INT + 1) AS status FROM documents), r AS (SELECT *, list_filter([CASE WHEN t < 0.9 THEN 'title' END, CASE WHEN a < 0.8 THEN 'author' END, CASE WHEN y < c THEN 'year_before' END, CASE WHEN y > c + 5 THEN 'year_after' END], lambda x: x IS NOT NULL) AS rs FROM d) SELECT doc_id, len(rs) = 0 AS trusted, array_to_string(rs, ',') AS reasons, NOT ({_prob} OR status = 'unconfirmed') AS problem FROM r",
    "topics": "WITH c AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2), v AS (SELECT label, list(x ORDER BY pos) AS c FROM c GROUP BY 1), s AS (SELECT vec_id AS paper_id, label, greatest(0, least(1, list_cosine_similarity(embedding::DOUBLE[], c))) AS s FROM embeddings e, (SELECT label AS l2, c FROM v) v2 ), k AS (SELECT paper_id, s, row_number() OVER (PARTITION BY paper_id ORDER BY s DESC) AS rank FROM s) SELECT paper_id, round(s, 5) AS confidence, rank FROM k WHERE rank = 1 OR (s >= 0.3 AND rank <= 2)",
    "taxonomy": "SELECT 'r' || r_regionkey AS topic_id, r_name AS path, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, r_name || '/' || n_name, 1 FROM nation JOIN region ON r_regionkey = n_regionkey",
    "keywords": "SELECT doc_id, array_to_string(list_sort(list_filter(['Machine Learning', 'graph', 'topic ' || (doc_id % 7), 'a', 'b', CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END], lambda x: x <> '')), '|') AS keywords FROM documents",
    "enrich_limit": "WITH d AS (SELECT doc_id % 10 AS part, doc_id, count(*) FILTER (doc_id % 3 = 0) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM documents) SELECT part, count(*) AS n FROM d WHERE b < 5 GROUP BY 1",
    "request_windows": "SELECT floor(epoch(ts) / 60)::BIGINT * 60 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "breaker": "WITH f AS (SELECT event_type, ts, event_id, value < 50 AS bad, count(*) FILTER (NOT (value < 50)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM events), s AS (SELECT event_type, count(*) FILTER (bad) OVER (PARTITION BY event_type, run ORDER BY ts, event_id) AS k FROM f) SELECT event_type, max(k) AS longest, count(*) FILTER (k >= 2) AS n_open FROM s GROUP BY 1",
    "recent_requests": "WITH r AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS k FROM events) SELECT user_id, max(k) AS most FROM r GROUP BY 1",
    "latest": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT epoch_us(min(ts)) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k",
    "properties": "SELECT CAST(props ->> '$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "unseen": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 99.5)",
}
