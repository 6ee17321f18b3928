"""Verification of what papers' databases do not hold: web pages, books, working papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.functions.fuzzy import token_sort_ratio
from citeweave.functions.sets import jaccard
from citeweave.functions.text import title_key

BOOK, WORKING_PAPER, CONTENT = 0.80, 0.70, 0.60


def page_title(html: Column) -> Column:
    """A page's title, entities of markup decoded."""
    t = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def verify_web(entries: DataFrame, probes: DataFrame, verify_content: bool = False) -> DataFrame:
    """(entry_id, status, final_url) of entries (entry_id, url, title) by probes (url, status_code, final_url, html)."""
    out = entries.join(probes, "url", "left")
    ok = F.coalesce(F.col("status_code").between(200, 399), F.lit(False))
    like = token_sort_ratio(title_key(F.col("title")), title_key(page_title(F.col("html")))) / 100
    content = F.when(like >= CONTENT, "url_verified").otherwise("url_content_mismatch") if verify_content else F.lit("url_accessible")
    return out.select("entry_id", F.when(ok, content).otherwise("url_not_found").alias("status"), F.coalesce("final_url", "url").alias("final_url"))


def _best(pairs: DataFrame, score: Column, threshold: float, found: str, missing: str, entries: DataFrame) -> DataFrame:
    w = Window.partitionBy("entry_id").orderBy(F.col("score").desc(), "record_id")
    best = pairs.withColumn("score", score).filter(F.col("score") >= threshold).withColumn("k", F.row_number().over(w)).filter("k = 1").select("entry_id", "record_id", "score")
    return entries.select("entry_id").join(best, "entry_id", "left").withColumn("status", F.when(F.col("record_id").isNotNull(), found).otherwise(missing))


def verify_books(entries: DataFrame, books: DataFrame) -> DataFrame:
    """Entries against books (record_id, title_key, names, year, isbn): the ISBN's book, or one of the same first words
    and year; .6 title, .3 authors, .1 for a year within one."""
    head = lambda t: F.array_join(F.slice(F.split(t, " "), 1, 2), " ")
    a = entries.select("entry_id", F.col("title_key").alias("t"), F.col("names").alias("n"), F.col("year").alias("y"), "isbn", head(F.col("title_key")).alias("head"))
    b = books.select("record_id", F.col("title_key").alias("tr"), F.col("names").alias("nr"), F.col("year").alias("yr"), F.col("isbn").alias("isbn_r"), head(F.col("title_key")).alias("head_r"))
    pairs = a.join(b, F.col("isbn") == F.col("isbn_r")).union(a.join(b, F.col("head") == F.col("head_r"))).distinct()
    score = 0.6 * token_sort_ratio("t", "tr") / 100 + 0.3 * jaccard("n", "nr") + F.when(F.abs(F.col("y") - F.col("yr")) <= 1, 0.1).otherwise(0.0)
    return _best(pairs, score, BOOK, "book_verified", "book_not_found", entries)


def verify_working_papers(entries: DataFrame, scored: DataFrame) -> DataFrame:
    """Entries against a similarity join's (entry_id, record_id, score)."""
    return _best(scored, F.col("score"), WORKING_PAPER, "working_paper_verified", "working_paper_not_found", entries)
