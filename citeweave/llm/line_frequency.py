"""Quality rules by cross-document line frequency, in DataFrame operations only.

Lines are normalised and hashed; for each host the distinct documents of a line are counted, lines above the host's
limit are removed, and documents that lose too large a part of their words are rejected. Documents whose whole
normalised text is the same are copies and count as one distinct document: a text that stands in the corpus a thousand
times does not make its own lines boilerplate, however many lines distinct documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import GAP, NOT_GAP, bind, stored, words

SYMBOLS = r"[#*$%&|<>]+"
#: A line is above its host's limit from so many distinct documents on, and from this share of the host's documents.
MIN_DOCS, MIN_SHARE = 20, 0.005
#: A document is depleted if removal leaves less than this share of its words.
MIN_LEFT = 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def three_word_hashes(ws: Column) -> Column:
    n = F.size(ws)
    gram = lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), gram)).otherwise(F.array().cast("array<bigint>"))


def repeated_cover(grams: Column) -> Column:
    """How many words three-word windows cover whose hash stands in grams twice or more."""

    def sums(at: Column) -> Column:
        n = F.size(at)
        step = F.transform(at, lambda p, i: F.when(i == n - 1, 3).otherwise(F.least(F.lit(3), F.get(at, i + 1) - p)))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"]))
        return bind(F.sort_array(F.filter(marked, lambda p: p.isNotNull())), sums)

    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(bind(pairs, covered))


def normal_line(line: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def line_table(text: Column) -> Column:
    """array of (at, line, n) of a text's lines with a word: place among all lines, hash of the normal form, words."""
    # a normal form's words are apart by single spaces
    entry = lambda x, i: F.when(x.rlike(NOT_GAP), bind(normal_line(x), lambda y: F.struct(i.alias("at"), F.xxhash64(y).alias("line"), (F.length(y) - F.length(F.replace(y, F.lit(" "), F.lit(""))) + 1).alias("n"))))
    return F.array_compact(F.transform(F.split(text, "\n"), entry))


def text_counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words): what the rules read from one text."""
    text = F.coalesce(text, F.lit(""))
    symbols = F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_GAP))
    dup_lines = bind(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))

    def counts(ws: Column) -> Column:
        return bind(
            three_word_hashes(ws),
            lambda g: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                dup_lines.cast("long").alias("n_dup_lines"),
                repeated_cover(g).cast("long").alias("n_repeat_words"),
            ),
        )

    return bind(words(text), counts)


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, line, n_docs, n_distinct) of the lines above their host's limit.

    docs: host, same (the hash of the whole normalised text), lines (hashes). Each document counts once for a line. The
    first aggregation deals the rows of a frequent line out by document, the second combines its counts before they are
    dealt by line.
    """
    lines = docs.select("host", "same", F.explode(F.array_distinct("lines")).alias("line"))
    of_same = lines.groupBy("host", "line", "same").agg(F.count("*").alias("n"))
    of_line = of_same.groupBy("host", "line").agg(F.sum("n").alias("n_docs"), F.count("*").alias("n_distinct"))
    of_line = of_line.filter(F.col("n_distinct") >= min_docs)
    hosts = docs.groupBy("host").agg(F.count("*").alias("n_host"))
    return of_line.join(hosts, "host").filter(F.col("n_distinct") >= min_share * F.col("n_host")).select("host", "line", "n_docs", "n_distinct")


def line_frequency_rules(
    docs: DataFrame, text: str = "text", host: str = "source", id_col: str = "doc_id", *,
    min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, with_row: bool = False,
) -> DataFrame:
    """One row a row of docs: id_col, counts, base_failed, removed_words, depleted, kept, clean_text.

    Null and empty texts have no words, so base_failed holds and clean_text is as it came. A null host is the host "".
    Rows repeating an id, and rows without one, are judged each by their own text; wholly equal rows count as so many
    documents and, as copies, once as distinct. Very long texts are read whole. Other columns of docs are left out,
    whatever they are called; with_row adds `row`, a struct of all of them. An empty table gives an empty one.
    """
    columns = docs.columns
    others = [c for c in columns if c != text and (with_row or c == id_col)]
    host_, whole = F.coalesce(F.col(host).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # a row is known by two hashes of its id, host and text; equal rows lose the same lines
    known = [F.xxhash64(id_col, host_, whole).alias("key"), F.xxhash64(whole, F.col(id_col), host_, F.lit(1)).alias("check")]
    docs = docs.select(F.struct(*others).alias("others"), host_.alias("host"), F.col(text).alias("text"), *known)

    # lines are normalised once; what follows reads their hashes
    lines = stored(docs.select("key", "check", "host", F.xxhash64(normal_line(F.coalesce("text", F.lit("")))).alias("same"), line_table(F.coalesce("text", F.lit(""))).alias("lines")))
    frequent = frequent_lines(lines.withColumn("lines", F.col("lines.line")), min_docs, min_share).select("host", "line")
    each = lines.select("key", "check", "host", F.explode("lines").alias("x")).select("key", "check", "host", "x.*")
    lost = each.join(frequent, ["host", "line"]).groupBy("key", "check").agg(F.collect_set(F.struct("at", "n")).alias("lost"))

    out = docs.select("others", "text", "key", "check", text_counts(F.col("text")).alias("c")).join(lost, ["key", "check"], "left").select("others", "text", "c.*", "lost")
    removed = F.coalesce(F.aggregate("lost", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0).cast("long"))
    out = out.withColumn("removed_words", removed).withColumns(
        {
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
            "depleted": F.col("n_words") - F.col("removed_words") < min_left * F.col("n_words"),
        }
    )
    clean = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("lost.at"), i)), "\n"))
    row = F.struct(*[F.col("text").alias(text) if c == text else F.col("others").getField(c).alias(c) for c in columns]).alias("row") if with_row else None
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "depleted"]
    return out.select(F.col("others").getField(id_col).alias(id_col), *counts, (~F.col("base_failed") & ~F.col("depleted")).alias("kept"), clean.alias("clean_text"), *([row] if with_row else []))
