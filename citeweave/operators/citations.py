"""Citations in LaTeX joined with bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMENT = r"(?md)(^|[^\\\n])%.*$"
# Commands that cite, in lower case; those of the second list may begin with a capital.
CITING, CAPITAL_CITING = ["cite", "citep", "citet", "nocite", "nocitep", "nocitet"], ["parencite", "textcite", "autocite"]
_names = "|".join([*CITING, *CAPITAL_CITING, *(c.capitalize() for c in CAPITAL_CITING)])
#: A command, a star, options in brackets, and the keys in braces.
CITE = rf"\\(?:{_names})[*]?(?:\s*\[[^\]]*\])*\s*\{{([^{{}}]+)\}}"


def strip_comments(text: Column) -> Column:
    """LaTeX without comments; a percent sign behind a backslash stays."""
    return F.regexp_replace(text, COMMENT, "$1")


def cited_keys(text: Column) -> Column:
    """Distinct keys of the citation commands in a text, comments left out, in order of first occurrence."""
    groups = F.regexp_extract_all(strip_comments(F.coalesce(text, F.lit(""))), F.lit(CITE), 1)
    return F.array_distinct(F.array_remove(F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), lambda x: F.trim(x)), ""))


def citations(texts: DataFrame, text: str = "text", source: str = "file") -> DataFrame:
    """(source, key) of every citation."""
    return texts.select(source, F.explode(cited_keys(F.col(text))).alias("key"))


def _match(key: Column, case_sensitive: bool) -> Column:
    return key if case_sensitive else F.lower(key)


def filter_bibliography(bib: DataFrame, cited: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Entries (key, ord, ...) that are cited; of repeated keys the last one, in order of the bibliography."""
    keyed = bib.withColumn("_k", _match(F.col("key"), case_sensitive))
    last = keyed.groupBy("_k").agg(F.max("ord").alias("_last"))
    keys = cited.select(_match(F.col("key"), case_sensitive).alias("_k")).distinct()
    return keyed.join(last, "_k").filter(F.col("ord") == F.col("_last")).join(keys, "_k", "left_semi").drop("_k", "_last")


def missing_citations(bib: DataFrame, cited: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Cited keys that no entry has."""
    have = bib.select(_match(F.col("key"), case_sensitive).alias("_k")).distinct()
    return cited.select("key").distinct().withColumn("_k", _match(F.col("key"), case_sensitive)).join(have, "_k", "left_anti").select("key")


def duplicate_keys(bib: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(key, files, n) of keys declared more than once."""
    out = bib.groupBy(_match(F.col("key"), case_sensitive).alias("key")).agg(F.array_sort(F.collect_list("file")).alias("files"), F.count("*").alias("n"))
    return out.filter("n > 1")


def cited_duplicates(bib: DataFrame, cited: DataFrame, case_sensitive: bool = False) -> DataFrame:
    keys = cited.select(_match(F.col("key"), case_sensitive).alias("key")).distinct()
    return duplicate_keys(bib, case_sensitive).join(keys, "key", "left_semi")


def merge_bibliographies(bibs: DataFrame) -> DataFrame:
    """One row a key over all files, the last declaration, with the files that declare it."""
    return bibs.groupBy(F.lower("key").alias("k")).agg(F.max_by(F.struct("*"), F.struct("file", "ord")).alias("e"), F.array_sort(F.collect_list("file")).alias("files")).select("e.*", "files")
