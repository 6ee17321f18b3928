"""Markdown notes: front matter, abstracts, keywords."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRONT = r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)"
LINK = r"^\[\[|\]\]$"


@F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
def _front_matter(s: pd.Series) -> pd.Series:
    import yaml

    def read(text: str | None) -> dict[str, list[str]]:
        try:
            data = yaml.safe_load(text or "") or {}
        except yaml.YAMLError:
            return {}
        flat = lambda v: [str(x[0]) if isinstance(x, list) and x else str(x) for x in v] if isinstance(v, list) else [] if v is None else [str(v)]
        return {str(k): flat(v) for k, v in data.items()} if isinstance(data, dict) else {}

    return s.map(read)


def parse_note(text: Column) -> Column:
    """struct(front, body): front matter as lists by name, and what follows it."""
    front = F.regexp_extract(text, FRONT, 1)
    return F.struct(_front_matter(front).alias("front"), F.regexp_replace(text, FRONT, "").alias("body"))


def note_title(front: Column, body: Column) -> Column:
    """The second alias, else the first heading; '' for neither."""
    aliases = F.try_element_at(front, F.lit("aliases"))
    return F.coalesce(F.get(aliases, 1), F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)))


def note_abstract(body: Column) -> Column:
    """The text of an abstract callout."""
    block = F.regexp_extract(body, r"(?mi)^>\s*\[!abstract\][^\n]*\n((?:>[^\n]*\n?)*)", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(block, r"(?m)^>\s?", ""), r"\s+", " "))


def plain_keywords(raw: Column) -> Column:
    """Keywords without link brackets, blanks and repetitions, in order."""
    return F.array_distinct(F.array_remove(F.transform(raw, lambda k: F.trim(F.regexp_replace(F.trim(k), LINK, ""))), ""))


def split_compound(keywords: Column) -> Column:
    """Keywords that are several, apart."""
    parts = F.flatten(F.transform(keywords, lambda k: F.split(k, r" - | – | — | / ")))
    return F.array_distinct(F.array_remove(F.transform(parts, lambda x: F.trim(x)), ""))


def keywords_yaml(keywords: Column) -> Column:
    return F.when(F.size(keywords) == 0, "keywords: []").otherwise(F.concat(F.lit("keywords:\n"), F.array_join(F.transform(keywords, lambda k: F.concat(F.lit('  - "[['), k, F.lit(']]"'))), "\n")))


def enrich(notes: DataFrame, least: int = 3) -> DataFrame:
    """notes (path, existing, generated) with new keywords, the sorted union, and action (skipped, unchanged, enriched)."""
    low = lambda xs: F.transform(xs, F.lower)
    new = F.filter(split_compound(F.col("generated")), lambda k: ~F.array_contains(low(F.col("existing")), F.lower(k)))
    out = notes.withColumn("new", new).withColumn("merged", F.array_sort(F.array_union("existing", "new")))
    return out.withColumn("action", F.when(F.size("existing") >= least, "skipped").when(F.size("new") == 0, "unchanged").otherwise("enriched"))


def limit_enriched(notes: DataFrame, limit: int, order: str = "ord", part: str | None = None) -> DataFrame:
    """The rows up to the one that makes the limit of enriched notes."""
    w = (Window.partitionBy(part) if part else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(F.col("action") == "enriched", 1).otherwise(0)).over(w), F.lit(0))
    return notes.withColumn("before", before).filter(F.col("before") < limit).drop("before")
