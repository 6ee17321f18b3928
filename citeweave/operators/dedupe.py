"""Duplicate entries: grouping keys and the ordered fold of each group into one entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.identifiers import doi_normalize
from citeweave.functions.names import surnames
from citeweave.functions.text import title_key

COUNTED = ["title", "author", "journal", "year", "volume", "number", "pages", "doi", "url", "publisher"]


def duplicate_key(doi: Column, title: Column, author: Column, markup: bool = True) -> Column:
    """What duplicates share: the DOI, else title and first surnames. markup=False: titles are known to hold none."""
    fuzzy = F.concat(F.lit("fuzzy:"), title_key(title, markup), F.lit("|"), F.array_join(F.array_sort(surnames(author, 3)), ","))
    return F.coalesce(F.concat(F.lit("doi:"), doi_normalize(doi)), fuzzy)


def completeness(entry_type: Column, fields: Column) -> Column:
    """5 for an article and 1 for each counted field that is stated."""
    has = lambda f: F.coalesce(F.try_element_at(fields, F.lit(f)), F.lit("")) != ""
    return F.when(F.lower(F.trim(entry_type)) == "article", 5).otherwise(0) + sum((F.when(has(f), 1).otherwise(0) for f in COUNTED), F.lit(0))


def merge(a: Column, b: Column) -> Column:
    """The more complete of two entries (the first of equals), its missing fields filled from the other."""
    keep = completeness(a["entry_type"], a["fields"]) >= completeness(b["entry_type"], b["fields"])
    best, other = F.when(keep, a).otherwise(b), F.when(keep, b).otherwise(a)
    stated = lambda m: F.map_filter(m, lambda _, v: F.coalesce(v, F.lit("")) != "")
    extra = F.map_filter(stated(other["fields"]), lambda k, _: ~F.array_contains(F.map_keys(stated(best["fields"])), k))
    return F.struct(best["entry_id"].alias("entry_id"), best["entry_type"].alias("entry_type"), F.map_concat(stated(best["fields"]), extra).alias("fields"))


def merge_duplicates(entries: DataFrame, key: Column) -> DataFrame:
    """One row a group of entries (ord, entry_id, entry_type, fields): key, ord (the first's), ids in order, and the
    entry folded in input order, the score taken anew of what is merged so far."""
    one = F.struct("ord", F.struct("entry_id", "entry_type", "fields").alias("entry"))
    groups = entries.withColumn("key", key).groupBy("key").agg(F.array_sort(F.collect_list(one), lambda x, y: F.when(x["ord"] < y["ord"], -1).when(x["ord"] > y["ord"], 1).otherwise(0)).alias("xs"))
    folded = F.aggregate(F.slice("xs", 2, F.size("xs")), F.col("xs")[0]["entry"], lambda acc, x: merge(acc, x["entry"]))
    return groups.select("key", F.col("xs")[0]["ord"].alias("ord"), F.transform("xs", lambda x: x["entry"]["entry_id"]).alias("ids"), folded.alias("entry")).select("key", "ord", "ids", "entry.*")
