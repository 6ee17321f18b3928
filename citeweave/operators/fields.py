"""Required and recommended fields by entry type: what is missing, and what records can fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.functions.text import blank
from citeweave.operators.entries import fields_of

# Required and recommended fields of each entry type.
REQUIREMENTS = {
    "article": ("author title journal year", "volume number pages doi url"),
    "inproceedings": ("author title booktitle year", "pages doi url publisher address"),
    "incollection": ("author title booktitle publisher year", "editor pages doi url address"),
    "book": ("title publisher year", "author editor volume number series address edition isbn"),
    "phdthesis": ("author title school year", "address month url doi"),
    "mastersthesis": ("author title school year", "address month url"),
    "techreport": ("author title institution year", "number address month url"),
    "unpublished": ("author title note", "year month url"),
    "misc": ("title", "author year url howpublished"),
}
DEFAULT = ("title", "author year")


def requirement_table(spark: SparkSession) -> DataFrame:
    """(entry_type, required, recommended): nine rows."""
    rows = [(t, sorted(a.split()), sorted(b.split())) for t, (a, b) in REQUIREMENTS.items()]
    return spark.createDataFrame(rows, "entry_type string, required array<string>, recommended array<string>")


def _needs(etype: Column, which: int) -> Column:
    out = F.array(*[F.lit(x) for x in sorted(DEFAULT[which].split())])
    for t, needs in REQUIREMENTS.items():
        out = F.when(etype == t, F.array(*[F.lit(x) for x in sorted(needs[which].split())])).otherwise(out)
    return out


def missing_fields(entries: DataFrame, fields: Column | None = None) -> DataFrame:
    """entries with missing_required and missing_recommended, sorted; a book's author and editor stand for each other."""
    have = fields_of(entries) if fields is None else fields
    etype = F.lower(F.coalesce("entry_type", F.lit("misc")))
    present = lambda n: F.coalesce(F.trim(F.try_element_at(F.col("_have"), n)), F.lit("")) != ""
    either = present(F.lit("author")) | present(F.lit("editor"))
    lacking = lambda needs: F.filter(needs, lambda n: ~present(n) & ~((etype == "book") & n.isin("author", "editor") & either))
    out = entries.withColumn("_have", have)
    return out.withColumns({"missing_required": lacking(_needs(etype, 0)), "missing_recommended": lacking(_needs(etype, 1))}).drop("_have")


def fill_fields(entries: DataFrame, candidates: DataFrame, key: str = "entry_id") -> DataFrame:
    """(entry key, filled: map of field to value and source) for missing fields, from candidates (key, source_rank,
    source, fields); the first source that has a field gives it."""
    want = entries.select(key, F.explode(F.array_distinct(F.concat("missing_required", "missing_recommended"))).alias("field"))
    have = candidates.select(key, "source_rank", "source", F.explode("fields").alias("field", "value")).filter(blank(F.col("value")) != "")
    best = want.join(have, [key, "field"]).groupBy(key, "field").agg(F.min(F.struct("source_rank", "source", "value")).alias("x"))
    return best.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", F.struct("x.value", "x.source"))))).alias("filled"))


def fill_action(missing_before: Column, filled: Column, missing_after: Column) -> Column:
    """complete, filled, partial or unfillable."""
    return F.when(missing_before == 0, "complete").when(missing_after == 0, "filled").when(filled > 0, "partial").otherwise("unfillable")


def field_statistics(checked: DataFrame, filled: Column | None = None) -> DataFrame:
    """(field, n_required_missing, n_recommended_missing, n_filled) over all entries."""
    filled = F.array().cast("array<string>") if filled is None else filled
    each = lambda c, n: checked.select(F.explode(c).alias("field"), F.lit(n).alias("kind"))
    rows = each("missing_required", "required").union(each("missing_recommended", "recommended")).union(checked.select(F.explode(filled).alias("field"), F.lit("filled").alias("kind")))
    count = lambda k: F.count_if(F.col("kind") == k)
    return rows.groupBy("field").agg(count("required").alias("n_required_missing"), count("recommended").alias("n_recommended_missing"), count("filled").alias("n_filled"))
