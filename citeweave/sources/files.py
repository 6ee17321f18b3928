"""LaTeX, notes, library exports, labelled benchmarks and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeweave.operators.citations import citations
from citeweave.operators.notes import parse_note
from citeweave.sources.bib import read_text_files

ITEM = (
    "key string, version long, data struct<key:string,version:long,itemType:string,title:string,creators:array<struct<creatorType:string,firstName:string,lastName:string,name:string>>,"
    "publicationTitle:string,DOI:string,url:string,date:string,volume:string,issue:string,pages:string,extra:string,abstractNote:string,archiveID:string,tags:array<struct<tag:string>>,collections:array<string>>"
)
BENCHMARK = "bibtex_key string, bibtex_type string, fields map<string,string>, label string, hallucination_type string, source string"


def read_tex(spark: SparkSession, path: str) -> DataFrame:
    """(file, key) of all citations in LaTeX files under a path."""
    return citations(read_text_files(spark, path, "*.tex"))


def read_notes(spark: SparkSession, path: str, pattern: str = "@*.md") -> DataFrame:
    """(path, front, body) of notes."""
    return read_text_files(spark, path, pattern).select(F.col("file").alias("path"), parse_note(F.col("text")).alias("n")).select("path", "n.*")


def write_notes(notes: DataFrame, path: str) -> None:
    """(path, text) as a table of texts by note."""
    notes.select("path", "text").write.mode("overwrite").json(path)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM).json(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows without canaries, of the two labels."""
    rows = spark.read.schema(BENCHMARK).json(path)
    return rows.filter(F.col("label").isin("VALID", "HALLUCINATED") & (F.coalesce("source", F.lit("")) != "canary") & ~F.startswith("bibtex_key", F.lit("__canary__")))


def update_report(updated: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Rows of an update report as JSON lines, dropped keys among them."""
    f = lambda m, k: F.try_element_at(m, F.lit(k))
    row = F.struct("file", F.col("entry_id").alias("key_old"), F.col("new_id").alias("key_new"), f("fields", "doi").alias("doi_old"), f("new_fields", "doi").alias("doi_new"), "action", "method", "confidence", f("fields", "title").alias("title_old"), f("new_fields", "title").alias("title_new"))
    out = updated.select("ord", F.to_json(row).alias("value"))
    if dropped is not None:
        out = out.union(dropped.select(F.col("place").cast("long"), F.to_json(F.struct("file", F.col("key").alias("key_old"), F.lit("dropped").alias("action"))).alias("value")))
    return out


def check_report(checked: DataFrame) -> DataFrame:
    """Rows of a check report as JSON lines."""
    row = F.struct(F.col("entry_id").alias("key"), "status", (F.col("bucket") == "abstained").alias("abstained"), "coverage_incomplete", "confidence", "p_valid", "mismatched_fields", F.col("sources_with_hits").alias("api_sources"))
    return checked.select(F.to_json(row).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)
