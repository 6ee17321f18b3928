"""A corpus prepared for training in five stages, each read from what the one before it wrote."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.llm.common import drop, scope, shared_folder, table
from citeweave.llm.line_frequency import line_frequency_rules
from citeweave.llm.near_dedup import near_duplicates
from citeweave.llm.packing import pack
from citeweave.llm.repeated_phrases import remove_repeats
from citeweave.llm.templates import contaminated

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Tables that the operators of the stage before stored; its result is written by the time the next stage is called.
_left: list[str] = []


def stage(f):
    """A stage that first deletes what the operators of the stages before it stored and shuffled."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _left)
        _left.clear()
        with scope() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


def with_text(rows: DataFrame, text) -> DataFrame:
    """The documents of column `row` with another text."""
    return rows.select("row.*", text.alias("new")).withColumns({"text": F.col("new"), "n_chars": F.length("new").cast("long")}).select(COLUMNS)


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are frequent in their host.

    Null and empty texts fail and go; rows repeating an id are judged each by its own text. Columns that documents do not
    have are left out; no rows give no rows, here and in the stages below.
    """
    return with_text(line_frequency_rules(docs, with_row=True).filter("kept"), F.col("clean_text"))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id.

    Rows without an id and those without a word have no group and stay. Rows repeating an id are judged each by its own
    text; of those with one id and text one stays.
    """
    gone = near_duplicates(docs, with_key=True).filter("not kept").select("doc_id", "key").distinct()
    rows = docs.withColumn("key", F.xxhash64(F.coalesce("text", F.lit("")))).join(gone, ["doc_id", "key"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("lang", "source", "n_chars"))
    return rows.withColumn("nth", nth).filter("nth = 1 or doc_id is null").select(COLUMNS)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row without the passages that stand elsewhere too; one that loses none keeps its text as it is, null and
    empty ones among them. Rows that repeat a text lose it all, whatever their ids, if it is as long as a passage."""
    out = remove_repeats(docs, with_row=True)
    return with_text(out, F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept_text")))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, neither word for word nor with other numbers or names. Of a repeated id all
    rows go if one of them holds an item; rows without an id or a text stay."""
    found = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(COLUMNS)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids; every row is packed, an empty or null text as its end id alone."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("packing", packing)]
#: Packing needs a tokenizer's ids, which SQL cannot give; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
