"""Topics: a taxonomy, classification by embeddings, and collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeweave.functions.sets import cosine


def taxonomy_paths(spark: SparkSession, topics: DataFrame) -> DataFrame:
    """topics (topic_id, name, parent_id) with path (names from the root), depth and dfs (sorts parents before children)."""
    topics.createOrReplaceTempView("_topics")
    return spark.sql("""
        WITH RECURSIVE t(topic_id, name, parent_id, path, depth, dfs) AS (
          SELECT topic_id, name, parent_id, name, 0, CAST(topic_id AS STRING) FROM _topics WHERE parent_id IS NULL
          UNION ALL
          SELECT c.topic_id, c.name, c.parent_id, concat(t.path, '/', c.name), t.depth + 1, concat(t.dfs, '/', CAST(c.topic_id AS STRING)) FROM _topics c JOIN t ON c.parent_id = t.topic_id)
        SELECT * FROM t""")


def search_topics(topics: DataFrame, word: str) -> DataFrame:
    """Topics whose name or a keyword contains a word."""
    w = F.lit(word.lower())
    return topics.filter(F.contains(F.lower("name"), w) | F.exists("keywords", lambda k: F.contains(F.lower(k), w)))


def topic_text(name: Column, keywords: Column) -> Column:
    return F.concat_ws(" ", name, F.array_join(keywords, " "))


def paper_text(title: Column, abstract: Column) -> Column:
    return F.concat_ws(". ", F.when(title != "", title), F.when(abstract != "", abstract))


def classify(papers: DataFrame, topics: DataFrame, threshold: float = 0.3, max_topics: int = 3) -> DataFrame:
    """(paper_id, topic_id, confidence, rank): the best topic always, others up to max_topics that reach threshold.

    Topics (topic_id, vector) are a taxonomy's, so every paper (paper_id, vector) meets every topic: a join with a
    stated, small side, the pairs being the result's own candidates.
    """
    t = topics.agg(F.collect_list(F.struct("topic_id", "vector")).alias("ts"))
    scored = papers.join(F.broadcast(t)).select("paper_id", F.explode(F.transform("ts", lambda x: F.struct(x["topic_id"].alias("topic_id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("vector"), x["vector"]))).alias("confidence")))).alias("x")).select("paper_id", "x.*")
    w = Window.partitionBy("paper_id").orderBy(F.col("confidence").desc(), "topic_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") == 1) | ((F.col("confidence") >= threshold) & (F.col("rank") <= max_topics)))


def match_collections(predictions: DataFrame, collections: DataFrame) -> DataFrame:
    """predictions (topic_id, topic_name, collection_key) with the collection's key: by key, else by name; null is new."""
    known = collections.select(F.col("key").alias("k1"))
    named = collections.groupBy(F.lower("name").alias("low")).agg(F.min("key").alias("k2"))
    out = predictions.join(known, F.col("collection_key") == F.col("k1"), "left").join(named, F.lower("topic_name") == F.col("low"), "left")
    return out.withColumn("target", F.coalesce("k1", "k2")).withColumn("is_new", F.col("target").isNull()).drop("k1", "k2", "low")


def missing_levels(paths: DataFrame, collections: DataFrame) -> DataFrame:
    """Levels of topic paths (`a/b/c`) that no collection path has yet, parents first."""
    parts = F.split("path", "/")
    levels = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    return levels.join(collections.select("path"), "path", "left_anti").withColumn("depth", F.size(F.split("path", "/")) - 1)


def parse_response(text: Column, schema: str) -> Column:
    """The JSON of a response, out of a fenced block where there is one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(text), schema)


def cached(items: DataFrame, cache: DataFrame, now: Column, ttl_days: int) -> DataFrame:
    """Items with their newest cached classification that is not too old, else null."""
    fresh = cache.filter(F.col("ts") > now - F.expr(f"interval {int(ttl_days)} days")).groupBy("item_key").agg(F.max_by("classification", "ts").alias("classification"))
    return items.join(fresh, "item_key", "left")
