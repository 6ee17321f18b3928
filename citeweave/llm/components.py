"""Connected components by alternating stars, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import checkpoint


#: Links in a task's share; fewer links than shuffle partitions need are kept together, as each file has its cost.
LINKS_A_TASK = 100_000


def star(links: DataFrame, small: bool, tasks: int) -> DataFrame:
    """One round over links (u > v). Large: each node ties its larger neighbours to the least one; small: its smaller.

    The least neighbour is an aggregate with map-side combining; links then meet it in a join whose hot keys Spark can
    split, so a node with very many links is not the work of one task.
    """
    if small:
        both = links
        least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        out = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    else:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        out = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in links (a, b), component_id the least id reachable; no rows for no links."""
    now = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks, mark = 1 + now.count() // LINKS_A_TASK, None
    now = now.coalesce(tasks)
    while True:
        now = checkpoint(star(star(now, False, tasks), True, tasks))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return out.union(out.select(F.col("component_id").alias("id"), "component_id").distinct())
