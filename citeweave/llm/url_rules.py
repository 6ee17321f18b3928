"""URL filters by a sort-merge range join, in DataFrame operations only.

The key of a rule or URL is its host's labels reversed, a separator and its path, so that what a rule's host and path
begin is one interval of keys, and intervals of rules nest or are apart. A URL has a key for its host and for each host
above it that rules name, as rules hold for subdomains. Keys and rule starts are sorted together; a sweep carries the last
rule start passed with the stack of rules that it is nested in. What of this stack is still open at a key (the others are
popped) are the rules that hold there; over a URL's keys the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = "\x01"
RULE = "struct<start:string,host:string,path:string,action:string>"
#: Rule hosts up to which they are broadcast, to leave out hosts that no rule names; beyond it these are joined by a shuffle.
MAX_BROADCAST = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def stacks(rules: DataFrame) -> DataFrame:
    """(key, host_key, stack) of each rule start: the rules whose intervals hold it, those of its host whose paths begin
    its path. Looked up at the lengths that paths of the host have, so a stack is as deep as paths nest."""
    rules = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").filter("host <> ''").distinct()
    keyed = rules.withColumn("host_key", host_key(F.col("host"))).withColumn("start", F.concat("host_key", F.lit(SEPARATOR), "path"))
    sizes = keyed.groupBy("host_key").agg(F.collect_set(F.length("path")).alias("sizes"))
    each = keyed.select("host_key", "path", F.col("start").alias("key")).distinct().join(sizes, "host_key")
    each = each.select("key", "host_key", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.length("path")), lambda n: F.concat("host_key", F.lit(SEPARATOR), F.substring(F.col("path"), F.lit(1), n)))).alias("start"))
    return each.join(keyed.drop("host_key"), "start").groupBy("key", "host_key").agg(F.sort_array(F.collect_list(F.struct("start", "host", "path", "action"))).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", id_col: str = "page_id", *, default: str = "allow") -> DataFrame:
    """One row a row of urls: id_col, host, path, rule (host and path of the deciding one, else null), verdict.

    rules: host, path, action. A rule fits its host and its subdomains where its path begins the URL's; the longest (host
    and path together, then host) decides; the first in order of text where a rule has two actions. Without a rule the
    verdict is default. Null URLs and those without `://` have an empty host and path, and no rule. Repeated rows stay
    apart; other columns are left out. No rows give no rows, no rules the default for all.
    """
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col(url))
    pages = stored(urls.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path")))
    starts = stored(stacks(rules))

    # a URL has a key for its host and for each one above it that rules name
    labels = F.reverse(F.split("host", r"\."))
    above = F.transform(labels, lambda x, i: F.concat(F.array_join(F.slice(labels, 1, i + 1), "."), F.lit(".")))
    keys = pages.filter("host <> ''").select("row", "path", F.explode(above).alias("host_key"))
    hosts = starts.select("host_key").distinct()
    keys = keys.join(F.broadcast(hosts) if hosts.count() <= MAX_BROADCAST else hosts, "host_key", "left_semi")
    events = keys.select("row", F.concat("host_key", F.lit(SEPARATOR), "path").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(f"array<{RULE}>").alias("stack"))
    events = events.union(starts.select(F.lit(-1).cast("long").alias("row"), "key", F.lit(0).alias("kind"), "stack"))
    # the row parts URLs of one key too, so that one that a third of all rows have is not one task's
    events = stored(events.repartitionByRange(parts, "key", "kind", "row").withColumn("part", F.spark_partition_id()))

    # what each part's sweep begins with: the last rule start in the parts before it; a row a part
    ends = events.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    before = ends.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("passed", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1").join(F.broadcast(before), "part")

    # of the start passed last, the rules still open here are those that begin the key; the last is the longest
    passed = F.coalesce("passed", "before", F.array().cast(f"array<{RULE}>"))
    fits = F.filter(passed, lambda r: F.startswith(F.col("key"), r["start"]))
    ranked = F.transform(fits, lambda r: F.struct((-F.length(r["host"]) - F.length(r["path"])).alias("size"), (-F.length(r["host"])).alias("of_host"), r["action"].alias("action"), F.concat(r["host"], r["path"]).alias("rule")))
    found = swept.select("row", F.array_min(ranked).alias("best")).filter("best is not null").groupBy("row").agg(F.min("best").alias("best"))
    return pages.join(found, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
