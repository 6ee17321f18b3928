"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become sequences of typed tokens: numbers, units of measure and names turn into placeholders, other words into
their lower case. Windows of these templates are hash-joined with those of the benchmark's items, so a question asked
again with other numbers or names still meets its item; a run of names or of numbers is one placeholder, whatever its
length. Matches are then lined up along diagonals (place in the document less place in the item), near ones of which
chain where words were put in or left out, and the slots compared: where few words match, each value of the item must
stand for one value throughout, as it does where a question was re-parameterised and does not where a common frame of
words matched by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import bind, checkpoint

#: Template tokens in a window, and how many of them must be words rather than placeholders.
WINDOW, MIN_LITERALS = 10, 5
#: Windows of an item that must match along a diagonal; an item with fewer windows needs all of them.
MIN_MATCHES = 4
#: Diagonals so near to the next chain. Slots decide only where fewer words of the item than this match.
MAX_SHIFT, FEW_LITERALS = 3, 20
#: Benchmark windows up to which they are broadcast (about 40 bytes each); beyond it the join shuffles.
MAX_BROADCAST = 500_000
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kph kmh hz khz mhz ghz kb mb gb tb v w kw kwh j kj cal kcal n pa kpa "
    "dollar dollars euro euros cent cents usd eur percent degree degrees celsius fahrenheit"
).split()
#: Marks a capital that a sentence's start explains.
START = "\x01"


def tokens(text: Column) -> Column:
    """Runs of letters and digits (a decimal number is one), sentence-initial capitals marked."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(^|[.!?:][\x20\x09-\x0D]+|\n)(\p{Lu})", rf"$1{START}$2")
    joined = F.regexp_replace(marked, r"([0-9])[.,]([0-9])", "$1\x02$2")
    return F.array_remove(F.split(joined, rf"[^\p{{L}}\p{{N}}\x01\x02]+"), "")


def placeholder(token: Column, before: Column) -> Column:
    """A token's typed form; a unit counts as one only right after a number."""
    head = F.substring(token, 1, 1)
    digit = lambda c: (c >= "0") & (c <= "9")
    low = F.lower(token)
    return (
        F.when(digit(head), NUMBER)
        .when(head == START, F.lower(F.substring(token, 2, 1_000_000)))
        .when((low != token) & (F.lower(head) != head) & (F.upper(token) != token), NAME)
        .when(digit(F.substring(F.coalesce(before, F.lit("")), 1, 1)) & low.isin(UNITS), UNIT)
        .otherwise(low)
    )


def template(ts: Column) -> Column:
    return F.transform(ts, lambda t, i: placeholder(t, F.get(ts, i - 1)))


def run_starts(c: Column) -> Column:
    """Places where a template's tokens begin once runs of names and of numbers are one."""
    goes_on = lambda x, i: F.coalesce(x.isin(NUMBER, NAME) & (F.get(c, i - 1) == x), F.lit(False))
    return F.filter(F.transform(c, lambda x, i: F.when(~goes_on(x, i), i)), lambda i: i.isNotNull())


def shape(ts: Column, joined: bool) -> Column:
    """The template, runs as one placeholder if joined."""
    return bind(template(ts), lambda c: bind(run_starts(c), lambda at: F.transform(at, lambda i: F.get(c, i)))) if joined else template(ts)


def values(ts: Column, joined: bool) -> Column:
    """The text of each of the template's tokens."""
    text = lambda at: F.transform(at, lambda a, j: F.array_join(F.slice(ts, a + 1, F.coalesce(F.get(at, j + 1), F.size(ts)) - a), " "))
    return bind(bind(template(ts), run_starts), text) if joined else ts


def is_slot(c: Column) -> Column:
    return c.isin(NUMBER, UNIT, NAME)


def window_hashes(template: Column, window: int) -> Column:
    n = F.size(template)
    return F.when(n >= window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(template, i, window)))).otherwise(F.array().cast("array<bigint>"))


def contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", *,
    window: int = WINDOW, min_literals: int = MIN_LITERALS, min_matches: int = MIN_MATCHES,
) -> DataFrame:
    """One row a document and item found in it: id_col, item_id, n_matched, n_windows (the item's), n_slots, n_changed
    (slots whose value differs), kind (verbatim or reparameterised).

    Documents and items without text, items under `window` tokens and items of placeholders alone match nothing. Of
    several alignments the one with most matches counts, of equals the earliest. Rows repeating an id are one document.
    Other columns are left out. No documents or no items give no rows.
    """
    items = items.select(F.col(item_id).cast("long").alias("item"), tokens(F.col(item_text)).alias("ts")).dropDuplicates(["item"])
    items = checkpoint(items.select("item", "ts", shape(F.col("ts"), True).alias("c")))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    enough = F.size("c") >= window
    out = aligned(docs, items.filter(enough), True, window, min_literals, min_matches)
    short = items.filter(~enough & (F.size("ts") >= window))
    if not short.isEmpty():  # too short for a window once runs are joined
        out = out.unionByName(aligned(docs, short.withColumn("c", template(F.col("ts"))), False, window, min_literals, min_matches))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_matched", "n_windows", "n_slots", "n_changed", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"))


def aligned(docs: DataFrame, items: DataFrame, joined: bool, window: int, min_literals: int, min_matches: int) -> DataFrame:
    """(id, item, n_matched, n_windows, n_slots, n_changed) of docs (id, text) and items (item, ts, c)."""
    own = items.select("item", "c", F.posexplode(window_hashes(F.col("c"), window)).alias("at", "hash"))
    literal = F.size(F.filter(F.slice("c", F.col("at") + 1, window), lambda c: ~is_slot(c)))
    own = checkpoint(own.filter(literal >= min_literals).select("item", F.col("at").alias("item_at"), "hash"))
    n_own = own.groupBy("item").agg(F.countDistinct("item_at").alias("n_windows"))

    places = docs.select("id", F.posexplode(bind(tokens(F.col("text")), lambda ts: bind(shape(ts, joined), lambda c: window_hashes(c, window)))).alias("at", "hash"))
    hits = places.join(F.broadcast(own) if own.count() <= MAX_BROADCAST else own, "hash")
    lined = hits.groupBy("id", "item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("item_at").alias("ats"))
    by_shift = Window.partitionBy("id", "item").orderBy("shift")
    lined = lined.withColumn("chain", F.sum(F.when(F.col("shift") - F.lag("shift").over(by_shift) <= MAX_SHIFT, 0).otherwise(1)).over(by_shift))
    every = F.collect_list("ats").over(Window.partitionBy("id", "item", "chain"))
    lined = lined.withColumns({"alone": F.size("ats"), "n_lines": F.size(every), "n_chain": F.size(F.array_distinct(F.flatten(every)))}).join(n_own, "item")
    least = F.least(F.lit(min_matches), F.col("n_windows"))
    # each diagonal by itself, and the chain where it has more
    way = lambda single, group, n: F.struct(F.lit(single).alias("single"), F.col(group).cast("long").alias("group"), F.col(n).cast("long").alias("n_matched"))
    ways = F.when(F.col("n_lines") > 1, F.array(way(True, "shift", "alone"), way(False, "chain", "n_chain"))).otherwise(F.array(way(True, "shift", "alone")))
    ways = F.filter(ways, lambda w: w["n_matched"] >= least)
    lined = checkpoint(lined.filter(F.col("n_chain") >= least).select("id", "item", "shift", "n_windows", F.array_min("ats").alias("low"), F.array_max("ats").alias("high"), ways.alias("ways")))

    # slots along each diagonal, from the texts of matched documents alone
    sides = items.select("item", "c", values(F.col("ts"), joined).alias("theirs"))
    both = docs.join(lined.join(sides, "item"), "id").withColumn("mine", values(tokens(F.col("text")), joined))
    spots = F.transform(
        F.sequence("low", F.col("high") + window - 1),
        lambda p: F.struct(p.alias("at"), F.when(is_slot(F.get("c", p)), F.lower(F.get("theirs", p))).alias("of"), F.when(is_slot(F.get("c", p)), F.lower(F.get("mine", p + F.col("shift")))).alias("is")),
    )
    each = both.select("id", "item", "shift", "n_windows", spots.alias("spots"), "ways").withColumn("way", F.explode("ways"))
    whole = each.groupBy("id", "item", "way").agg(F.min("shift").alias("shift"), F.first("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_list("spots"))).alias("spots"))
    slots = F.filter("spots", lambda x: x["of"].isNotNull())
    n_places = lambda xs: F.size(F.array_distinct(F.transform(xs, lambda x: x["at"])))
    pairs = F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["of"], x["is"]))))
    one_value = pairs == F.size(F.array_distinct(F.transform("slots", lambda x: x["of"])))
    checked = whole.withColumn("slots", slots).withColumns({"n_slots": n_places(F.col("slots")), "n_same": n_places(F.filter("slots", lambda x: x["of"].eqNullSafe(x["is"])))})
    checked = checked.filter(one_value | (n_places(F.col("spots")) - F.col("n_slots") >= FEW_LITERALS))
    best = checked.groupBy("id", "item").agg(F.max(F.struct("way.n_matched", "way.single", (-F.col("shift")).alias("early"), "n_windows", "n_slots", (F.col("n_slots") - F.col("n_same")).alias("n_changed"))).alias("x"))
    return best.select("id", "item", *[F.col(f"x.{c}").cast("long").alias(c) for c in ("n_matched", "n_windows", "n_slots", "n_changed")])
