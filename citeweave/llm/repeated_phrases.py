"""Substring deduplication: passages of `window` words that start at two places or more, located by phrase automata.

1. Winnowing picks from each document the core phrases (`core` consecutive words) of least hash in every run of
   window - core + 1 cores. Two equal windows have the same least core at the same place, so a recurring passage has a
   core that is picked wherever it stands. Cores picked at two places or more, counted over all documents, are the
   confirmed recurring phrases.
2. Phrases are dealt to shards by their hash. Every document sends to a shard the stretches of its text in which a
   window can lie whose least core is one of the shard's phrases; a phrase's text comes once, from the first document
   that holds it. Where a stretch holds which phrase is not sent.
3. A shard compiles one Aho-Corasick automaton of its phrases and streams all its stretches through it. The windows around
   the located phrases are hashed and counted. Equal windows have the same least core and meet in the same shard, so
   what a shard finds twice recurs, and what it finds once does not.
4. A phrase of very many places is dealt on by document over several shards that compile it each. What such a shard
   finds once may stand in another one: these windows alone are counted over all shards by hash.

A document passes through as many stretches as it has confirmed phrases, however many phrases the corpus has. Exact
copies of a text are searched once and count as two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import bind, in_batches, stored, words
from citeweave.llm.hashing import CHUNK, run_hashes, word_hashes

WINDOW, CORE = 35, 8
#: Places of confirmed phrases in a shard, about 350 bytes of text each; a phrase with more places has several shards.
SHARD_PLACES = 20_000
#: Phrases with more than this part of all places are joined by broadcast: fewer than 1 / part of them can exist.
HOT_PART = 0.0005
PART = "key long, check long, start int, stop int, hash long, kind int"


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive elements; empty if there are fewer."""
    if len(x) < k:
        return x[:0]
    done = 1
    while 2 * done <= k:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (k - done)], x[k - done :]) if done < k else x


def whole_windows(first: np.ndarray, window: int) -> np.ndarray:
    """For each start of a window in texts laid end to end, whether it ends in the text it starts in; text k has the
    words first[k] to first[k + 1]."""
    n = int(first[-1]) - window + 1
    out = np.zeros(max(n, 0) + 1, np.int64)
    sizes = np.diff(first)
    long = sizes >= window
    np.add.at(out, first[:-1][long], 1)
    np.add.at(out, first[:-1][long] + sizes[long] - window + 1, -1)
    return np.cumsum(out)[: max(n, 0)] > 0


def picked(hashes: np.ndarray, first: np.ndarray, window: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, core hashes by place): in texts laid end to end, the cores of least hash in some window of their text."""
    cores, span = run_hashes(hashes, core), window - core + 1
    least = sliding_min(cores, span)
    # a core is picked if it is the least of a window that holds it; every window's least is at most the core
    widest = np.zeros(len(cores) + span - 1, np.uint64)
    widest[span - 1 : span - 1 + len(least)] = np.where(whole_windows(first, window), least, 0)
    top = ~sliding_min(~widest, span)
    return np.flatnonzero((top == cores) & (top > 0)), cores


def texts_of(batches, most: int = CHUNK):
    """Lists of rows whose second column is the text, and their texts' bytes."""
    rows = (tuple(b[i][k] for i in range(b.num_columns)) for b in batches for k in range(b.num_rows))
    for held in in_batches(rows, lambda r: 64 + (r[1].as_buffer().size if r[1].is_valid else 0), most):
        yield held, [r[1].as_buffer().to_pybytes() if r[1].is_valid else b"" for r in held]


def cores_of(texts: DataFrame, window: int, core: int) -> DataFrame:
    """(key, at, phrase) of texts (key, text): place and hash of every picked core."""

    def run(batches):
        for held, raw in texts_of(batches):
            hashes, first, *_ = word_hashes(raw)
            places, cores = picked(hashes, first, window, core)
            if len(places):
                of = np.searchsorted(first, places, "right") - 1
                keys = np.array([r[0].as_py() for r in held], np.int64)
                columns = keys[of], (places - first[of]).astype(np.int32), cores[places].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "at", "phrase"])

    return texts.mapInArrow(run, "key long, at int, phrase long")


def stretches(texts: DataFrame, window: int, core: int) -> DataFrame:
    """(shard, kind, key, check, base, weight, text) of texts (key, text, check, weight, marks, tells), marks and tells
    shard * 2**32 + place: kind 1 are the stretches of a text, from word `base` on, in which the windows around the
    shard's marks lie; kind 0 the phrases that the text tells a shard. Words stand between single spaces."""
    span = window - core + 1
    names = ["shard", "kind", "key", "check", "base", "weight", "text"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        for held, raw in texts_of(batches):
            _, first, starts, ends, buffer = word_hashes(raw)
            whole, out = buffer.tobytes(), []

            def cut(a: int, b: int, whole=whole, starts=starts, ends=ends) -> bytes:
                return b" ".join(whole[starts[a] : ends[b - 1]].split())

            for r, a, b in zip(held, first[:-1].tolist(), first[1:].tolist(), strict=True):
                key, check, weight = r[0].as_py(), r[2].as_py(), r[3].as_py()
                marks = np.sort(r[4].values.to_numpy(zero_copy_only=False))
                shard, at = marks >> 32, marks & 0xFFFFFFFF
                low, high = np.maximum(at - span + 1, 0), np.minimum(at + window, b - a)
                new = np.append(True, (shard[1:] != shard[:-1]) | (low[1:] > high[:-1]))
                for s, x, y in zip(shard[new].tolist(), low[new].tolist(), high[np.append(new[1:], True)].tolist(), strict=True):
                    out.append((s, 1, key, check, x, weight, cut(a + x, a + y)))
                for t in r[5].as_py():
                    at = t & 0xFFFFFFFF
                    if a + at + core <= b:  # else a mark of another text with the same key
                        out.append((t >> 32, 0, 0, 0, 0, 0, cut(a + at, a + at + core)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return texts.mapInArrow(run, "shard int, kind int, key long, check long, base int, weight int, text binary")


def compiled(phrases):
    """An automaton of byte phrases, each bounded by single spaces, or None for none; its values are their lengths."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for p in phrases:
        p = f" {p.decode('latin-1')} "
        out.add_word(p, len(p))
    if not len(out):
        return None
    out.make_automaton()
    return out


def shards_of(batches):
    """For successive rows of one shard: its number, phrases, and (key, check, base, weight, text) of its stretches."""
    now, phrases, rows = None, set(), []
    for b in batches:
        for shard, kind, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if shard != now:
                if rows:
                    yield now, phrases, rows
                now, phrases, rows = shard, set(), []
            if kind:
                rows.append(row)
            else:
                phrases.add(row[-1])
    if rows:
        yield now, phrases, rows


def recurring(rows: DataFrame, window: int, core: int, closed: int) -> DataFrame:
    """Of stretches, dealt and sorted by shard: (key, check, start, stop) of words covered by windows found twice in
    their shard, of kind 0. Shards from number `closed` on share phrases with others: a window found once there is
    kind 1, at `start`, and the hash of one found twice kind 2."""
    span = window - core + 1

    def run(batches):
        for shard, phrases, held in shards_of(batches):
            automaton = compiled(phrases)
            if automaton is None:
                continue
            keys, checks, bases, weights = (np.array([r[i] for r in held], np.int64) for i in range(4))
            # as Latin-1 a character is a byte; no phrase can run over the line ends between stretches
            text = b" " + b" \n ".join(r[4] for r in held) + b" "
            hashes, _, starts, *_ = word_hashes([text])
            first = np.cumsum([0, *(r[4].count(b" ") + 1 for r in held)])
            hits = np.fromiter((end - size + 2 for end, size in automaton.iter(text.decode("latin-1"))), np.int64)
            cores = run_hashes(hashes, core)
            located = np.full(len(cores), np.iinfo(np.uint64).max, np.uint64)
            at = np.searchsorted(starts, hits)
            located[at] = cores[at]
            places = np.flatnonzero(whole_windows(first, window) & (sliding_min(located, span) == sliding_min(cores, span)))
            if not len(places):
                continue
            found = run_hashes(hashes, window)[places]
            of = np.searchsorted(first, places, "right") - 1
            kinds, which = np.unique(found, return_inverse=True)
            again = (np.bincount(which, weights[of]) >= 2)[which]

            i, k = places[again & (weights[of] < 2)], of[again & (weights[of] < 2)]
            new = np.append(True, (k[1:] != k[:-1]) | (i[1:] > i[:-1] + window))[: len(i)]
            begin, last = i[new], i[np.append(new[1:], True)[: len(i)]]
            k = k[new]
            shift = bases[k] - first[k]
            none = np.zeros(len(k), np.int64)
            parts = [(keys[k], checks[k], begin + shift, last + shift + window, none, none)]
            if shard >= closed:
                i, k = places[~again], of[~again]
                begin = i + bases[k] - first[k]
                parts.append((keys[k], checks[k], begin, begin + window, found[~again].view(np.int64), np.ones(len(k), np.int64)))
                twice = np.unique(found[again]).view(np.int64)
                none = np.zeros(len(twice), np.int64)
                parts.append((none, none, none, none, twice, none + 2))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(t) for c, t in zip(columns, types, strict=True)], ["key", "check", "start", "stop", "hash", "kind"])

    return rows.mapInArrow(run, PART)


def union_of(runs: Column) -> Column:
    """Separate sorted runs (start, stop) that cover what the given ones cover."""

    def merge(both: Column) -> Column:
        a, b = both["a"], both["b"]
        # words end to be covered where as many runs have stopped as have started
        begin = F.filter(a, lambda x, i: (i == 0) | (x > F.get(b, i - 1)))
        stop = F.filter(b, lambda x, i: (i == F.size(b) - 1) | (F.get(a, i + 1) > x))
        return F.arrays_zip(begin.alias("start"), stop.alias("stop"))

    side = lambda c: F.sort_array(F.transform(runs, lambda r: r[c]))
    out = bind(F.struct(side("start").alias("a"), side("stop").alias("b")), merge)
    return F.transform(out, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop")))


def kept_words(ws: Column, covered: Column) -> Column:
    """The words outside of the sorted runs."""
    n = F.size(covered)
    tail = F.element_at(covered, -1)["stop"]
    before = F.transform(covered, lambda r, i: bind(F.when(i == 0, 0).otherwise(F.get(covered, i - 1)["stop"]), lambda p: F.slice(ws, p + 1, r["start"] - p)))
    return F.when(n == 0, ws).otherwise(F.concat(F.flatten(before), F.slice(ws, tail + 1, F.size(ws) - tail)))


def marked_texts(cores: DataFrame, shard_places: int) -> tuple[DataFrame, int, int]:
    """((key, marks, tells) of each text with confirmed phrases, shards with phrases of their own, other shards)."""
    spark = cores.sparkSession
    counts = stored(cores.groupBy("phrase").agg(F.count("*").alias("n"), F.min("key").alias("teller")).filter("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    closed = max(1 + total // shard_places, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_open = counts.agg(F.coalesce(F.sum(F.when(F.col("n") > shard_places, F.ceil(F.col("n") / shard_places))), F.lit(0))).first()[0]

    salts = F.when(F.col("n") > shard_places, F.ceil(F.col("n") / shard_places)).otherwise(1)
    salted = lambda salt: F.lit(closed) + F.pmod(F.xxhash64("phrase", salt), F.lit(max(1, n_open)))
    own = F.pmod("phrase", F.lit(closed))
    place = lambda shard: shard.cast("long") * (1 << 32) + F.col("at")
    mark = place(F.when(F.col("salts") == 1, own).otherwise(salted(F.pmod(F.xxhash64("key"), F.col("salts")))))
    tell = F.when(F.col("teller") == F.col("key"), F.when(F.col("salts") == 1, F.array(place(own))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1), lambda s: place(salted(s)))))

    is_hot = F.col("n") > HOT_PART * total
    hot = F.broadcast(counts.filter(is_hot))
    both = cores.join(hot, "phrase").unionByName(cores.join(hot, "phrase", "left_anti").join(counts.filter(~is_hot), "phrase"))
    both = both.withColumn("salts", salts.cast("long")).select("key", mark.alias("mark"), tell.alias("tell"))
    return both.groupBy("key").agg(F.collect_set("mark").alias("marks"), F.flatten(F.collect_set("tell")).alias("tells")), closed, n_open


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", *, window: int = WINDOW, core: int = CORE, shard_places: int = SHARD_PLACES, with_row: bool = False) -> DataFrame:
    """One row a row of docs: id_col, n_words, n_removed, spans (start, stop of removed words), kept_text.

    A word goes if some window of `window` words over it (words are runs without ASCII white space, compared as they
    are) also starts anywhere else, in the same document too. kept_text joins the other words by single spaces. Null,
    empty and shorter texts lose nothing; a null text gives "". Rows that repeat a text, with whatever id, repeat each
    other. Other columns are left out, whatever they are called; with_row adds `row`, a struct of all columns of docs. No
    rows give no rows.
    """
    columns = docs.columns
    # a text is known by two hashes; rows carry it once, everything else beside it
    others = [c for c in columns if c != text and (with_row or c == id_col)]
    whole = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.struct(*others).alias("others"), F.col(text).alias("text"), F.xxhash64(whole).alias("key"), F.xxhash64(whole, F.lit(1)).alias("check"))
    id_ = F.col("others").getField(id_col)
    cores = stored(cores_of(docs.select("key", "text"), window, core))
    copies = stored(docs.groupBy("key", "check").agg(F.min(id_).alias("first"), F.count("*").alias("copies")))

    marked, closed, n_open = marked_texts(cores, shard_places)
    of = copies.join(marked, "key").select(F.col("key").alias("k"), F.col("check").alias("c"), "first", F.least("copies", F.lit(2)).cast("int").alias("weight"), "marks", "tells")
    texts = docs.join(of, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")) & id_.eqNullSafe(F.col("first"))).select("key", "text", "check", "weight", "marks", "tells")
    rows = stretches(texts, window, core).repartition(closed + n_open, "shard").sortWithinPartitions("shard", "kind")
    found = stored(recurring(rows, window, core, closed))

    runs = found.filter("kind = 0").select("key", "check", "start", "stop")
    if n_open:
        twice = found.filter("kind > 0").groupBy("hash").agg(F.sum("kind").alias("n")).filter("n > 1").select("hash")
        runs = runs.union(found.filter("kind = 1").join(twice, "hash", "left_semi").select("key", "check", "start", "stop"))
    spans = runs.groupBy("key", "check").agg(union_of(F.collect_list(F.struct("start", "stop"))).alias("spans")).withColumn("copied", F.lit(False))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    copied = copies.filter("copies > 1").select("key", "check", none.alias("spans"), F.lit(True).alias("copied"))

    out = docs.join(spans.union(copied), ["key", "check"], "left").withColumn("words", words(F.col("text")))
    n = F.size("words")
    all_words = F.when(n >= window, F.array(F.struct(F.lit(0).alias("start"), n.alias("stop")))).otherwise(none)
    out = out.withColumn("spans", F.when(F.col("copied"), all_words).otherwise(F.coalesce("spans", none)))
    removed = F.aggregate("spans", F.lit(0), lambda a, r: a + r["stop"] - r["start"])
    row = F.struct(*[F.col("text").alias(text) if c == text else F.col("others").getField(c).alias(c) for c in columns]).alias("row") if with_row else None
    return out.select(id_.alias(id_col), n.cast("long").alias("n_words"), removed.cast("long").alias("n_removed"), "spans", F.array_join(kept_words(F.col("words"), F.col("spans")), " ").alias("kept_text"), *([row] if with_row else []))
