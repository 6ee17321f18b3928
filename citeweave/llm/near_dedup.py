"""Near-duplicate documents: banded MinHash candidates, odd sketches to estimate them, full sets to confirm them.

An odd sketch folds a document's MinHash samples into a bitmap of parities: each sample turns one bit over. Equal samples
of two documents cancel out in the XOR of their sketches, so its population count tells how many samples differ, most
precisely where few do. Candidates far below the threshold go without a look at their shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import checkpoint, forget, in_batches, stored
from citeweave.llm.components import connected_components
from citeweave.llm.hashing import CHUNK, mix, run_hashes, word_hashes

SHINGLE, PERCENT = 5, 80
#: A pair at similarity 0.8 shares no band with a chance of (1 - 0.8**7)**64 = 2.7e-7; one at 0.1 shares one with 6e-6.
BANDS, ROWS = 64, 7
SKETCH_BITS = 512
#: MinHash samples and bits of the finer sketches, made only for documents that share a bucket.
FINE_SAMPLES, FINE_BITS = 1792, 2048
#: Members of a bucket that are compared with one another at once; larger buckets are cut into such blocks.
BLOCK = 1024
#: Standard deviations of the MinHash estimate that a candidate may fall short of the threshold.
SLACK = 6
#: Candidates of a document whose sketches a round compares, those that most of its buckets name; of these the ones it
#: looks at in full, with the most alike sketches; and rounds before whatever buckets still hold several classes are
#: compared across all of these.
NAMED, BEST, ROUNDS = 8, 2, 6
#: A round that finds less than this share of the first one's links is the last.
MIN_GAIN = 0.02
#: Columns of shingle hashes permuted at once, for the processor's cache.
STRIP = 512


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text (lower-cased already) the sorted hashes of its distinct k-word shingles; the whole text's words as
    one shingle if there are fewer, none without words."""
    hashes, first, *_ = word_hashes(texts)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(run_hashes(hashes[a:b], min(k, b - a))) if b > a else np.zeros(0, np.uint64))
    return out


def text_batches(batches, columns: tuple[str, ...]):
    """Lists of each column's values for texts of about CHUNK bytes, the last as lower-cased bytes; null text is empty."""
    *heads, last = columns
    rows = ((*(b[c][i].as_py() for c in heads), b[last][i]) for b in batches for i in range(b.num_rows))
    for held in in_batches(rows, lambda r: 64 + (r[-1].as_buffer().size if r[-1].is_valid else 0), CHUNK):
        *values, texts = zip(*held, strict=True)
        yield *values, [t.as_buffer().to_pybytes().lower() if t.is_valid else b"" for t in texts]


class MinHash:
    """Samples of a set of 64-bit hashes, their bands and odd sketch."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, seed: int = 7):
        r = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows, self.bits = bands, rows, bits
        self.xor = r.integers(0, 1 << 32, (n, 1), np.uint32)
        self.odd = r.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.number = np.arange(n, dtype=np.uint64) << np.uint64(32)
        self.factor = r.integers(0, 1 << 63, (1, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = r.integers(0, 1 << 63, bands, np.uint64)

    def samples(self, hashes: np.ndarray) -> np.ndarray:
        x, out = (hashes >> np.uint64(32)).astype(np.uint32), None
        for k in range(0, len(x), STRIP):
            low = ((x[None, k : k + STRIP] ^ self.xor) * self.odd).min(axis=1)
            out = low if out is None else np.minimum(out, low)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        return mix((mix(samples.reshape(self.bands, self.rows).astype(np.uint64) + self.factor) * self.factor).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        places = mix(samples.astype(np.uint64) + self.number) % np.uint64(self.bits)
        return np.packbits(np.bincount(places.astype(np.int64), minlength=self.bits) & 1).view(np.int64)


def most_differing_bits(percent: int, samples: int, bits: int, slack: float = SLACK) -> int:
    """The XOR's population count beyond which a pair's similarity is below percent, by slack standard deviations.

    With d differing samples 2 * d bits are turned over, of which bits / 2 * (1 - exp(-4 * d / bits)) are odd.
    """
    j = percent / 100
    d = samples * (1 - j) + slack * math.sqrt(samples * j * (1 - j))
    odd = bits / 2 * (1 - math.exp(-4 * d / bits))
    return math.ceil(min(odd + slack / 2 * math.sqrt(bits) / 2, bits))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(id, key, n, k1, k2, bands, sketch) of docs (id, key, text): set size, two checks of the whole set, band keys, odd
    sketch."""

    def run(batches):
        m = MinHash()
        for ids, keys, texts in text_batches(batches, ("id", "key", "text")):
            sets = shingle_sets(texts, k)
            found = [m.samples(s) if len(s) else None for s in sets]
            k1 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            k2 = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([m.keys(f) if f is not None else [] for f in found], pa.list_(pa.int64())), pa.array([m.sketch(f) if f is not None else [] for f in found], pa.list_(pa.int64()))],
                ["id", "key", "n", "k1", "k2", "bands", "sketch"],
            )

    return docs.mapInArrow(run, "id long, key long, n long, k1 long, k2 long, bands array<long>, sketch array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, shingles, fine) of docs (id, text): the full set and the finer odd sketch."""

    def run(batches):
        f = MinHash(FINE_SAMPLES, 1, FINE_BITS, seed=11)
        for ids, texts in text_batches(batches, ("id", "text")):
            sets = shingle_sets(texts, k)
            fine = [f.sketch(f.samples(s)).tobytes() if len(s) else b"" for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(fine, pa.binary())], ["id", "shingles", "fine"])

    return docs.mapInArrow(run, "id long, shingles array<long>, fine binary")


def runs_of(batches, keys: list[str]):
    """Tables of successive rows with equal keys, over batch borders."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for k in keys:
            x = t[k].to_numpy()
            change |= x[1:] != x[:-1]
        at = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield t.slice(a, b - a)
        held = t.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def links_in_blocks(rows: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (a, b) between different classes of a group, of rows (kind, group, i, j, left, right, id, class, main,
    shingles, fine): every left row is compared with every right one, of two that are not of the main class once.

    A pair of blocks (i, j) holds BLOCK rows a side at most, so the work of a large group is spread over tasks. All finer
    sketches are compared, what they do not rule out is confirmed on full sets, and only links leave the task; pairs of
    classes that a link has joined are not looked at again.
    """
    limit = most_differing_bits(percent, FINE_SAMPLES, FINE_BITS)

    def run(batches):
        for t in runs_of(batches, ["kind", "group", "i", "j"]):
            ids, classes = (t[c].to_numpy() for c in ("id", "class"))
            if len(ids) < 2 or (classes == classes[0]).all():
                continue
            main, left, right = (np.array(t[c].to_pylist(), bool) for c in ("main", "left", "right"))
            left, right = np.flatnonzero(left), np.flatnonzero(right)
            sets = [np.asarray(x.values) for x in t["shingles"]]
            n = np.array([len(x) for x in sets])
            fine = np.frombuffer(b"".join(t["fine"].to_pylist()), np.uint64).reshape(len(ids), -1)
            root = {c: c for c in classes.tolist()}

            def top(c: int, root: dict[int, int] = root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            out: list[list[int]] = [[], []]
            for k in range(0, len(left), 64):
                x = left[k : k + 64]
                ok = (classes[x][:, None] != classes[right][None, :]) & (100 * np.minimum(n[x][:, None], n[right][None, :]) >= percent * np.maximum(n[x][:, None], n[right][None, :]))
                ok &= main[right][None, :] | (ids[x][:, None] < ids[right][None, :])
                p, q = np.nonzero(ok)
                p, q = x[p], right[q]
                for c in range(0, len(p), 1 << 14):
                    u, v = p[c : c + (1 << 14)], q[c : c + (1 << 14)]
                    near = np.bitwise_count(fine[u] ^ fine[v]).sum(axis=1) <= limit
                    for a, b in zip(u[near].tolist(), v[near].tolist(), strict=True):
                        ra, rb = top(int(classes[a])), top(int(classes[b]))
                        if ra == rb:
                            continue
                        both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                        if 100 * both >= percent * (n[a] + n[b] - both):
                            root[rb] = ra
                            out[0].append(int(ids[a]))
                            out[1].append(int(ids[b]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    keys = ["kind", "group", "i", "j"]
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def in_blocks(rest: DataFrame) -> DataFrame:
    """(kind, group, i, j, left, right, id, class, main) of mixed buckets (band, id, class): what is to be compared.

    Buckets tied by members are one group (kind 0) where they have BLOCK members or fewer. Larger ones are compared
    bucket by bucket (kind 1), of buckets with the same members one: there the members outside of the bucket's largest
    class, in blocks, meet all of its members, in blocks, so a set is copied once for each block of the others.
    """
    lowest = rest.groupBy("band").agg(F.min("id").alias("a"))
    groups = connected_components(rest.join(lowest, "band").select("a", F.col("id").alias("b")).distinct()).select("id", F.col("component_id").alias("group"))
    small = groups.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") <= BLOCK).select("group")
    of_small = checkpoint(groups.join(small, "group"))
    yes, zero = F.lit(True), F.lit(0)
    whole = rest.select("id", "class").distinct().join(of_small, "id").select(zero.alias("kind"), "group", zero.alias("i"), zero.alias("j"), yes.alias("left"), yes.alias("right"), "id", "class", F.lit(False).alias("main"))

    large = checkpoint(rest.join(of_small.select("id"), "id", "left_anti"))
    same = large.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    one = same.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", "n")
    sizes = large.groupBy("band", "class").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("size", "class")).alias("top")).select("band", "top.*").withColumnRenamed("class", "of")
    both = large.join(one, "band").join(largest, "band").withColumn("main", F.col("class") == F.col("of"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    both = both.withColumns({"others": blocks(F.col("n") - F.col("size")), "every": blocks(F.col("n"))})
    at = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    both = both.withColumns({"mine": at(F.col("others"), 1), "place": at(F.col("every"), 2)})
    to = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    count = lambda n: F.sequence(F.lit(0), n - 1)
    as_right = F.transform(count(F.col("others")), lambda i: to(i, F.col("place"), False, True))
    as_left = F.when(F.col("main"), F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>")).otherwise(F.transform(count(F.col("every")), lambda j: to(F.col("mine"), j, True, False)))
    by_bucket = both.withColumn("to", F.explode(F.concat(as_right, as_left))).select(F.lit(1).alias("kind"), F.col("band").alias("group"), "to.*", "id", "class", "main")
    return whole.unionByName(by_bucket)


def differing_bits(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """With column bits, the pairs (a, b) whose set sizes and odd sketches do not rule the threshold out."""
    x, y = (reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    near = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("bits") <= most_differing_bits(percent, BANDS * ROWS, SKETCH_BITS))
    return pairs.join(x, "a").join(y, "b").withColumn("bits", differing_bits(F.col("s_a"), F.col("s_b"))).filter(near).select(*pairs.columns, "bits")


def without(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    return pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")


def most_named(pairs: DataFrame) -> DataFrame:
    """Of rows (a, b, of, named), a member's candidates that most buckets name; it has two a band at most. The others'
    turn is in later rounds, or when whole buckets are compared."""
    best = F.slice(F.sort_array(F.collect_list(F.struct("named", "a", "b")), asc=False), 1, NAMED)
    return pairs.groupBy("of").agg(best.alias("x")).select("of", F.explode("x").alias("x")).select("x.a", "x.b", "of")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets meet the threshold."""
    x, y = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").filter(100 * both >= percent * (F.size("s_a") + F.size("s_b") - both)).select("a", "b")


def mixed_buckets(members: DataFrame, classes: DataFrame | None, turn: int) -> DataFrame:
    """(band, id, class, low, high) of the members of buckets that hold several classes; low and high are a member of
    the least class and one of the greatest, other ones each turn."""
    with_class = members.withColumn("class", F.col("id")) if classes is None else members.join(classes, "id", "left").select("band", "id", F.coalesce("component_id", "id").alias("class"))
    one = F.struct("class", F.xxhash64("id", F.lit(turn)).alias("order"), "id")
    ends = with_class.groupBy("band").agg(F.min(one).alias("low"), F.max(one).alias("high")).filter(F.col("low.class") < F.col("high.class"))
    return with_class.join(ends, "band")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", *, shingle: int = SHINGLE, percent: int = PERCENT, with_key: bool = False) -> DataFrame:
    """One row a row of docs: id_col, n_shingles, component_id (the least id reachable over links), kept (it is that one).

    Documents are linked whose sets of shingles (words of A-Z lower-cased text) have a Jaccard similarity of percent or
    more. Null, empty and wordless texts have no shingles and no links. Rows repeating an id are judged each by its
    own text; rows without an id keep a null component_id and kept. Other columns are left out; with_key adds `key`,
    xxhash64 of the text (null: empty), which tells rows of one id apart. No rows give no rows.

    Equal sets become one representative first, so exact copies cost nothing further. Then, in rounds, every
    representative in a band bucket of several classes meets a member of another class in it; of the candidates that most
    buckets name, those that the sketches show as most alike are confirmed on full sets, and links join classes. Groups of near copies are one class
    after a few rounds without their pairs having been formed. In whatever buckets still hold several classes, all finer
    sketches are compared across classes, in blocks, and what they do not rule out on full sets, so that no link between
    two classes is missed.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    sigs = stored(signatures(docs, shingle))
    # a representative has a number of its own: ids may repeat
    reps = sigs.filter("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "key", "sketch", "bands")).alias("x"))
    reps = stored(reps.select("k1", "k2", "n", F.col("x.id").alias("doc"), "x.key", "x.sketch", "x.bands", F.monotonically_increasing_id().alias("id")))
    entries = reps.select("id", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("many")).filter("many > 1").select("band")
    members = stored(entries.join(shared, "band").select("band", "id"))
    wanted = members.select("id").distinct()
    reps_in = checkpoint(reps.join(wanted, "id", "left_semi").select("id", "n", "sketch", "doc", "key"))
    texts = docs.join(reps_in.select(F.col("id").alias("rep"), F.col("doc").alias("id"), "key"), ["id", "key"]).select(F.col("rep").alias("id"), "text")
    sets = stored(full_sets(texts, shingle))

    links = classes = tested = first = None
    for turn in range(ROUNDS):
        pivots = mixed_buckets(members, classes, turn).select("id", "class", F.explode(F.array("low", "high")).alias("p")).filter("class <> p.class")
        pairs = pivots.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"), F.col("id").alias("of")).groupBy("a", "b", "of").agg(F.count("*").alias("named"))
        near = plausible(most_named(without(pairs, tested)), reps_in, percent).groupBy("of").agg(F.slice(F.sort_array(F.collect_list(F.struct("bits", "a", "b"))), 1, BEST).alias("x"))
        near = checkpoint(near.select(F.explode("x").alias("x")).select("x.a", "x.b").distinct())
        new = checkpoint(confirmed(near, sets, percent))
        found = new.count()
        if not found:
            break
        tested = near if tested is None else tested.union(near)
        links = new if links is None else links.union(new)
        classes = connected_components(links)
        first = found if turn == 0 else first
        forget(docs.sparkSession)  # the round's shuffles, full sets among them
        if found < MIN_GAIN * first:
            break

    rest = checkpoint(mixed_buckets(members, classes, ROUNDS).select("band", "id", "class"))
    placed = in_blocks(rest).join(sets, "id")
    more = checkpoint(links_in_blocks(placed, percent, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if not more.isEmpty():
        classes = connected_components(more if links is None else links.union(more))
    if classes is None:
        classes = reps.select("id", F.col("id").alias("component_id"))

    linked = classes.join(reps.select("id", "doc"), "id")
    linked = linked.join(linked.groupBy("component_id").agg(F.min("doc").alias("least")), "component_id").select("id", "least")
    of_rep = reps.join(linked, "id", "left").select("k1", "k2", "n", F.coalesce("least", "doc").alias("component_id"))
    out = sigs.select("id", "key", "n", "k1", "k2").join(of_rep, ["k1", "k2", "n"], "left").select("id", "key", "n", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"), *(["key"] if with_key else []))
