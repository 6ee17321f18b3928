"""Language identification by n-gram filters that answer with a bitmask of languages.

A bit-sliced Bloom filter holds a bit a language for each slot, in as many machine words as the languages need; the bits
of language l are its own filter (128 KB). An n-gram's few slots, combined by AND, give in one look-up every language whose n-grams include it. Summing each bit over a text's
n-grams counts them by language; a filter's known rate of false positives is taken out of its count, and the language
with the largest part decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import checkpoint, in_batches
from citeweave.llm.hashing import mix
from citeweave.llm.toxicity import held_out

#: Labelled rows of each language that are learned from: those of least hash of id, so many at most.
MAX_ROWS = 1500
#: n-grams of bytes; slots of the filter (a power of two) and hashes of an n-gram.
N, SLOTS, HASHES = 4, 1 << 20, 3
#: n-grams kept of each language by default, the most frequent; of a language's n-grams, its share against the language where the
#: n-gram is most frequent below which a language does not contain it.
MAX_GRAMS, MIN_SHARE = 60_000, 0.2
#: Rows to learn from that are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 500_000
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
TEXT_BYTES = 1 << 20
_letters_only = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """The n-grams, as numbers, of the lower-cased text's bytes, other ASCII than letters as single spaces."""
    clean = b"  " + b" ".join(text.lower().encode("utf-8", "replace").translate(_letters_only).split()) + b"  "
    x = np.frombuffer(clean, np.uint8).astype(np.uint32)
    n = len(x) - N + 1
    out = x[:n].copy()
    for k in range(1, N):
        out = (out << np.uint32(8)) | x[k : k + n]
    return out


def slots(g: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def of(cls, languages: list[str], members: list[np.ndarray], size: int = SLOTS) -> Filters:
        """table[w] is machine word w of all slots, of as few bits as hold all languages, of 64 where it takes several."""
        kind, bits = next(((t, b) for t, b in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= b), (np.uint64, 64))
        table = np.zeros((max(1, -(-len(languages) // bits)), size), kind)
        for k, g in enumerate(members):
            for at in slots(g, size):
                table[k // bits][at] |= kind(1 << k % bits)
        fill = np.array([float(((table[k // bits] >> kind(k % bits)) & kind(1)).mean()) for k in range(len(languages))])
        return cls(languages, table, fill**HASHES)

    def masks(self, g: np.ndarray) -> np.ndarray:
        """For each machine word and n-gram the bitmask of all languages that contain it."""
        first, *others = slots(g, self.table.shape[1])
        out = self.table[:, first]
        for at in others:
            out = out & self.table[:, at]
        return out

    def counts(self, masks: np.ndarray) -> np.ndarray:
        """n-grams of each language."""
        kind, bits = self.table.dtype.type, self.table.dtype.itemsize * 8
        return np.array([np.count_nonzero(masks[k // bits] & kind(1 << k % bits)) for k in range(len(self.languages))], float)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        masks = self.masks(grams(text))
        true = np.clip((self.counts(masks) - masks.shape[1] * self.false_rate) / (1 - self.false_rate), 0, None)
        best = int(true.argmax())
        total = float(true.sum())
        return self.languages[best], float(true[best] / total) if total else 0.0


def texts_of(batches):
    rows = (tuple(b[i][k] for i in range(b.num_columns)) for b in batches for k in range(b.num_rows))
    for held in in_batches(rows, lambda r: 64 + (r[-1].as_buffer().size if r[-1].is_valid else 0), TEXT_BYTES):
        yield [[x.as_py() for x in r[:-1]] for r in held], [r[-1].as_py() for r in held]


def learn(docs: DataFrame, text: str, lang: str, id_col: str, max_rows: int, max_grams: int) -> Filters:
    """Filters of the labelled rows that are not held out, at most max_rows of each language."""
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("i"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    known = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").collect()
    languages = [r.lang for r in known]
    # by its count a language has a bound on the hash below which more than max_rows of its rows lie, and few more
    bound = labelled.sparkSession.createDataFrame([(r.lang, min(1.0, (max_rows + 8 * max_rows**0.5 + 64) / r.n)) for r in known], "lang string, part double")
    place = F.pmod(F.xxhash64("i"), F.lit(1 << 32)) / float(1 << 32)
    least = Window.partitionBy("lang").orderBy("place", "i")
    near = labelled.select("i", "lang", place.alias("place")).join(F.broadcast(bound), "lang").filter("place < part")
    chosen = near.withColumn("k", F.row_number().over(least)).filter(F.col("k") <= max_rows).select("i", "lang").distinct()
    chosen = F.broadcast(chosen) if max_rows * len(languages) <= MAX_BROADCAST else chosen
    sample = labelled.join(chosen, ["i", "lang"])

    def run(batches):
        for heads, texts in texts_of(batches):
            by: dict[str, list[np.ndarray]] = {}
            for (name,), t in zip(heads, texts, strict=True):
                by.setdefault(name, []).append(grams(t))
            for name, gs in by.items():
                g, n = np.unique(np.concatenate(gs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = checkpoint(sample.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    ranked = counts.withColumn("share", share).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).filter(F.col("k") <= max_grams)
    most = F.max("share").over(Window.partitionBy("gram"))
    kept = ranked.withColumn("most", most).filter(F.col("share") >= MIN_SHARE * F.col("most")).select("lang", "gram")
    rows = kept.groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("g")).collect()
    found = {r.lang: np.array(r.g, np.uint32) for r in rows}
    return Filters.of(languages, [found.get(x, np.zeros(0, np.uint32)) for x in languages])


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", *, max_rows: int = MAX_ROWS, max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row a row of docs: id_col, held_out, lang_pred, score (the language's share of all languages' n-grams).

    Learned from labelled rows that are not held out, of each language at most about max_rows, those of least hash of id,
    and of their n-grams at most max_grams. All languages are learned. A null text, one without a letter, and every text where no row
    could be learned from is `und` with score 0. Repeated rows stay apart; other columns are left out. No rows give no
    rows.
    """
    filters = learn(docs, text, lang, id_col, max_rows, max_grams)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("out"), F.col(text).alias("text"))

    def run(batches):
        for heads, texts in texts_of(batches):
            found = [filters.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in heads], pa.int64()), pa.array([h[1] for h in heads], pa.bool_()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    out = docs.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
