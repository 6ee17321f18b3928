"""Mixture-controlled packing: deficit round-robin over source queues.

All documents' tokens form one stream, cut every `length` tokens into sequences. The stream is filled window by window:
each source owes its target share of the tokens up to the window's end; its deficit is that less what it has served so
far, over all earlier windows. Sources are served by deficit from their queues; a dry queue's deficit stays on the books
and the others fill the window.

A queue is a source's documents over all partitions, so every window has its mixture however the input is sorted. What
each window takes of each source follows from the sources' token totals alone and is planned first; a document's place
in its queue follows from token counts by partition and source. With both, each document is cut at its windows and
sequences where it lies: no partition waits for another and no tokens move. The pieces of a sequence lie in several
partitions. Only the stream's last sequence is short.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeweave.llm.common import checkpoint, in_batches
from citeweave.llm.tokens import encoder, tokenizer_path

LENGTH, END = 2048, 1
#: Sequences in a window, the unit whose mixture is held to the target.
WINDOW = 32
#: Token counts by partition and source that are broadcast; beyond it they are joined by a shuffle.
MAX_BROADCAST_COUNTS = 200_000
#: Bytes of text encoded at once.
TEXT_BYTES = 4 << 20


def token_table(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(part, id, source, n, ids) of docs (id, source, text): the ids, with the end id, as the encoder's bytes."""

    def run(batches):
        enc, part = encoder(path), TaskContext.get().partitionId()
        mark = end.to_bytes(enc.width, "little")
        rows = (row for b in batches for row in zip(b["id"], b["source"], b["text"], strict=True))
        for held in in_batches(rows, lambda r: 100 + (r[2].as_buffer().size if r[2].is_valid else 0), TEXT_BYTES):
            ids = [x + mark for x in enc.encode([r[2].as_py() or "" for r in held])]
            columns = [pa.array([part] * len(held), pa.int32()), pa.array([r[0].as_py() for r in held], pa.int64()), pa.array([r[1].as_py() for r in held], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) // enc.width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["part", "id", "source", "n", "ids"])

    return docs.mapInArrow(run, "part int, id long, source string, n long, ids binary")


def carried(tokens: DataFrame, targets: dict[str, float] | None) -> tuple[DataFrame, bool, list[tuple]]:
    """(part, carry: array of source, before), whether it is small, and (source, total, share) of each source. before:
    tokens of the source in earlier partitions; share: its part of the whole stream, or its weight in targets over
    their sum (0 if it has none)."""
    counts = checkpoint(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")))
    last = counts.agg(F.max("part")).first()[0] or 0
    every = counts.groupBy("source").agg(F.sum("n").alias("total")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
    own = counts.select(F.col("part").alias("p"), F.col("source").alias("s"), "n")
    every = every.join(own, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")), "left").select("part", "source", "total", F.coalesce("n", F.lit(0)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")
    every = checkpoint(every.select("part", F.struct("source", before.alias("before")).alias("x")))
    totals = [tuple(r) for r in counts.groupBy("source").agg(F.sum("n").alias("total")).collect()]
    whole = sum(n for _, n in totals)
    share = (lambda s, n: targets.get(s, 0) / sum(targets.values())) if targets else (lambda s, n: n / whole)
    return every.groupBy("part").agg(F.collect_list("x").alias("carry")), every.count() <= MAX_BROADCAST_COUNTS, [(s, n, share(s, n)) for s, n in totals]


class Robin:
    """The stream from one place on: what each source has served, and its share."""

    def __init__(self, carry: list[dict], length: int, window: int):
        self.served = {c["source"]: c["before"] for c in carry}
        self.share = {c["source"]: c["share"] for c in carry}
        self.at, self.length, self.window = sum(self.served.values()), length, length * window

    def takes(self, waiting: dict) -> list[tuple]:
        """(source, tokens) that fill the stream up to the next window's end, or to the last token that waits."""
        end = (self.at // self.window + 1) * self.window
        room = min(end - self.at, sum(waiting.values()))
        debts = sorted(((self.share[s] * end - self.served[s], s) for s, n in waiting.items() if n), key=lambda x: (-x[0], x[1] is None, x[1] or ""))
        taken: dict = {}
        for debt, s in debts:
            taken[s] = max(0, min(int(debt), waiting[s], room))
            room -= taken[s]
        for _, s in debts:  # others' queues are dry
            more = min(room, waiting[s] - taken[s])
            taken[s] += more
            room -= more
        return [(s, n) for s, n in taken.items() if n]

    def plan(self, waiting: dict) -> dict:
        """By source, (tokens of its queue before, places in the stream) of its runs when `waiting` tokens are served."""
        left, runs, done = dict(waiting), {s: ([], []) for s in waiting}, dict.fromkeys(waiting, 0)
        while any(left.values()):
            for s, n in self.takes(left):
                left[s] -= n
                self.served[s] += n
                starts, places = runs[s]
                if not starts or places[-1] + done[s] - starts[-1] != self.at:  # else the run before goes on
                    starts.append(done[s])
                    places.append(self.at)
                self.at, done[s] = self.at + n, done[s] + n
        return runs

    def pieces(self, docs: list[tuple]):
        """(number of the document, its tokens before, tokens, sequence, offset) for docs [(source, n)], in their order."""
        waiting: dict = {}
        for s, n in docs:
            waiting[s] = waiting.get(s, 0) + n
        runs, before = self.plan(waiting), dict.fromkeys(waiting, 0)
        for k, (s, n) in enumerate(docs):
            for piece in cut(*runs[s], before[s], n, self.length):
                yield k, *piece
            before[s] += n


def cut(starts, places, before: int, n: int, length: int):
    """(tokens before, tokens, sequence, offset) of the pieces of a document of n tokens, `before` tokens on in its queue."""
    at, run = 0, bisect_right(starts, before) - 1
    while at < n:
        if run + 1 < len(starts) and before + at >= starts[run + 1]:
            run += 1
        place = int(places[run]) + before + at - int(starts[run])
        m = min(n - at, length - place % length)
        if run + 1 < len(starts):
            m = min(m, int(starts[run + 1]) - before - at)
        yield at, m, place // length, place % length
        at += m


def pack(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", *,
    targets: dict[str, float] | None = None, length: int = LENGTH, window: int = WINDOW, end: int = END, path: str | None = None,
) -> DataFrame:
    """One row a piece: id_col, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, source.

    targets: weights of sources; by default each source's share of all tokens, so that all queues end together. Null
    texts are empty and give the end id alone; a null source is a source of its own; rows with one id stay apart and
    are each packed. Other columns are left out. An empty table gives an empty one.
    """
    path = path or tokenizer_path()
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    tokens = checkpoint(token_table(docs, path, end))
    carry, small, totals = carried(tokens, targets)
    placed = tokens.join(F.broadcast(carry) if small else carry, "part")
    robin = Robin([{"source": s, "before": 0, "share": share} for s, _, share in totals], length, window)
    plan = docs.sparkSession.sparkContext.broadcast({s: (array("q", a), array("q", b)) for s, (a, b) in robin.plan({s: n for s, n, _ in totals}).items()})

    def run(batches):
        import numpy as np

        enc, part, before, runs = encoder(path), None, {}, plan.value

        def pieces():
            nonlocal part, before
            for b in batches:
                for i in range(b.num_rows):
                    if b["part"][i].as_py() != part:
                        part, before = b["part"][i].as_py(), {c["source"]: c["before"] for c in b["carry"][i].as_py()}
                    id_, s, n = b["id"][i].as_py(), b["source"][i].as_py(), b["n"][i].as_py()
                    ids = np.frombuffer(b["ids"][i].as_py(), f"<u{enc.width}")
                    for at, m, sequence, offset in cut(*runs[s], before[s], n, length):
                        yield id_, at, m, n, sequence, offset, ids[at : at + m].astype("<u4").tobytes(), s
                    before[s] += n

        for few in in_batches(pieces(), lambda p: 4 * p[2] + 64, 8 << 20):
            *longs, ids, sources = zip(*few, strict=True)
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in longs], pa.array(ids, pa.binary()), pa.array(sources, pa.string())], ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "source"])

    out = placed.mapInArrow(run, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, source string")
    return out.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source")
