"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters are lexicons (seed words by kind of insult; words, and word beginnings, that go with label 1 in labelled rows, by
how strongly) and patterns (an address by `you`, exclamation marks, long texts without a hit); each votes
1, -1 or abstains. The annotators' label is one voter more, of a given reliability. The label model estimates by
expectation maximisation that begins with the annotators' labels, how often each votes which way in either class, and which voters agree beyond what the class explains: of these pairwise terms it keeps the strongest that form a forest (Chow and Liu's
tree within the classes), and a voter with a parent is judged given its parent's vote, so that an echo counts as little as
it adds. A logistic model is then fitted to the posteriors and alone scores every text.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import in_batches, stored

#: Labelled rows that are learned from: those of least hash of id, so many at most.
MAX_LABELLED = 30_000
#: Mined patterns kept by default, those of most evidence; of a pattern, the labelled rows with label 1 and the log odds it needs;
#: of r rows with label 1 it needs ROWS_BY_ROOT * r**0.5 at least, as more rows bring more words that go with the label by chance.
MAX_PATTERNS, MIN_ROWS, MIN_ODDS = 4000, 4, 2.0
ROWS_BY_ROOT = 0.5
#: Lengths of word beginnings.
PREFIXES = (4, 5, 6, 7)
#: Log odds from which on a mined word or beginning belongs to a lexicon of words that go with label 1 weakly, clearly, strongly.
TIERS = {"weakly": MIN_ODDS, "clearly": 3.0, "strongly": 4.0}
#: Information (nats a row) that two voters share beyond the class for their pairwise term to be kept, and what twice the
#: log-likelihood must gain at least.
MIN_INFORMATION, MIN_GAIN = 0.01, 30.0
#: How often the annotators' label is right, held against the votes as firmly as these weigh.
ANCHOR = 0.98
#: Labelled rows that are broadcast to find their texts; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
THRESHOLD = 0.3
SEEDS = {
    "mind": "idiot idiots moron morons stupid dumb fool imbecile cretin halfwit dimwit brainless clueless",
    "worth": "worthless trash garbage scum pathetic disgusting loser losers filth vermin parasite lowlife useless",
    "mockery": "clown clowns joke laughingstock ridiculous creep freak pig ugly",
    "hostility": "hate kill die hurt destroy shut burn choke despise",
    "obscenity": "damn crap hell bastard bitch ass arse shit fuck",
}
PATTERNS = ["insulted", "shouting", "long_clean"]
WORDS = re.compile(r"[^\W\d_]+")
YOU = frozenset("you your u ur tu vous toi du dich ihr usted vosotros".split())
TEXT_BYTES = 1 << 20


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def patterns_of(words: set[str]) -> set[str]:
    """Whole words, and their beginnings marked by a hyphen."""
    return words | {w[:k] + "-" for w in words for k in PREFIXES if len(w) > k}


@dataclass
class Voters:
    mined: dict[str, int] = field(default_factory=dict)
    odds: list[float] = field(default_factory=list)
    seeds: list[frozenset[str]] = field(default_factory=lambda: [frozenset(s.split()) for s in SEEDS.values()])

    def __post_init__(self):
        tier = lambda x: sum(x >= t for t in TIERS.values()) - 1
        self.group = [max(0, tier(x)) + len(TIERS) * p.endswith("-") for p, x in zip(self.mined, self.odds, strict=True)]
        self.names = [*SEEDS, *(f"words_{t}" for t in TIERS), *(f"beginnings_{t}" for t in TIERS), *PATTERNS]
        self.known: dict[str, tuple[int, ...]] = {}

    def hits(self, word: str) -> tuple[int, ...]:
        """The mined patterns of a word, kept for words seen."""
        if (out := self.known.get(word)) is None:
            out = tuple(self.mined[p] for p in patterns_of({word}) if p in self.mined)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = out
        return out

    def read(self, text: str) -> tuple[np.ndarray, list[int], int]:
        """(votes, mined patterns hit, words hit) of a whole text."""
        low = text.lower()
        all_words = WORDS.findall(low)
        words = set(all_words)
        found = [self.hits(w) for w in words]
        n_hit = sum(1 for h in found if h)
        hit = sorted({k for h in found for k in h})
        votes = np.zeros(len(self.names), np.int8)
        seeded = 0
        for k, s in enumerate(self.seeds):
            n = len(s & words)
            seeded += n
            votes[k] = n > 0
        base = len(self.seeds)
        for k in hit:
            votes[base + self.group[k]] = 1
        insulted, shouting, long_clean = range(len(self.names) - len(PATTERNS), len(self.names))
        strong = max(n_hit, seeded)
        votes[insulted] = 1 if strong and words & YOU else 0
        votes[shouting] = 1 if text.count("!") >= 3 and strong else 0
        votes[long_clean] = -1 if len(all_words) >= 100 and strong * 200 < len(all_words) else 0
        return votes, hit, n_hit


def forest(joint: np.ndarray, n: int, min_gain: float, alone: list[int]) -> list[int]:
    """Each voter's parent, -1 for roots, in the maximum spanning forest of conditional mutual information.

    joint: (class, voter, vote, voter, vote) shares of n rows; edges must gain min_gain in twice the log-likelihood;
    those `alone` have none.
    """
    m = joint.shape[1]
    own = np.einsum("ciaib->cia", joint)
    expected = own[:, :, :, None, None] * own[:, None, None] / joint.sum(axis=(2, 4))[:, :, None, :, None]
    gain = 2 * n * np.where(joint > 0, joint * np.log(joint / np.maximum(expected, 1e-300), where=joint > 0, out=np.zeros_like(joint)), 0).sum(axis=(0, 2, 4))
    gain[alone], gain[:, alone] = 0, 0
    edges = sorted(((gain[i, j], i, j) for i in range(m) for j in range(i + 1, m) if gain[i, j] >= min_gain), reverse=True)
    tree, near = list(range(m)), [[] for _ in range(m)]
    for _, i, j in edges:
        if tree[i] != tree[j]:
            old, new = tree[i], tree[j]
            tree = [new if t == old else t for t in tree]
            near[i].append(j)
            near[j].append(i)
    parent, seen = [-1] * m, set()
    for root in range(m):
        todo = [] if root in seen else [root]
        seen.add(root)
        while todo:
            i = todo.pop()
            for j in near[i]:
                if j not in seen:
                    parent[j] = i
                    seen.add(j)
                    todo.append(j)
    return parent


def label_model(votes: np.ndarray, start: np.ndarray | None = None, anchor: float | None = None, prior: float = 0.15, rounds: int = 80, min_information: float = MIN_INFORMATION) -> tuple[np.ndarray, dict]:
    """Posteriors of label 1 for rows of votes (-1, 0, 1), and what was estimated: prior, rates (class, voter, vote),
    parent of each voter in the forest of pairwise terms, accuracy of each voter where it votes. anchor: how often the
    last voter is right, if it is known rather than estimated. start: posteriors to begin with; by default what most voters say, those that go together sharing their say."""
    n, m = votes.shape
    one = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    flat = one.reshape(n, 3 * m)
    if start is None:
        value = votes - votes.mean(axis=0)
        value /= np.maximum(value.std(axis=0), 1e-9)
        say = 1 / np.maximum((np.clip(value.T @ value / n, 0, 1) ** 2).sum(axis=1), 1)
        start = prior + 0.3 * np.sign(votes @ say)
    post = np.clip(start, 0.02, 0.98)
    parent, least = [-1] * m, np.array([0.5, 1.0, 0.5])
    firm = [] if anchor is None else [m - 1]
    for step in range(rounds):
        weights = np.stack([1 - post, post])
        prior = float(np.clip(post.mean(), 0.01, 0.6))
        rates = (weights @ flat).reshape(2, m, 3) + least
        rates /= rates.sum(axis=2, keepdims=True)
        rates[:, firm] = [[[anchor, 1e-9, 1 - anchor]], [[1 - anchor, 1e-9, anchor]]] if firm else rates[:, firm]
        if step in (0, 10, 25, 45):
            parent = forest(np.stack([(flat.T @ (w[:, None] * flat)).reshape(m, 3, m, 3) for w in weights]) / n, n, max(MIN_GAIN, 2 * n * min_information), firm)
        evidence = np.full(n, math.log(prior / (1 - prior)))
        for i, p in enumerate(parent):
            if p < 0:
                evidence += one[:, i] @ np.log(rates[1, i] / rates[0, i])
                continue
            pairs = np.stack([one[:, p].T @ (w[:, None] * one[:, i]) for w in weights]) + 2 * rates[:, None, i]
            pairs /= pairs.sum(axis=2, keepdims=True)  # (class, parent's vote, vote)
            evidence += np.log(pairs[1] / pairs[0])[votes[:, p] + 1, votes[:, i] + 1]
        new = 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))
        done, post = np.abs(new - post).max() < 1e-5 and step > 50, new
        if done:
            break
    right, wrong = prior * rates[1, :, 2] + (1 - prior) * rates[0, :, 0], prior * rates[1, :, 0] + (1 - prior) * rates[0, :, 2]
    return post, {"prior": prior, "rates": rates, "parent": parent, "accuracy": right / (right + wrong)}


def fit_logistic(rows: list[list[int]], values: list[list[float]], target: np.ndarray, size: int, l2: float = 2.0, rounds: int = 300) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic model of sparse rows by gradient descent with adaptive steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.fromiter((k for r in rows for k in r), np.int64)
    value = np.fromiter((v for r in values for v in r), float)
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    w[-1] = math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for _ in range(rounds):
        z = np.bincount(at, value * w[column], len(rows)) + w[-1]
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.append(np.bincount(column, value * gap[at], size) + l2 * w[:-1], gap.sum())
        seen += grad * grad
        w -= 0.5 * grad / np.sqrt(seen)
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    label_model: dict

    def features(self, votes: np.ndarray, hit: list[int], n_hit: int) -> tuple[list[int], list[float]]:
        m = len(self.voters.names)
        on = np.flatnonzero(votes).tolist()
        return [2 * k + (votes[k] < 0) for k in on] + [2 * m, *(2 * m + 1 + k for k in hit)], [1.0] * len(on) + [math.log1p(n_hit)] + [1.0] * len(hit)

    def score(self, text: str | None) -> float:
        columns, values = self.features(*self.voters.read(text or ""))
        z = float(np.dot(self.weights[columns], values) + self.weights[-1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def texts_of(batches):
    rows = (tuple(b[i][k] for i in range(b.num_columns)) for b in batches for k in range(b.num_rows))
    for held in in_batches(rows, lambda r: 64 + (r[-1].as_buffer().size if r[-1].is_valid else 0), TEXT_BYTES):
        yield [[x.as_py() for x in r[:-1]] for r in held], [r[-1].as_py() or "" for r in held]


def mine(sample: DataFrame, max_patterns: int = MAX_PATTERNS) -> Voters:
    """The patterns of sample (y, text) that go with label 1."""

    def run(batches):
        for heads, texts in texts_of(batches):
            counts: dict[str, list[int]] = {}
            for (y,), text in zip(heads, texts, strict=True):
                for p in patterns_of(set(WORDS.findall(text.lower()))):
                    counts.setdefault(p, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(counts), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["pattern", "n0", "n1"])

    total = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = total.get(0, 0) + 1, total.get(1, 0) + 1
    counts = sample.select("y", "text").mapInArrow(run, "pattern string, n0 long, n1 long").groupBy("pattern").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    odds = F.log((F.col("n1") + 0.5) / n1) - F.log((F.col("n0") + 0.5) / n0)
    best = counts.filter(F.col("n1") >= max(MIN_ROWS, ROWS_BY_ROOT * n1**0.5)).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
    best = best.orderBy((F.col("odds") * F.sqrt("n1")).desc(), "pattern").limit(max_patterns).collect()
    return Voters({r.pattern: k for k, r in enumerate(best)}, [r.odds for r in best])


def fit(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str, max_labelled: int = MAX_LABELLED, max_patterns: int = MAX_PATTERNS) -> Model:
    """A model of labelled rows that are not held out, of at most max_labelled of them."""
    labels = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out("i"))
    labels = labels.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("high")).filter("y = high").drop("high")
    labels = labels.orderBy(F.xxhash64("i"), "i").limit(max_labelled)
    # the texts stay where they are: the chosen labels, max_labelled at most, go to them
    labels = F.broadcast(labels) if max_labelled <= MAX_BROADCAST else labels
    sample = stored(docs.select(F.col(id_col).alias("i"), F.col(text).alias("text")).join(labels, "i").select("y", "text"))
    voters = mine(sample, max_patterns)

    def run(batches):
        for heads, texts in texts_of(batches):
            read = [voters.read(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in heads], pa.int32()), pa.array([r[0].tolist() for r in read], pa.list_(pa.int32())), pa.array([r[1] for r in read], pa.list_(pa.int32())), pa.array([r[2] for r in read], pa.int32())], ["y", "votes", "hit", "n_hit"])

    rows = sorted((r.y, r.votes, r.hit, r.n_hit) for r in sample.mapInArrow(run, "y int, votes array<int>, hit array<int>, n_hit int").collect())
    model = Model(voters, np.zeros(2 * len(voters.names) + 2 + len(voters.mined)), {})
    if not rows:
        model.weights[-1] = -3.0
        return model
    votes = np.array([[*r[1], 2 * r[0] - 1] for r in rows], np.int8)
    posterior, model.label_model = label_model(votes, start=np.where(votes[:, -1] > 0, 0.9, 0.05), anchor=ANCHOR)
    pairs = [model.features(np.array(r[1], np.int8), r[2], r[3]) for r in rows]
    model.weights = fit_logistic([p[0] for p in pairs], [p[1] for p in pairs], posterior, len(model.weights) - 1)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic", *, max_labelled: int = MAX_LABELLED, max_patterns: int = MAX_PATTERNS, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of docs: id_col, held_out, score, predicted.

    Null and empty texts are scored like any other, by the votes of an empty text. Without usable labels the score is
    the same low number for all texts. Labels other than 0 and 1 are not used, nor those of an id that has both; equal
    ones of an id count once, rows repeating an id each with its own text. Of the labels max_labelled at most are learned
    from, of the patterns mined in their texts max_patterns. Other columns are left out. No rows give no rows.
    """
    model = fit(docs, labels, text, id_col, label, max_labelled, max_patterns)
    docs = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("out"), F.col(text).alias("text"))

    def run(batches):
        for heads, texts in texts_of(batches):
            scores = [model.score(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in heads], pa.int64()), pa.array([h[1] for h in heads], pa.bool_()), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    out = docs.select(F.col("id").cast("long").alias("id"), "out", "text").mapInArrow(run, "id long, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
