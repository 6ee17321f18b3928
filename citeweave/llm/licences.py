"""License scans: phrases, and an exact set-similarity join of windows of words with license templates.

The join finds every window of a document's words whose token set holds the threshold's share of a template's; windows
run on over line ends, so a wrapped notice is found. Template tokens are ordered by how many documents of the corpus
hold them, rarest first, so that a template's prefix (as many tokens as may be missing, and one more) is its rarest part:
a window that holds no prefix token cannot qualify, and only words near one are looked at.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import in_batches

#: Phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License templates and the labels that their blocks get.
TEMPLATES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0",
    "this work is licensed under a creative commons attribution international license": "cc-by",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
THRESHOLD = 0.8
#: A window holds so many times a template's words, or within one line BLOCK words. The SQL cuts lines every STRIDE words.
TIMES, BLOCK, STRIDE = 2, 64, 32
TEXT_BYTES = 1 << 20

_word_bytes = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 10 if c == 10 else 32 for c in range(256))


def texts_of(batches):
    rows = ((b["id"][i].as_py(), b["text"][i]) for b in batches for i in range(b.num_rows))
    for held in in_batches(rows, lambda r: 64 + (r[1].as_buffer().size if r[1].is_valid else 0), TEXT_BYTES):
        for id_, text in held:
            yield id_, text.as_buffer().to_pybytes().translate(_word_bytes) if text.is_valid else b""


class Join:
    """The templates by prefix token."""

    def __init__(self, templates: dict[str, str], many: dict[bytes, int], threshold: float):
        self.sets = [(frozenset(t.encode().split()), label) for t, label in templates.items()]
        self.need = [-(-len(s) * round(threshold * 1000) // 1000) for s, _ in self.sets]
        self.width = [TIMES * len(t.split()) for t in templates]
        self.prefix: dict[bytes, list[int]] = {}
        for k, (s, _) in enumerate(self.sets):
            for w in sorted(s, key=lambda w: (many.get(w, 0), w))[: len(s) - self.need[k] + 1]:
                self.prefix.setdefault(w, []).append(k)

    def near(self, words: list[bytes]) -> dict[int, list[int]]:
        """By template, the places of its words within a window's reach of its prefix tokens, where these are enough."""
        hits: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            for k in self.prefix.get(w, ()):
                hits.setdefault(k, []).append(i)
        out = {}
        for k, at in hits.items():
            s, reach, places, done = self.sets[k][0], max(BLOCK, self.width[k]), [], 0
            for h in at:
                to = min(len(words), h + reach)
                places += [i for i in range(max(done, h - reach + 1), to) if words[i] in s]
                done = to
            if len({words[i] for i in places}) >= self.need[k]:
                out[k] = places
        return out

    def spans(self, k: int, words: list[bytes], places: list[int], line_end: list[int]) -> list[tuple[int, int, int]]:
        """(tokens shared, first, last word) of the template's windows that qualify; of those that overlap the best, shortest."""
        found = []
        for j, a in enumerate(places):
            stop, seen, last = max(a + self.width[k], min(line_end[a], a + BLOCK)), set(), a
            for j in range(j, len(places)):
                if places[j] >= stop:
                    break
                if words[places[j]] not in seen:
                    seen.add(words[places[j]])
                    last = places[j]
            if len(seen) >= self.need[k]:
                found.append((-len(seen), last - a, a))
        out, used = [], set()
        for shared, more, a in sorted(found):
            if used.isdisjoint(range(a, a + more + 1)):
                used.update(range(a, a + more + 1))
                out.append((-shared, a, a + more))
        return out

    def matches(self, raw: bytes, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(line, template, containment) of all matches, in the text's order. A match is left out only where a better one
        (most tokens shared, then the larger share, then the templates' order) holds all of its words."""
        near = self.near(words)
        if not near:
            return []
        line_of, line_end = [], []
        for number, line in enumerate(raw.split(b"\n")):
            n = len(line.split())
            line_of += [number] * n
            line_end += [len(line_end) + n] * n
        found = []
        for k, places in near.items():
            s = self.sets[k][0]
            for shared, a, b in self.spans(k, words, places, line_end):
                found.append((-shared, -shared / len(s), k, a, frozenset(i for i in range(a, b + 1) if words[i] in s)))
        kept, by_word = [], {}
        for _, share, k, a, own in sorted(found, key=lambda x: x[:4]):
            if not any(own <= x for x in by_word.get(a, ())):
                kept.append((a, line_of[a], k, -share))
                for i in own:
                    by_word.setdefault(i, []).append(own)
        return [x[1:] for x in sorted(kept)]


def token_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of the templates, over all documents; as many counts as template words."""

    def run(batches):
        many = dict.fromkeys(vocabulary, 0)
        for _, text in texts_of(batches):
            for w in vocabulary.intersection(text.split()):
                many[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in many]), pa.array(many.values(), pa.int64())], ["word", "many"])

    return {r.word.encode(): r.many for r in docs.mapInArrow(run, "word string, many long").groupBy("word").agg(F.sum("many").alias("many")).collect()}


def scan_licences(docs: DataFrame, text: str = "text", id_col: str = "doc_id", *, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row of docs: id_col, n_words, places (label, first word of each phrase), base_labels, blocks (line, label, containment), labels, score.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A block is a window of
    twice a template's words, over line ends too, or of 64 words within a line; line is that of its first word. score is the best block's containment, 1 for a phrase, 0 without either. Null
    and empty texts have no words and nothing else. Repeated rows stay apart; other columns are left out. No rows give
    no rows.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    vocabulary = frozenset(w for t in templates for w in t.encode().split())
    join = Join(templates, token_counts(docs.select(F.lit(0).alias("id"), "text"), vocabulary), threshold)
    needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def run(batches):
        columns: list[list] = [[], [], [], [], [], []]

        def flush():
            types = [kind, pa.int64(), place_type, pa.list_(pa.string()), block_type, pa.float64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "n_words", "places", "base", "blocks", "score"])
            for c in columns:
                c.clear()
            return out

        place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        block_type = pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
        for id_, raw in texts_of(batches):
            words = raw.split()
            line = b" " + b" ".join(words) + b" "
            places = []
            for needle, label in needles:
                at = line.find(needle)
                while at >= 0:
                    places.append({"label": label, "word": line.count(b" ", 0, at)})
                    at = line.find(needle, at + 1)
            found = [{"line": number, "label": join.sets[k][1], "containment": share} for number, k, share in join.matches(raw, words)]
            score = max([b["containment"] for b in found] + [1.0] * bool(places), default=0.0)
            for c, x in zip(columns, (id_, len(words), places, sorted({p["label"] for p in places}), found, score), strict=True):
                c.append(x)
            if len(columns[0]) >= 2000:
                yield flush()
        yield flush()

    kind = pa.int64()
    out = docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, n_words long, places array<struct<label:string,word:long>>, base array<string>, blocks array<struct<line:long,label:string,containment:double>>, score double")
    labels = F.array_sort(F.array_union("base", F.transform("blocks", lambda b: b["label"])))
    return out.select(F.col("id").alias(id_col), "n_words", "places", F.array_join("base", ",").alias("base_labels"), "blocks", F.array_join(labels, ",").alias("labels"), "score")
