"""Token counts of a document's sections from one encoding of the whole document.

Tokens of a byte-level tokenizer, end to end, are the text's bytes, so the ids' byte lengths give every token's place.
These spans and the sections' are merged in order, as both are sorted and neither overlaps itself. A token that lies in
one section counts there. One over a boundary counts, by the rule chosen, for the section with most of its bytes (the
earlier of equals), its first byte's or its last's. For tokenizers that are not byte-level the library's own character
offsets take the place of bytes. Bytes outside of all sections are section null, and count like any
other section's, so that a document's counts always sum to its tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeweave.llm.common import in_batches
from citeweave.llm.tokens import encoder, tokenizer_path

RULES = ("most", "first", "last")
TEXT_BYTES = 4 << 20
Sections = Callable[[str], list[tuple[str, int, int]]]


def lines(text: str) -> list[tuple[str, int, int]]:
    """Each line with its line end as a section (kind, first character, character behind): blank, heading for a first
    line of at most 80 characters that others follow, else text."""
    out, at = [], 0
    pieces = text.split("\n")
    for k, piece in enumerate(pieces):
        stop = min(at + len(piece) + 1, len(text))
        if stop > at:
            out.append(("blank" if not piece.strip() else "heading" if k == 0 and len(piece) <= 80 and len(pieces) > 1 else "text", at, stop))
        at = stop
    return out


def allocate(ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary) for tokens that end at ends, one after another from 0, and
    sorted disjoint sections; -1 is outside."""
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends

    def holding(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(section or -1, number of boundaries at or before the place)."""
        k = np.searchsorted(starts, at, "right") - 1
        inside = (k >= 0) & (at < np.append(stops, 0)[k])
        return np.where(inside, k, -1), np.searchsorted(starts, at, "right") + np.searchsorted(stops, at, "right")

    (first, edge), (last, edge_last) = holding(begins), holding(ends - 1)
    crossing = (first != last) | (edge != edge_last)
    out = first.copy() if rule != "last" else last.copy()
    if rule == "most":
        cuts = np.unique(np.concatenate([starts, stops]))
        for t in np.flatnonzero(crossing).tolist():
            a, b = int(begins[t]), int(ends[t])
            inner = [a, *cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b, "left")].tolist(), b]
            share: dict[int, int] = {}
            for x, y in zip(inner[:-1], inner[1:], strict=True):
                s = int(holding(np.array([x]))[0][0])
                share[s] = share.get(s, 0) + y - x
            out[t] = max(share, key=share.get)  # dicts keep order: the earlier of equals
    return out, crossing


def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id; in a byte-level vocabulary every character of a token's name is one."""
    vocabulary = encoder(path).tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for name, k in vocabulary.items():
        out[k] = len(name)
    return out


def attribute_tokens(docs: DataFrame, text: str = "text", id_col: str = "doc_id", *, sections: Sections = lines, rule: str = "most", path: str | None = None) -> DataFrame:
    """One row a section of each row of docs: id_col, section (number from 0, null for what is outside of all), kind,
    start, stop (characters), n_tokens, n_crossing (of these, tokens over a boundary), doc_tokens.

    sections gives a text's sections as (kind, start, stop), sorted and disjoint. Outside has a row only where it has
    tokens; a null or empty text has one row of no section and no tokens. Repeated rows stay apart; other columns are left
    out. No rows give no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = path or tokenizer_path()
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches):
        enc = encoder(path)
        size = token_bytes(path) if enc.byte_level else None
        rows = ((b["id"][i].as_py(), b["text"][i]) for b in batches for i in range(b.num_rows))
        names = ["id", "section", "kind", "start", "stop", "n_tokens", "n_crossing", "doc_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        for held in in_batches(rows, lambda r: 100 + (r[1].as_buffer().size if r[1].is_valid else 0), TEXT_BYTES):
            texts = [r[1].as_py() or "" for r in held]
            out: list[list] = [[] for _ in names]
            for (id_, _), t, got in zip(held, texts, enc.encode(texts) if enc.byte_level else enc.ends(texts), strict=True):
                found = sections(t)
                starts, stops = (np.array([s[k] for s in found], np.int64) for k in (1, 2))
                if enc.byte_level:
                    ends = np.cumsum(size[np.frombuffer(got, f"<u{enc.width}")])
                    raw = np.frombuffer(t.encode(), np.uint8)
                    byte = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                    starts, stops = byte[starts], byte[stops]
                else:
                    ends = np.array(got, np.int64)
                where, crossing = allocate(ends, starts, stops, rule)
                n = np.bincount(where + 1, minlength=len(found) + 1).tolist()
                c = np.bincount(where[crossing] + 1, minlength=len(found) + 1).tolist()
                of = [(None, None, None, None, n[0], c[0])] if n[0] or not found else []
                of += [(k, *s, n[k + 1], c[k + 1]) for k, s in enumerate(found)]
                for row in of:
                    for column, x in zip(out, (id_, *row, len(ends)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    out = docs.mapInArrow(run, "id long, section long, kind string, start long, stop long, n_tokens long, n_crossing long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)
