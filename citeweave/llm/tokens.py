"""Token ids of whole texts by a public byte-level tokenizer, fast enough for every text of a corpus.

Byte-level pre-tokenization never lets a token reach over a single space or line end between two other characters, so a
text may be cut there and the ids of the pieces laid end to end. Each distinct piece is encoded once a worker by the
tokenizers library, many pieces as one text; the ids of all pieces seen are kept as bytes, up to a bound.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import accumulate, pairwise

TOKENIZER = "byte_bpe_50k.json"
#: Distinct pieces kept in a worker, about 130 bytes each; beyond it all are forgotten and learned anew.
MAX_KEPT = 1_500_000
BORDER = re.compile(r"(?<=\S)(?= \S)")
#: Letters with marks behind them are two pre-tokens whatever the letters; an apostrophe might begin a contraction.
TAIL = re.compile(r"(\n?[^\W\d_]+)([.,;:!?*%$&#|]+)")
#: Pieces encoded as one text.
RUN = 2_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_byte_level(form: dict) -> bool:
    """Whether a tokenizer's description (its JSON) says that tokens, end to end, are the text's bytes."""
    pre = form.get("pre_tokenizer") or {}
    return form.get("normalizer") is None and form.get("post_processor") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and form["model"].get("type") == "BPE" and not form["model"].get("end_of_word_suffix")


class Encoder:
    """encode(texts): the ids of each text as little-endian unsigned 16-bit numbers, 32-bit ones for larger vocabularies.

    Texts are cut at spaces only if the tokenizer's own description says that it is byte-level with the usual
    pre-tokenization; others encode whole texts.
    """

    def __init__(self, path: str, max_kept: int = MAX_KEPT):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        self.byte_level = is_byte_level(form)
        self.cuts = self.byte_level and bool(form["pre_tokenizer"].get("use_regex"))
        self.tokenizer.encode_special_tokens = True
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.max_kept = max_kept
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False) if self.cuts else {}
        #: Tokens that begin with a space or a line end, as the byte-level alphabet writes them.
        self.front = frozenset(i for t, i in vocabulary.items() if t[0] in "\u0120\u010a")
        #: By what stands after a space, or by a line end and what stands after it; None if a border cannot be trusted.
        self.pieces: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}

    def exact(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def run_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, encoded as one text and cut before each token that begins with white space: a piece
        holds neither a space nor a line end but the one at its front, which starts a token."""
        text = "".join([p if p[0] == "\n" else " " + p for p in pieces])
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        front, data = self.front, array(self.code, ids).tobytes()
        at = [k * self.width for k, i in enumerate(ids) if i in front]
        if len(at) != len(pieces):
            raise ValueError("a tokenizer that joins white space with what stands before it")
        at.append(len(data))
        return [data[a:b] for a, b in pairwise(at)]

    def learn(self, parts: set[str]) -> None:
        known, alone, tails, split = self.pieces, set(), set(), []
        for p in parts:
            word = p[1:] if p[:1] == "\n" else p
            if word.isalpha():
                alone.add(p)
            elif not word or word[0].isspace() or word[-1].isspace():
                known[p] = None
            elif (m := TAIL.fullmatch(p)) and m[1].lstrip("\n").isalpha():
                split.append((p, m[1], m[2]))
                tails.add(m[2])
                if m[1] not in known:
                    alone.add(m[1])
            else:
                alone.add(p)
        listed = list(alone)
        for k in range(0, len(listed), RUN):
            some = listed[k : k + RUN]
            known.update(zip(some, self.run_of(some), strict=True))
        new = [t for t in tails if t not in self.tails]
        self.tails.update(zip(new, self.exact(new), strict=True))
        for p, word, tail in split:
            known[p] = known[word] + self.tails[tail]

    def ends(self, texts: list[str]) -> list[list[int]]:
        """For a tokenizer of another kind, the character behind each token; what it drops goes with the token after it."""
        return [list(accumulate((b for _, b in e.offsets), max)) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.exact(texts)
        if len(self.pieces) > self.max_kept:
            self.pieces.clear()
            self.tails.clear()
        known, rows, new = self.pieces, [], set()
        for text in texts:
            # as if a line end stood before the text: its id is taken off again
            parts = text.replace("\n", " \n").split(" ")
            parts[0] = "\n" + parts[0]
            new.update(set(parts).difference(known))
            rows.append(parts)
        if new:
            self.learn(new)
        out, get = [], known.__getitem__
        for text, parts in zip(texts, rows, strict=True):
            found = list(map(get, parts))
            if None in found:
                # a run of white space somewhere: cut only where both sides are other characters
                out.append(b"".join(self.exact(BORDER.split(text))))
            else:
                found[0] = found[0][self.width :]
                out.append(b"".join(found))
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
