"""Awkward documents: nulls, empty and very long texts, ties, repeated rows, odd white space, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, part string, line string, words string"


def awkward(n=60, seed=1):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["Über", "naïve", "don't", "x,", "42", "3.14"]
    text = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    texts = [None, "", " ", "\n\n", "one", "One two", " a  b\tc d\x0b e \n\n f ", "<|endoftext|> x", "日本語 テキスト 🙂 ok", text(30_000)]
    texts += [text(r.randint(1, 400)) for _ in range(n)]
    texts += [texts[12], texts[12], texts[13] + " more", "same line\n" * 50, texts[14].upper(), texts[15].replace(" ", "\n", 5)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), None, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)
