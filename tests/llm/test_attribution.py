import random
from collections import Counter, defaultdict

import pytest

from citeweave.llm.attribution import RULES, attribute_tokens, lines
from citeweave.llm.tokens import Encoder, encoder, tokenizer_path
from tests.llm.fixtures import awkward, frame


def thirds(text):
    """Sections of a name each, with a gap between them."""
    n = len(text)
    return [("a", 0, n // 3), ("b", n // 3, n // 2)] + ([("c", n // 2 + 1, n)] if n // 2 + 1 < n else []) if n >= 3 else []


def brute(text, spans, sizes, rule):
    """Tokens by section, told place by place; places are of spans, sizes the places of each token."""
    owner = [next((k for k, (a, b) in enumerate(spans) if a <= i < b), None) for i in range(text)]
    want, at = Counter(), 0
    for n in sizes:
        own = owner[at : at + n]
        at += n
        want[own[0] if rule == "first" else own[-1] if rule == "last" else max(own, key=lambda s: (own.count(s), -own.index(s)))] += 1
    return dict(want)


@pytest.mark.parametrize("sections", [lines, thirds])
@pytest.mark.parametrize("rule", RULES)
def test_against_tokens_byte_by_byte(spark, rule, sections):
    """Emoji, other characters of several bytes that tokens cut, and long texts included."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    rows = [*awkward(20), (900, "🙂🙂\n日本🙂語 naïve\n\n🇩🇪 x" * 40, "en", "s", None, "", "", "", "")]
    got = defaultdict(dict)
    for r in attribute_tokens(frame(spark, rows), sections=sections, rule=rule).collect():
        got[r.doc_id][r.section] = (r.n_tokens, r.doc_tokens)
    for row in rows:
        text = row[1] or ""
        spans = sections(text)
        sizes = [len(t.id_to_token(i)) for i in t.encode(text, add_special_tokens=False).ids]
        assert sum(sizes) == len(text.encode())
        byte = lambda i, text=text: len(text[:i].encode())
        if len(text) < 20_000:
            want = brute(len(text.encode()), [(byte(a), byte(b)) for _, a, b in spans], sizes, rule)
            assert {k: n for k, (n, _) in got[row[0]].items() if n} == want, text[:80]
        assert {d for _, d in got[row[0]].values()} == {len(sizes)}
        assert sum(n for n, _ in got[row[0]].values()) == len(sizes)
        assert {k for k in got[row[0]] if k is not None} == set(range(len(spans)))


def test_a_tokenizer_that_is_not_byte_level(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    assert encoder(tokenizer_path()).cuts and not encoder(path).byte_level
    text = "A heading\nTwo words  here.\n\nMore"
    got = {r.section: r.n_tokens for r in attribute_tokens(frame(spark, [(1, text, "en", "s", None, "", "", "", "")]), path=path).collect()}
    ends = [b for _, b in t.encode(text, add_special_tokens=False).offsets]
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert {k: n for k, n in got.items() if n} == brute(len(text), [(a, b) for _, a, b in lines(text)], sizes, "most")


def test_no_rows(spark):
    assert attribute_tokens(frame(spark, [])).collect() == []


def test_encoder_is_the_library_whatever_stands_between_words():
    pieces = ["a", "É", "中", "1", "²", " ", "  ", "\n", "\n\n", "\t", "\r\n", "'s", "...", "!?", "<|endoftext|>", " ", "_", "́", "word", "\x1c", "\x85"]
    draw = random.Random(7)
    texts = ["", " ", "\n"] + ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(3000)]
    e = Encoder(tokenizer_path(), max_kept=1000)
    assert [x for k in range(0, len(texts), 500) for x in e.encode(texts[k : k + 500])] == e.exact(texts)
