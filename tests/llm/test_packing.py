from collections import Counter, defaultdict

import numpy as np
import pytest

from citeweave.llm.packing import END, Robin, pack
from citeweave.llm.tokens import tokenizer_path
from tests.llm.fixtures import awkward, frame


@pytest.fixture(scope="module")
def exact():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, END]


@pytest.mark.parametrize("parts", [1, 5])
def test_every_token_is_packed_once_and_sequences_are_full(spark, exact, parts):
    rows = awkward()
    got = pack(frame(spark).repartition(parts), length=256, window=4).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in got:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        by_doc[p.doc_id].append((p.start, ids, p.doc_tokens))
        by_seq[p.sequence_id].append((p.offset, p.length))
    for r in rows:
        pieces = sorted(by_doc.pop(r[0]))
        assert sum((x[1] for x in pieces), []) == exact(r[1])
        assert [x[0] for x in pieces] == [sum(len(y[1]) for y in pieces[:k]) for k in range(len(pieces))]
        assert {x[2] for x in pieces} == {len(exact(r[1]))}
    assert not by_doc
    sizes = []
    for k in sorted(by_seq):
        at = 0
        for offset, n in sorted(by_seq[k]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert set(sizes[:-1]) <= {256} and sizes[-1] <= 256


def test_windows_hold_the_mixture():
    docs = [("a", 70)] * 300 + [("b", 130)] * 80 + [("c", 1000)] * 5
    total = Counter()
    for s, n in docs:
        total[s] += n
    n = sum(total.values())
    robin = Robin([{"source": s, "before": 0, "share": total[s] / n} for s in total], 256, 8)
    window = defaultdict(Counter)
    for k, _, m, seq, _ in robin.pieces(docs):
        window[seq // 8][docs[k][0]] += m
    for k in sorted(window)[:-1]:
        for s in total:
            assert abs(window[k][s] - total[s] / n * 2048) <= 3


def test_windows_of_sorted_partitions_hold_the_mixture(spark):
    rows = [(i, "w " * 300, "en", "s0" if i < 40 else "s1" if i < 60 else None, None, "", "", "", "") for i in range(80)]
    got = pack(frame(spark, rows).repartitionByRange(4, "doc_id"), length=128, window=4).collect()
    total, window = Counter(), defaultdict(Counter)
    for p in got:
        total[p.source] += p.length
        window[p.sequence_id // 4][p.source] += p.length
    n = sum(total.values())
    assert len(window) > 20
    for k in sorted(window)[:-1]:
        assert sum(window[k].values()) == 512
        for s in total:
            assert abs(window[k][s] - total[s] / n * 512) <= 3


def test_no_rows(spark):
    assert pack(frame(spark, [])).collect() == []
