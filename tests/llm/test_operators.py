"""Operators against brute force on awkward rows, with extra columns, nulls, ties, long texts, and no rows at all."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from citeweave.llm import language, licences, line_frequency, near_dedup, repeated_phrases, templates, toxicity, url_rules
from citeweave.llm.hashing import word_hashes
from tests.llm.fixtures import awkward, frame


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def components(sets, percent=80):
    """Least id reachable over links of Jaccard percent or more."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def near_copies(n=60, seed=3):
    """Awkward rows and a group of copies with more and more words changed."""
    import random

    r = random.Random(seed)
    rows = awkward(30)
    base = [f"w{r.randint(0, 400)}" for _ in range(150)]
    for k in range(n):
        t = base.copy()
        for _ in range(k % 14):
            t[r.randrange(len(t))] = f"x{r.randint(0, 9999)}"
        rows.append((1000 + k, " ".join(t), "en", "s0", None, "", "", "", ""))
    return rows


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates(spark, shingle):
    rows = near_copies()
    sets = {}
    for r in rows:
        w = words(lower(r[1]))
        sets[r[0]] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    want = components(sets)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, rows).repartition(3), shingle=shingle).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("block", [1024, 7])
def test_the_rest_is_compared_across_classes(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = near_copies(40)
    sets = {r[0]: set(zip(w, w[1:])) if len(w := words(lower(r[1]))) > 1 else ({tuple(w)} if w else set()) for r in rows}
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=2).collect()
    assert {r.doc_id: r.component_id for r in got} == components(sets)


@pytest.mark.parametrize("hows", [[{}], [{"shard_places": 3}], [{"shard_places": 40}]])
def test_repeats(spark, hows, monkeypatch):
    if hows[0].get("shard_places") == 3:
        monkeypatch.setattr(repeated_phrases, "HOT_PART", 0)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = awkward(20)
    rows += [(500, "a b " + passage + " c d", "en", "s", None, "", "", "", ""), (501, "x " + passage.replace(" ", "\n", 9), "en", "s", None, "", "", "", ""), (502, "e " + " ".join(passage.split()[5:45]) + " f", "en", "s", None, "", "", "", "")]
    rows += [(None, "n " + passage, "en", None, None, "", "", "", "")] + [(600 + i, f"o{i} " + passage + f" u{i}", "en", "s", 1, "", "", "", "") for i in range(20)]
    rows += [(503, ("again and again " * 30), "en", "s", None, "", "", "", ""), (500, rows[12][1], "en", "s", None, "", "", "", "")]
    where = Counter()
    for r in rows:
        w = words(r[1])
        where.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for r in rows:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 34):
            if where[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        want.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    key = lambda x: (x[0] is None, *map(str, x))
    for how in hows:
        got = repeated_phrases.remove_repeats(frame(spark, rows).repartition(3), with_row=True, **how).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=key) == sorted(want, key=key)
        assert sorted((tuple(r.row) for r in got), key=key) == sorted(rows, key=key)


def test_near_duplicates_of_repeated_ids(spark):
    """Id 5 is once a copy of 1 and once one of 3: neither puts 3 and 1 together."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (1, a + " end"), (3, b + " end"), (7, a), (7, a), (None, a), (9, None), (9, "")]
    rows = [(i, t, "en", "s", None, "", "", "", "") for i, t in rows]
    got = near_dedup.near_duplicates(frame(spark, rows), with_key=True).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True), (3, 3, True), (5, 1, False), (5, 3, False), (7, 1, False), (7, 1, False), (9, 9, True), (9, 9, True)]
    assert [(r.component_id, r.kept, r.n_shingles) for r in got if r.doc_id is None] == [(None, None, 36)]
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_repeats_need_the_automata(spark, monkeypatch):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, f"a{i} {passage} b{i}", "en", "s", None, "", "", "", "") for i in range(3)]
    assert {r.n_removed for r in repeated_phrases.remove_repeats(frame(spark, rows)).collect()} == {60}
    hashes, first, *_ = word_hashes([b"a b c " * 20, b"", b"x y " * 40])
    assert list(first) == [0, 60, 60, 140] and repeated_phrases.whole_windows(first, 35).sum() == 26 + 46
    assert repeated_phrases.compiled([]) is None
    found = [end for end, _ in repeated_phrases.compiled([b"b c", b"c b"]).iter(" a b c b c ")]
    assert found == [6, 8, 10]


def test_line_frequency(spark):
    rows = [(i, f"n{i} " + " ".join(f"a{i}x{k}" for k in range(60)) + "\nShared  LINE is here\n", "en", "h", None, "", "", "", "") for i in range(40)]
    rows += [(100 + i, "Shared line is here\n" * 20 + f"tail{i} " * 3, "en", "h", None, "", "", "", "") for i in range(3)]
    rows += [(200 + i, "copied text " + " ".join(f"c{k}" for k in range(60)), "en", "h", None, "", "", "", "") for i in range(50)] + awkward(15)[:10]
    got = {r.doc_id: r for r in line_frequency.line_frequency_rules(frame(spark, rows)).collect() if r.doc_id >= 20}
    assert all(got[i].kept and got[i].removed_words == 4 and "LINE" not in got[i].clean_text for i in range(20, 40))
    assert all(got[100 + i].depleted and not got[100 + i].kept for i in range(3))
    assert all(got[200 + i].kept and got[200 + i].removed_words == 0 for i in range(50))


def test_line_frequency_of_mostly_shared_pages(spark):
    """Pages of 83% template, and a line of distinct pages that copies of one other page outnumber."""
    template = "\n".join(" ".join(f"t{k}x{j}" for j in range(10)) for k in range(10)) + "\n"
    rows = [(i, template + " ".join(f"o{i}x{j}" for j in range(20)), "en", "h", None, "", "", "", "") for i in range(200)]
    own = lambda i: " ".join(f"p{i}x{j}" for j in range(60)) + "\nwritten by the staff\n"
    rows += [(1000 + i, own(min(i, 30)), "en", "g", None, "", "", "", "") for i in range(300)]
    got = {r.doc_id: r for r in line_frequency.line_frequency_rules(frame(spark, rows)).collect()}
    assert all(got[i].removed_words == 100 and got[i].depleted and not got[i].kept for i in range(200))
    assert all(got[1000 + i].removed_words == 4 and got[1000 + i].kept for i in range(300))


def test_base_counts(spark):
    rows = awkward(40)
    got = {r.doc_id: r for r in line_frequency.line_frequency_rules(frame(spark, rows)).collect()}
    for r in rows:
        w, text = words(r[1]), r[1] or ""
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        g = got[r[0]]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


def test_templates(spark):
    items = spark.createDataFrame([(1, "a train travels 120 km from Paris to the north in 3 hours so how fast does it go", "x"), (2, None, "y"), (3, "too short", "z")], "item_id long, text string, id string")
    q = "someone wrote that a train travels {} km from {} to the north in {} hours so how fast does it go and more"
    rows = [(1, q.format(120, "Paris", 3)), (2, q.format(250, "London", 5)), (3, "no match at all here"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({})
    got = {(r.doc_id, r.item_id): r.kind for r in templates.contaminated(docs, items).collect()}
    assert got == {(1, 1): "verbatim", (2, 1): "reparameterised"}
    twice = spark.createDataFrame([(1, "take 5 apples and 5 pears then give away some of them to friends")], "item_id long, text string")
    same, not_same = "take 7 apples and 7 pears then give away some of them to friends", "take 7 apples and 9 pears then give away some of them to friends"
    docs = spark.createDataFrame([(1, same), (2, not_same)], "doc_id long, text string")
    assert [r.doc_id for r in templates.contaminated(docs, twice).collect()] == [1]


def test_templates_of_other_lengths(spark):
    q = "a train travels 120 km from {} to the north in 3 hours so how fast does it go"
    long = "the sum of {} apples is taken twice " + " ".join(f"word{k}" for k in range(40)) + " and then {} pears are left over at the end"
    names = "Then ask Anna Berta Clara how they got to the old mill"
    items = spark.createDataFrame([(1, q.format("Paris")), (2, long.format(5, 5)), (3, " ".join(f"term{chr(97 + k)}" for k in range(24))), (4, "so ask Anna Berta Clara how they got to it")], "item_id long, text string")
    w = [f"term{chr(97 + k)}" for k in range(24)]
    rows = [(1, q.format("New York")), (2, long.format(5, 7)), (3, " ".join([*w[:12], "really", *w[12:]])), (4, "so ask Dora Emma Frida how they got to it"), (5, names)]
    got = {(r.doc_id, r.item_id): (r.n_matched, r.kind) for r in templates.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert {k: v[1] for k, v in got.items()} == {(1, 1): "reparameterised", (2, 2): "reparameterised", (3, 3): "verbatim", (4, 4): "reparameterised"}
    assert got[3, 3][0] == 6


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("org", "/fr/", "allow")]
    urls = [None, "nothing", "http://NET/", "http://x.net", "http://x.net/a?b", "https://example.net/en/1", "https://b.a.example.net/en/x1#y", "https://notexample.net/en/", "http://a.org/fr/", "http://a.org/de/", "http://xnet/", "http://example.net/en/"]

    def judge(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls * 3)], "page_id long, url string, host string").repartition(4)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {i: judge(u) for i, u in enumerate(urls * 3)}


def test_licences(spark):
    long_line = "word " * 100 + "Released under the MIT License. " + "word " * 100
    rows = [(0, None), (1, ""), (2, "Licensed under CC BY-NC 4.0.\nx"), (3, long_line), (4, "cc by cc by"), (5, "the mit and a license"), (6, "This work is licensed under the GNU General Public License, version 3.")]
    got = {r.doc_id: (r.n_words, len(r.places), r.base_labels, r.labels, r.score) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == got[1] == (0, 0, "", "", 0.0)
    assert got[2][1:] == (1, "cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert got[3] == (205, 1, "mit", "mit", 1.0)
    assert got[4][:3] == (4, 2, "cc-by") and got[5][3] == "" and got[6][2:4] == ("gpl", "gpl,gpl-3.0")


def test_wrapped_licences(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
    mit = " * Permission is hereby granted, free of charge, to any person\n * obtaining a copy of this software and associated documentation\n * files, to deal in the Software without restriction, including\n"
    apache = "# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n"
    rows = [(0, bsd), (1, "some words\n" * 50 + mit + "some words\n" * 50), (2, apache), (3, "licensed\n" + "x " * 30 + "\nunder cc\n" + "x " * 30 + "\nby 4 0")]
    got = {r.doc_id: (r.labels, r.score, [b.line for b in r.blocks]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ("bsd", 1.0, [0]), 1: ("mit", 1.0, [50]), 2: ("apache-2.0", 1.0, [0]), 3: ("", 0.0, [])}


def test_all_licences_of_a_line(spark):
    two = "Text is licensed under CC BY-SA 4.0 and this Source Code Form is subject to the terms of the Mozilla Public License"
    rows = [(0, two), (1, "dual licensed under CC BY-SA 4.0 and CC BY-NC 4.0"), (2, "Licensed under CC BY-NC 4.0"), (3, "Licensed under CC BY 4.0, images licensed under CC BY-SA 4.0")]
    got = {r.doc_id: sorted(b.label for b in r.blocks) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ["cc-by-sa-4.0", "mpl"], 1: ["cc-by-nc-4.0", "cc-by-sa-4.0"], 2: ["cc-by-nc-4.0"], 3: ["cc-by-4.0", "cc-by-sa-4.0"]}


def test_language_and_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = [r for r in language.identify(docs).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in got) / len(got) > 0.98
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    scored = toxicity.score_toxicity(docs, labels).collect()
    held = [(r.score, toxic[r.doc_id]) for r in scored if r.held_out and r.doc_id in toxic]
    order = sum(a > b for a, y in held if y for b, z in held if not z) / max(1, sum(y for _, y in held) * sum(1 - y for _, y in held))
    assert order > 0.75 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)
    odd = frame(spark)
    assert {r.lang_pred for r in language.identify(odd.filter("doc_id < 4")).collect()} == {"und"}
    assert len(toxicity.score_toxicity(odd, labels.limit(0)).collect()) == odd.count()


def test_no_rows(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    urls = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, action string")
    for out in (near_dedup.near_duplicates(none), repeated_phrases.remove_repeats(none), line_frequency.line_frequency_rules(none), templates.contaminated(none, items), language.identify(none), toxicity.score_toxicity(none, labels), licences.scan_licences(none), url_rules.judge(urls, rules)):
        assert out.collect() == []


def test_filters_against_sets():
    """More languages than a machine word has bits: every member answers, and counts come close to those of sets."""
    import numpy as np

    r = np.random.default_rng(5)
    members = [np.unique(r.integers(0, 1 << 32, 300, np.uint32)) for _ in range(150)]
    f = language.Filters.of([f"l{k}" for k in range(150)], members, 1 << 14)
    assert f.table.shape == (3, 1 << 14)
    for k in (0, 63, 64, 149):
        masks = f.masks(members[k])
        assert f.counts(masks)[k] == len(members[k])
        exact = np.array([len(np.intersect1d(members[k], m)) for m in members], float)
        true = (f.counts(masks) - len(members[k]) * f.false_rate) / (1 - f.false_rate)
        assert np.abs(true - exact).max() <= 6
    small = language.Filters.of(["a"], [members[0]])
    assert small.table.dtype == np.uint8 and small.predict(None) == small.predict("42 !") == ("und", 0.0)


def test_all_languages_are_learned(spark):
    """Seventy languages, one of many rows of which few are learned from; repeated rows, nulls, clashing names."""
    import random

    vocabulary = {k: ["".join(random.Random(f"{k}-{j}").choices("abcdefghijklmnopqrstuvwxyz", k=6)) for j in range(9)] for k in range(70)}
    text = lambda k, i: " ".join(vocabulary[k][(i + j) % 9] for j in range(30))
    rows = [(k * 100 + i, text(k, i), f"l{k}", "s", None, "", "", "", "") for k in range(70) for i in range(9)]
    rows += [(7000 + i, text(3, i), "l3", "s", None, "", "", "", "") for i in range(400)] + [rows[0], rows[0], (None, text(1, 1), None, "", None, "", "", "", ""), (8000, None, "l1", "", None, "", "", "", "")]
    got = language.identify(frame(spark, rows), max_rows=20).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) and sum(r.doc_id == 0 for r in got) == 3
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id not in (None, 8000)]
    assert len(judged) > 150 and sum(judged) >= 0.97 * len(judged)
    assert [r.lang_pred for r in got if r.doc_id == 8000] == ["und"]


def test_label_model_finds_accuracies_and_echoes():
    """Votes of known rates: these come back, an echo is tied to its voice, and counts for little."""
    import numpy as np

    r = np.random.default_rng(4)
    n, accuracy, covers = 8000, np.array([0.9, 0.85, 0.8, 0.75, 0.7]), 0.6
    y = r.random(n) < 0.3
    votes = np.where(r.random((n, 5)) < accuracy, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None]) * (r.random((n, 5)) < covers)
    echoes = np.where(r.random((n, 4)) < 0.9, votes[:, 4:5], r.integers(-1, 2, (n, 4)))
    post, model = toxicity.label_model(np.hstack([votes, echoes]).astype(np.int8))
    assert np.abs(model["accuracy"][:5] - accuracy).max() < 0.05 and abs(model["prior"] - 0.3) < 0.05
    assert all(p < 0 for p in model["parent"][:4]) and sum(p >= 4 for p in model["parent"]) == 4
    _, alone = toxicity.label_model(np.hstack([votes, echoes]).astype(np.int8), min_information=np.inf)
    right = lambda p: ((p > 0.5) == y).mean()
    best, _ = toxicity.label_model(votes.astype(np.int8))
    assert right(post) > right(best) - 0.01 and right(post) > right(toxicity.label_model(np.hstack([votes, echoes]).astype(np.int8), min_information=np.inf)[0]) + 0.01


def test_toxicity_of_awkward_labels(spark):
    rows = awkward(30) + [(700, "you stupid idiot moron", "en", "s", None, "", "", "", "")] * 2
    labels = [(0, 1), (0, 1), (1, 0), (1, 1), (2, None), (3, 7), (None, 1), (12, 0), (13, 0)]
    labels = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, toxic int, text string")
    got = toxicity.score_toxicity(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id == 700}) == 1
    none = toxicity.score_toxicity(frame(spark, rows), labels.filter("false")).collect()
    assert len({r.score for r in none}) == 1 and toxicity.score_toxicity(frame(spark, []), labels).collect() == []


def test_many_nested_url_rules(spark):
    """Rules of nested paths on hosts and hosts above them, against trying every rule; more parts than rules."""
    import random

    r = random.Random(6)
    path = lambda n: "/" + "".join(r.choice(["a", "b", "a/", "/"]) for _ in range(n))
    hosts = ["net", "x.net", "y.x.net", "x.nets", "org", "a.org"]
    rules = list({(r.choice(hosts), r.choice(["", "/", path(r.randint(0, 5))]), r.choice(["block", "allow"])) for _ in range(120)})
    urls = [f"http://{r.choice(['', 'z.', 'q.z.'])}{r.choice(hosts)}{r.choice(['', path(r.randint(0, 7))])}" for _ in range(300)]
    df = spark.createDataFrame([(i % 250, u, "x", 0) for i, u in enumerate(urls)], "page_id long, url string, path string, row int").repartition(3)

    def best(url):
        host, slash, rest = url[7:].partition("/")
        fits = [(-len(h) - len(p), -len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and (slash + rest).startswith(p)]
        return min(fits)[2:] if fits else ("allow", None)

    got = url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert sorted((r.page_id, r.verdict, r.rule or "") for r in got) == sorted((i % 250, best(u)[0], best(u)[1] or "") for i, u in enumerate(urls))
    assert {r.verdict for r in url_rules.judge(df, spark.createDataFrame([], "host string, path string, action string")).collect()} == {"allow"}
