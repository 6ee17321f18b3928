"""Functions and operators on values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from citeweave.functions import identifiers as I
from citeweave.functions import names as N
from citeweave.functions import text as X
from citeweave.functions import venues as V
from citeweave.functions.fuzzy import ratio_py
from citeweave.operators import citations as C
from citeweave.operators import dedupe as D
from citeweave.operators import evaluate as E
from citeweave.sources.bib import Reader, entries_of


def one(spark, column, **values):
    cols = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    row = tuple(values.values()) or ("",)
    return spark.createDataFrame([row], cols).select(column.alias("out")).first().out


@pytest.mark.parametrize(("raw", "want"), [("Heged{\\H u}s", "Hegedűs"), ("Ak{\\c c}ay", "Akçay"), ("Wa{\\l}{\\k e}sa", "Wałęsa"), ("A &amp; B", "A & B"), ("d&apos;Amore", "d'Amore"), ("$x^2$ {\\bf a} b", "a b"), ("{\\'\\i}n", "ín")])
def test_plain_text(raw, want):
    assert X.to_plain_py(raw) == want


def test_title_keys(spark):
    assert one(spark, X.title_key(F.col("t")), t="{Über} die Straße: \\'Etude") == "uber die strasse etude"
    assert one(spark, X.title_key(F.col("t")), t=None) == ""


@pytest.mark.parametrize(("name", "want"), [("van den Oord, Aaron", "oord"), ("Aaron van den Oord", "oord"), ("John Smith Jr.", "smith"), ("Sun 0020", "sun"), ("Mallikarjun B. R.", "mallikarjun"), ("", "")])
def test_surnames(spark, name, want):
    assert one(spark, N.surname_key(F.col("n")), n=name) == want


def test_identifiers(spark):
    assert one(spark, I.doi_for_resolution(F.col("d")), d="https://doi.org/10.48550/arXiv.2010.11929v1") == "10.48550/arxiv.2010.11929"
    assert one(spark, I.arxiv_id(F.col("d")), d="10.1000/5678.9012 and https://arxiv.org/pdf/2003.10001v3.pdf") == "2003.10001"
    assert one(spark, I.arxiv_id(F.col("d")), d="5678.9012") is None
    assert one(spark, I.issn_normalize(F.col("d")), d="2167-647x") == "2167-647X"
    assert one(spark, I.stream_key(F.col("d")), d="conf/icml/Smith23") == "conf/icml"
    assert one(spark, I.paperhash(F.col("d"), F.lit("Müller")), d="BERT: Few-Shot log_2") == "müller|bert_fewshot_log_2"


@pytest.mark.parametrize(("venue", "want"), [("ICLR.cc/2024/Conference", "iclr"), ("ICLR (Poster)", "iclr"), ("Trans. Mach. Learn. Res.", "tmlr"), ("Nature Physics", None), ("NAACL", "naacl"), ("acl", "acl"), ("", None)])
def test_canonical_venues(spark, venue, want):
    assert one(spark, V.canonical_venue(F.col("v")), v=venue) == want


def test_ratio():
    assert ratio_py("b a", "a b") == 100 and ratio_py("", "") == 100 and ratio_py("ab", "cd") == 0
    assert abs(ratio_py("kitten", "sitting") - 100 * 2 * 4 / 13) < 1e-9


def test_comments_and_citations(spark):
    t = "50\\% x \\cite{a, b} % \\cite{no}\n\\parencite*[p][q]{c}\\footcite{d}"
    assert one(spark, C.cited_keys(F.col("t")), t=t) == ["a", "b", "c"]


def test_bibliographies(spark):
    text = '@string{j = "Journal"}\n@comment{x}\n@Article{k1, title = {A {B} c}, journal = j # " of X", year = 2020}\n@misc{k2, note = "a {\\"o} b"}\n@book{open, title = {x}'
    got = list(Reader(text).entries())
    assert [(e["entry_type"], e["key"], e["problem"]) for e in got] == [("article", "k1", None), ("misc", "k2", None), ("book", None, "unmatched bracket")]
    assert got[0]["fields"] == {"title": "A {B} c", "journal": "Journal of X", "year": "2020"}
    rows = entries_of(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    assert [r.title for r in rows] == ["A {B} c", None, None]


def test_fold_of_duplicates(spark):
    rows = [(1, "a", "misc", {"title": "t"}), (2, "b", "article", {"title": "t", "year": "1"}), (3, "c", "misc", {"doi": "d", "note": "n"})]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "ord long, entry_id string, entry_type string, fields map<string,string>").repartition(parts)
        r = D.merge_duplicates(df, F.lit("k")).first()
        assert (r.entry_id, r.entry_type, dict(r.fields), r.ids) == ("b", "article", {"title": "t", "year": "1", "doi": "d", "note": "n"}, ["a", "b", "c"])


def test_published_counts(spark):
    """Counts and rates published for 1,119 labelled entries."""
    cells = [("HALLUCINATED", "HALLUCINATED", 524), ("VALID", "HALLUCINATED", 47), ("VALID", "VALID", 466), ("HALLUCINATED", "VALID", 82)]
    rows = [(g, p, False) for g, p, n in cells for _ in range(n)]
    r = E.confusion_metrics(spark.createDataFrame(rows, "gold_label string, pred_label string, abstained boolean")).first()
    assert (r.n_hallucinated, r.n_valid) == (606, 513)
    assert (round(r.detection_rate, 3), round(r.fpr, 3), round(r.precision, 3), round(r.f1, 2), round(r.mcc, 3)) == (0.865, 0.092, 0.918, 0.89, 0.771)
