"""Registered queries over small tables of their own."""

from collections import Counter

import duckdb
import pytest

from citeweave.operators import status as T
from citeweave.operators import summaries as U
from citeweave.plans import catalog
from citeweave.plans import metric_queries as Q


@pytest.fixture
def folder(spark, tmp_path):
    """Documents 0 to 197: twenty words of each group of three after forty of each document, and one of the first two."""
    text = lambda i: " ".join([f"own{i}x{k}" for k in range(40)] + [f"Shared{i // 3}x{k}" for k in range(20)] + ["pair"] * (i % 3 < 2))
    spark.createDataFrame([(i, text(i)) for i in range(198)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_author_intersections_of_all_documents_and_words(spark, folder):
    got = {r.g: (r.confirmed, r.n_suspect, r.bonus) for r in Q.author_intersections(spark, folder).collect()}
    assert got == {g: (" ".join(sorted(f"shared{g}x{k}" for k in range(20))), 121, 10) for g in range(66)}


def test_status_summary_of_all_documents(spark, folder):
    got = {r.status: r.n for r in Q.status_summary(spark, folder).collect()}
    assert got == dict(Counter(s[0] for s in T.STATUSES for _ in range(198 // len(T.STATUSES))))


def test_statuses_without_a_result_count_nothing(spark):
    got = {r.status: r.n for r in U.status_summary(spark.createDataFrame([("verified",), ("verified",)], "status string")).collect()}
    assert got == {s[0]: 2 * (s[0] == "verified") for s in T.STATUSES}


def documents(spark, tmp_path, texts):
    spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def by_sql(folder, name):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        return Counter(c.execute(catalog.ORACLE[name]).fetchall())


def by_spark(spark, folder, name):
    return Counter(map(tuple, catalog.QUERIES[name](spark, folder).collect()))


def test_words_between_dollars_are_a_title_s(spark, tmp_path):
    texts = {2: "Of$$$ one first$$$ word", 266: "Of$$$ one first$$$ word", 530: "Of$$$ other$$$ word", 5: "a &amp; b", 269: "a & b"}
    folder = documents(spark, tmp_path, texts)
    assert by_spark(spark, folder, "duplicate_groups") == by_sql(folder, "duplicate_groups") == Counter([("fuzzy:of one first word|muller,others", 2, 2)])


def test_pairs_of_many_copies(spark, tmp_path):
    """More copies than a list holds, more titles of one block than a part holds."""
    texts = {i: "Shared title of many a copy here" for i in range(600)} | {i: f"Shared title number {i} of its own" for i in range(600, 1000)} | {i: f"Other{i % 3} title number {i % 40} stands here" for i in range(1000, 1100)}
    folder = documents(spark, tmp_path, texts)
    assert by_spark(spark, folder, "title_pairs") == by_sql(folder, "title_pairs")
