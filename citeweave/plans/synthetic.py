"""Entries made deterministically of the documents table, in Spark's SQL and in the oracle's from one text."""

from __future__ import annotations

TYPES = ["article", "inproceedings", "misc", "book", "techreport", "incollection", "phdthesis", "unpublished", "article", "inproceedings"]
VENUES = [
    "NeurIPS", "Advances in Neural Information Processing Systems", "Proceedings of the 38th International Conference on Machine Learning", "ICLR 2021 poster", "arXiv preprint arXiv:2101.01234",
    "Journal of Machine Learning Research", "Nature Physics", "Nature", "ICML Workshop on Foundation Models", "CoRR", "Lecture Notes in Computer Science", "Proc. ACL", "",
    "IEEE Transactions on Pattern Analysis and Machine Intelligence", "International Workshop on Graph Methods", "KDD Companion",
]
AUTHORS = ["Smith, John", "Jane van den Doe", "Muller Jr., Hans", "Ana Maria Lopez", "Wei Zhang", "L. Euler", "Sun 0020, Min", "others"]
NOTES = ["", "preprint", "see https://arxiv.org/abs/2101.00001v2", "ISBN: 978-3-16-148410-0", "NBER working paper", "\\url{http://example.org/x}"]
URLS = ["", "https://arxiv.org/pdf/2003.10001v3.pdf", "https://www.example.com/a/b?c=1", "https://dl.acm.org/doi/1", "https://aclanthology.org/2020.acl-main.1"]


class Spark:
    def first_words(self, c, n):
        """What follows them is split no further; an empty piece may stand before them."""
        return f"slice(array_remove(split(coalesce({c}, ''), '[\\\\x20\\\\x09-\\\\x0D]+', {n + 2}), ''), 1, {n})"

    def text(self, s):
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pick(self, xs, at):
        return f"element_at(array({', '.join(map(self.text, xs))}), cast({at} as int) + 1)"

    def join(self, xs, sep):
        return f"array_join({xs}, {self.text(sep)})"


class Duck:
    def first_words(self, c, n):
        return f"(list_filter(regexp_split_to_array(coalesce({c}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))[1:{n}]"

    def text(self, s):
        return "'" + s.replace("'", "''") + "'"

    def pick(self, xs, at):
        return f"list_extract([{', '.join(map(self.text, xs))}], cast({at} as int) + 1)"

    def join(self, xs, sep):
        return f"array_to_string({xs}, {self.text(sep)})"


def entries(d, table: str = "documents") -> str:
    """SELECT of entry_id, doc_id, ord, entry_type and fields."""
    author = " || ' and ' || ".join([d.pick(AUTHORS, "doc_id % 8"), d.pick(AUTHORS, "(doc_id * 3 + 1) % 8")])
    return f"""
SELECT 'e' || doc_id AS entry_id, doc_id, doc_id AS ord, {d.pick(TYPES, "doc_id % 10")} AS entry_type,
  {d.join(d.first_words("text", 8), " ")} AS title,
  CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 3 = 0 THEN {d.pick(AUTHORS, "doc_id % 8")} ELSE {author} END AS author,
  CASE WHEN doc_id % 10 IN (0, 8, 4) THEN {d.pick(VENUES, "doc_id % 16")} END AS journal,
  CASE WHEN doc_id % 10 IN (1, 5, 9) THEN {d.pick(VENUES, "(doc_id * 7) % 16")} END AS booktitle,
  CASE WHEN doc_id % 13 = 2 THEN {d.text("\\url{https://medrxiv.org/x}")} END AS howpublished,
  CASE doc_id % 23 WHEN 0 THEN 'n.d.' WHEN 1 THEN '{{2031}}' WHEN 2 THEN '' WHEN 3 THEN '1066' ELSE cast(1990 + doc_id % 40 AS VARCHAR(4)) END AS year,
  CASE doc_id % 6 WHEN 0 THEN 'https://doi.org/10.1000/ABC.' || (doc_id % 400) WHEN 1 THEN '10.48550/arXiv.2101.0' || (1000 + doc_id % 900) || 'v2'
    WHEN 2 THEN '' WHEN 3 THEN 'http://dx.doi.org/10.18653/v1/2020.acl-main.' || doc_id WHEN 4 THEN '10.1101/' || doc_id END AS doi,
  {d.pick(URLS, "(doc_id * 3) % 5")} AS url, {d.pick(NOTES, "(doc_id * 5) % 6")} AS note,
  CASE WHEN doc_id % 17 = 0 THEN '2102.' || (10000 + doc_id % 90000) WHEN doc_id % 17 = 1 THEN 'x' END AS eprint,
  CASE WHEN doc_id % 17 = 1 THEN 'arXiv' END AS archiveprefix,
  CASE WHEN doc_id % 2 = 0 THEN cast(doc_id % 50 AS VARCHAR(10)) END AS volume, CASE WHEN doc_id % 7 = 0 THEN '3' END AS number,
  CASE WHEN doc_id % 4 = 0 THEN '1-9' END AS pages, CASE WHEN doc_id % 5 = 0 THEN 'Press' END AS publisher
FROM {table}"""


def spark_entries(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("_documents")
    return spark.sql(entries(Spark(), "_documents").replace("VARCHAR(4)", "STRING").replace("VARCHAR(10)", "STRING"))


DUCK = f"e AS ({entries(Duck())})"
