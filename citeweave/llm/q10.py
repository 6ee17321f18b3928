"""Query op10_mixture_packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.llm.common import table
from citeweave.llm.packing import pack


def digest(pieces):
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op10_mixture_packing(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents")))


QUERIES = {"op10_mixture_packing": op10_mixture_packing}
ORACLE: dict = {}
