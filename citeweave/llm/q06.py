"""Query op6_label_model."""

from __future__ import annotations

from citeweave.llm.common import table
from citeweave.llm.toxicity import score_toxicity


def op6_label_model(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op6_label_model": op6_label_model}
ORACLE: dict = {}
