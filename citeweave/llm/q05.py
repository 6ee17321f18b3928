"""Query op5_bitmask_filters."""

from __future__ import annotations

from citeweave.llm.common import table
from citeweave.llm.language import identify


def op5_bitmask_filters(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op5_bitmask_filters": op5_bitmask_filters}
ORACLE: dict = {}
