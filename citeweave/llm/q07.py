"""Query op7_offset_attribution."""

from __future__ import annotations

from citeweave.llm.attribution import attribute_tokens
from citeweave.llm.common import table


def op7_offset_attribution(spark, sf_dir):
    return attribute_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op7_offset_attribution": op7_offset_attribution}
ORACLE: dict = {}
