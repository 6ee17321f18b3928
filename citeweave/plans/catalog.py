"""Every registered query of the library's own operators and its SQL."""

from __future__ import annotations

from citeweave.plans import entry_queries, metric_queries, pipeline_queries

QUERIES = entry_queries.QUERIES | metric_queries.QUERIES | pipeline_queries.QUERIES
ORACLE = entry_queries.ORACLE | metric_queries.ORACLE | pipeline_queries.ORACLE


def flagship(spark, sf_dir):
    """Citations of LaTeX texts semi-joined with a bibliography."""
    return QUERIES["cited_filter"](spark, sf_dir)
