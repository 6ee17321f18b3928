"""Resolve, then check what was resolved: trust, and reverting an upgrade that the check does not bear out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.identifiers import doi_normalize, first_year
from citeweave.operators.status import passes_as_fine

TITLE, AUTHOR, MAX_FORWARD = 0.90, 0.80, 5


def trust(title_score: Column, author_score: Column, cited_year: Column, record_year: Column) -> Column:
    """struct(trusted, reasons) of an upgrade; each reason alone is enough."""
    cited = first_year(cited_year)
    reasons = F.array(
        F.when(title_score < TITLE, F.lit("title")),
        F.when(author_score < AUTHOR, F.lit("author")),
        F.when(record_year < cited, F.lit("year_before")),
        F.when(record_year > cited + MAX_FORWARD, F.lit("year_after")),
    )
    found = F.filter(reasons, lambda r: r.isNotNull())
    return F.struct((F.size(found) == 0).alias("trusted"), found.alias("reasons"))


def is_problematic(status: Column) -> Column:
    return ~passes_as_fine(status)


def should_revert(trusted: Column, upgraded_doi: Column, best_doi: Column, original_status: Column) -> Column:
    """Whether a distrusted upgrade goes back: an independent best match names another DOI, or the original was a problem."""
    other = F.coalesce(doi_normalize(best_doi) != doi_normalize(upgraded_doi), F.lit(False))
    return ~trusted & (other | F.coalesce(is_problematic(original_status), F.lit(False)))


def chain(updated: DataFrame, checked: DataFrame) -> DataFrame:
    """updated (entry_id, action, title_score, author_score, cited_year, record_year, new_doi) with the check of the
    originals (entry_id, status, best_doi): flagged, reasons, reverted, and the final action."""
    out = updated.join(checked.select("entry_id", "status", "best_doi"), "entry_id", "left")
    up = F.col("action") == "upgraded"
    t = trust(F.col("title_score"), F.col("author_score"), F.col("cited_year"), F.col("record_year"))
    out = out.withColumn("trust", F.when(up, t)).withColumns({"flagged": up & ~F.col("trust.trusted"), "reasons": F.coalesce("trust.reasons", F.array().cast("array<string>"))})
    out = out.withColumn("reverted", F.col("flagged") & should_revert(F.col("trust.trusted"), F.col("new_doi"), F.col("best_doi"), F.col("status")))
    return out.withColumn("final_action", F.when(F.col("reverted"), "reverted").otherwise(F.col("action"))).drop("trust")


def still_to_check(updated: DataFrame) -> DataFrame:
    return updated.filter(~F.col("action").isin("upgraded", "skipped_resolved"))
