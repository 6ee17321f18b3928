"""Detection metrics of predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITIVE, NEGATIVE = "HALLUCINATED", "VALID"


def with_predictions(gold: DataFrame, predicted: DataFrame, key: str = "key") -> DataFrame:
    """Every gold row with its prediction; `missing` where there is none."""
    return gold.join(predicted, key, "left").withColumn("pred_label", F.coalesce("pred_label", F.lit("missing")))


def confusion_metrics(pairs: DataFrame, by: list[str] | None = None, cube: bool = False) -> DataFrame:
    """Counts and rates of (gold_label, pred_label, abstained), rates rounded to 4 places, null where not defined."""
    cell = lambda g, p: F.count_if((F.col("gold_label") == g) & (F.col("pred_label") == p))
    groups = pairs.cube(*by) if cube and by else pairs.groupBy(*(by or []))
    c = groups.agg(F.count("*").alias("n"), cell(POSITIVE, POSITIVE).alias("tp"), cell(NEGATIVE, POSITIVE).alias("fp"), cell(NEGATIVE, NEGATIVE).alias("tn"), cell(POSITIVE, NEGATIVE).alias("fn"), F.count_if("abstained").alias("abstained"))
    over = lambda a, b: F.when(b != 0, a / b)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    c = c.withColumns({"dr": over(tp, tp + fn), "fpr": over(fp, tn + fp), "prec": over(tp, tp + fp)})
    c = c.withColumns({"f": over(2 * F.col("prec") * F.col("dr"), F.col("prec") + F.col("dr")), "mcc": over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})
    r = lambda x: F.round(x, 4)
    return c.select(*(by or []), "n", (F.col("tp") + F.col("fn")).alias("n_hallucinated"), (F.col("tn") + F.col("fp")).alias("n_valid"), "tp", "fp", "tn", "fn", r("dr").alias("detection_rate"), r("fpr").alias("fpr"), r("prec").alias("precision"), r("f").alias("f1"), r("mcc").alias("mcc"), "abstained", r(over(F.col("n") - F.col("abstained"), F.col("n"))).alias("coverage"))


def rate_by_type(pairs: DataFrame, old: str = "pred_old", new: str = "pred_new", kind: str = "hallucination_type") -> DataFrame:
    """(type, n, old, new, delta) detection rates of positive rows."""
    hit = lambda c: F.avg((F.col(c) == POSITIVE).cast("int"))
    out = pairs.filter(F.col("gold_label") == POSITIVE).groupBy(F.col(kind).alias("type")).agg(F.count("*").alias("n"), hit(old).alias("old"), hit(new).alias("new"))
    return out.withColumn("delta", F.col("new") - F.col("old"))


def error_statuses(pairs: DataFrame) -> DataFrame:
    """(error, status, n): statuses of missed positives (FN) and of flagged negatives (FP)."""
    gold, pred = F.col("gold_label"), F.col("pred_label")
    error = F.when((gold == POSITIVE) & (pred == NEGATIVE), "FN").when((gold == NEGATIVE) & (pred == POSITIVE), "FP")
    return pairs.withColumn("error", error).filter("error is not null").groupBy("error", "status").agg(F.count("*").alias("n"))


def calibration_error(pairs: DataFrame, probability: str = "p_valid", bins: int = 10) -> DataFrame:
    """One row: the expected calibration error over equal bins; null without rows."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1))
    each = pairs.filter(F.col(probability).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("p"), F.avg((F.col("gold_label") == NEGATIVE).cast("double")).alias("y"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def calibration_bins(pairs: DataFrame, probability: str = "p_valid", bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("long")
    return pairs.filter(F.col(probability).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_p"), F.avg((F.col("gold_label") == NEGATIVE).cast("double")).alias("share_valid"))
