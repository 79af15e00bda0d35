"""Classifier evaluation: report, confusion matrix, robustness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------------
MISCLASSIFIED = 10
LINE_LENGTH = 120


def confusion_counts(pred: DataFrame) -> DataFrame:
    """Rows per (label, prediction): at most the square of the number of classes."""
    return pred.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def classification_report(pred: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    per_class = (confusion_counts(pred)
                 .selectExpr("inline(array(named_struct('class', label, 'hit', CASE WHEN label = prediction THEN n ELSE 0L END, "
                             "'given', 0L, 'support', n), "
                             "named_struct('class', prediction, 'hit', 0L, 'given', n, 'support', 0L)))")
                 .groupBy("class").agg(F.sum("hit").alias("hit"), F.sum("given").alias("given"),
                                       F.sum("support").alias("support"))
                 .selectExpr("class", "support", "hit",
                             "CASE WHEN given > 0 THEN hit / given ELSE 0D END AS precision",
                             "CASE WHEN support > 0 THEN hit / support ELSE 0D END AS recall")
                 .selectExpr("*", "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) "
                             "ELSE 0D END AS f1"))
    # One row: sums over the classes.
    overall = per_class.agg(
        F.sum("support").alias("n"), F.sum("hit").alias("hits"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[F.expr(f"sum({m} * support) / sum(support)").alias(f"weighted_{m}") for m in ("precision", "recall", "f1")])
    averages = overall.selectExpr(
        "inline(array("
        "named_struct('class', 'accuracy', 'precision', cast(null AS DOUBLE), 'recall', cast(null AS DOUBLE), "
        "'f1', hits / n, 'support', n), "
        "named_struct('class', 'macro avg', 'precision', macro_precision, 'recall', macro_recall, 'f1', macro_f1, 'support', n), "
        "named_struct('class', 'weighted avg', 'precision', weighted_precision, 'recall', weighted_recall, "
        "'f1', weighted_f1, 'support', n)))")
    return (per_class.select("class", "precision", "recall", "f1", "support").unionByName(averages)
            .selectExpr("class", "round(precision, 4) AS precision", "round(recall, 4) AS recall",
                        "round(f1, 4) AS f1", "support"))


def confusion_matrix(pred: DataFrame, labels: list[str]) -> DataFrame:
    """Rows are true labels, columns predicted ones (``as_<label>``)."""
    counts = confusion_counts(pred).groupBy("label").pivot("prediction", labels).agg(F.sum("n"))
    # A label without a true line has a row too.
    every = pred.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    counts = every.join(counts, "label", "full")
    return counts.select("label", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(f"as_{x}") for x in labels])


def top_misclassified(pred: DataFrame, n: int = MISCLASSIFIED) -> DataFrame:
    """The first wrong predictions by line, cut to 120 characters."""
    return (pred.filter("label <> prediction").orderBy("label", "prediction", "line").limit(n)
            .selectExpr("label", "prediction", f"substring(line, 1, {LINE_LENGTH}) AS line"))


def robustness_report(scores: DataFrame) -> DataFrame:
    """Per label: accuracy and mean confidence before and after perturbation, lowest after.

    ``scores`` has ``label, prediction, confidence`` and the same for the
    perturbed line (``p_prediction, p_confidence``).
    """
    return scores.groupBy("label").agg(
        F.avg(F.expr("CASE WHEN prediction = label THEN 1D ELSE 0D END")).alias("accuracy"),
        F.avg(F.expr("CASE WHEN p_prediction = label THEN 1D ELSE 0D END")).alias("p_accuracy"),
        F.avg("confidence").alias("mean_confidence"), F.avg("p_confidence").alias("p_mean_confidence"),
        F.min("p_confidence").alias("p_min_confidence"))
