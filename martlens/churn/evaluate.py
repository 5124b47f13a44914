"""Exact evaluation of scores, and risk bands.

Inputs are rows of a 0/1 label and a score. Everything starts from counts per
score or per cell, so the work after the first aggregation is small unless the
scores are nearly all distinct, and even then no task sees them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlens.fixed_values import (
    CLASS_NAMES,
    HIGH_RISK,
    MEDIUM_RISK,
    PROBABILITY_DIGITS,
    RISK_BANDS,
)
from martlens.functions.exprs import count_where, first_match, half_even, half_up, ratio
from martlens.operators.ordering import running_totals

def _per_score(scored: DataFrame, label: str, score: str) -> DataFrame:
    return scored.groupBy(F.col(score).alias("score")).agg(
        count_where(F.col(label) == 1).alias("pos"),
        count_where(F.col(label) == 0).alias("neg"),
    )


def roc_auc(
    scored: DataFrame, label: str = "churned", score: str = "score", digits: int | None = 6
) -> DataFrame:
    """Area under the ROC curve, ties counted half; null for a single class.

    ``digits=None`` leaves it unrounded.
    """
    ranked = running_totals(_per_score(scored, label, score), [F.desc("score")], ["pos"])
    above = F.col("pos_upto") - F.col("pos")
    # Twice the concordant pairs stays an exact integer.
    twice = F.sum((F.col("neg") * (above * 2 + F.col("pos"))).cast("decimal(38,0)"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double") * 2
    area = ratio(twice, pairs)
    return ranked.agg((area if digits is None else half_up(area, digits)).alias("auc"))


def roc_auc_by(
    scored: DataFrame, group: str, label: str = "churned", score: str = "score"
) -> DataFrame:
    """Unrounded area under the ROC curve of each group; null for a single class.

    All groups are ranked in one go; what other groups add to the running totals is
    taken off afterwards. Groups are few, their rows need not be.
    """
    counted = scored.groupBy(group, F.col(score).alias("score")).agg(
        count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(counted, [group, F.desc("score")], ["pos"])
    above = F.col("pos_upto") - F.col("pos")
    wide = "decimal(38,0)"
    twice = F.sum((F.col("neg") * (above * 2 + F.col("pos"))).cast(wide))
    others = F.min(above).cast("decimal(18,0)") * F.sum("neg").cast("decimal(18,0)") * 2
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double") * 2
    return ranked.groupBy(group).agg(ratio(twice - others, pairs).alias("auc"))


def roc_curve(
    scored: DataFrame,
    label: str = "churned",
    score: str = "score",
    drop_intermediate: bool = True,
) -> DataFrame:
    """Points of the ROC curve from (0, 0) to (1, 1), thresholds descending.

    ``drop_intermediate`` leaves out inner points that lie halfway between their
    neighbours, that is, where the next score adds the same counts. The starting
    point has a null threshold.
    """
    counts = ["pos", "neg"]
    ranked = running_totals(
        _per_score(scored, label, score), [F.desc("score")], counts, following=counts
    )
    first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
    same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
    points = ranked
    if drop_intermediate:
        points = ranked.where(first | ~F.coalesce(same, F.lit(False)))
    points = points.select(
        F.col("score").cast("double").alias("threshold"),
        F.col("neg_upto").alias("fp"),
        F.col("pos_upto").alias("tp"),
    )
    sizes = ranked.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    start = sizes.select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0).cast("long").alias("fp"),
        F.lit(0).cast("long").alias("tp"),
    )
    size = sizes.select(F.struct("p", "n")).scalar()
    return (
        points.unionByName(start)
        .withColumn("_size", size)
        .select(
            "threshold",
            ratio(F.col("fp"), F.col("_size.n")).alias("fpr"),
            ratio(F.col("tp"), F.col("_size.p")).alias("tpr"),
        )
        .orderBy(F.desc_nulls_first("threshold"))
    )


def _cells(scored: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row: true and false negatives and positives."""
    called = F.col(score) > threshold
    actual = F.col(label) == 1
    return scored.agg(
        count_where(~actual & ~called).alias("tn"),
        count_where(~actual & called).alias("fp"),
        count_where(actual & ~called).alias("fn"),
        count_where(actual & called).alias("tp"),
    )


def confusion_matrix(
    scored: DataFrame, label: str = "churned", score: str = "score", threshold: float = 0.5
) -> DataFrame:
    """Customers per actual and predicted class, all four cells."""
    rows = [
        F.struct(
            F.lit(CLASS_NAMES[a]).alias("actual"),
            F.lit(CLASS_NAMES[p]).alias("predicted"),
            F.col(cell).alias("customers"),
        )
        for a, p, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
    ]
    return _cells(scored, label, score, threshold).select(F.inline(F.array(*rows)))


def classification_report(
    scored: DataFrame,
    label: str = "churned",
    score: str = "score",
    threshold: float = 0.5,
    digits: int = 4,
) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy and averages.

    An undefined ratio counts as 0. The accuracy row carries the accuracy in
    every column, as there are no separate values for it.
    """

    def safe(top: Column, bottom: Column) -> Column:
        return F.coalesce(ratio(top, bottom), F.lit(0.0))

    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    cells = _cells(scored, label, score, threshold).select(
        safe(tn, tn + fn).alias("p0"),
        safe(tn, tn + fp).alias("r0"),
        safe(tn * 2, tn * 2 + fn + fp).alias("f0"),
        (tn + fp).alias("s0"),
        safe(tp, tp + fp).alias("p1"),
        safe(tp, tp + fn).alias("r1"),
        safe(tp * 2, tp * 2 + fn + fp).alias("f1"),
        (tp + fn).alias("s1"),
        safe(tn + tp, tn + fp + fn + tp).alias("accuracy"),
    )
    support = F.col("s0") + F.col("s1")

    def row(name: str, precision: Column, recall: Column, f1: Column, size: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            half_up(precision, digits).alias("precision"),
            half_up(recall, digits).alias("recall"),
            half_up(f1, digits).alias("f1"),
            size.alias("support"),
        )

    def macro(m: str) -> Column:
        return (F.col(f"{m}0") + F.col(f"{m}1")) / 2

    def weighted(m: str) -> Column:
        return safe(F.col(f"{m}0") * F.col("s0") + F.col(f"{m}1") * F.col("s1"), support)

    accuracy = F.col("accuracy")
    rows = [
        row(CLASS_NAMES[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row(CLASS_NAMES[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", accuracy, accuracy, accuracy, support),
        row("macro avg", macro("p"), macro("r"), macro("f"), support),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), support),
    ]
    return cells.select(F.inline(F.array(*rows)))


def risk_bands(
    scored: DataFrame,
    score: str = "score",
    high: float = HIGH_RISK,
    medium: float = MEDIUM_RISK,
    digits: int = PROBABILITY_DIGITS,
) -> DataFrame:
    """Rounded churn probability and its band; the rounded value decides."""
    probability = half_even(F.col(score), digits)
    rounded = F.col("churn_probability")
    band = first_match([rounded > high, rounded > medium], RISK_BANDS)
    return scored.select("customer_id", probability.alias("churn_probability")).withColumn(
        "predicted_segment", band
    )


def predictions_check(
    banded: DataFrame, matrix: DataFrame, high: float = HIGH_RISK, medium: float = MEDIUM_RISK
) -> DataFrame:
    """Customers scored, and how many break a property that predictions must have."""
    p, segment = F.col("churn_probability"), F.col("predicted_segment")
    by_limit = F.when(p > high, RISK_BANDS[0]).when(p > medium, RISK_BANDS[1]).otherwise(RISK_BANDS[2])
    known = matrix.select("customer_id", F.lit(1).alias("_known")).distinct()
    return banded.join(known, "customer_id", "left").agg(
        F.count(F.lit(1)).alias("customers"),
        count_where(F.col("customer_id").isNull()).alias("null_ids"),
        count_where(p.isNull() | (p < 0) | (p > 1)).alias("outside_range"),
        count_where(~segment.eqNullSafe(by_limit)).alias("wrong_band"),
        count_where(F.col("_known").isNull()).alias("unknown_ids"),
    )


def risk_band_counts(banded: DataFrame) -> DataFrame:
    return (
        banded.groupBy("predicted_segment")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy(F.desc("customers"), "predicted_segment")
    )
