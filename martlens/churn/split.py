"""Deterministic stratified splits and class weights.

Rows are ordered by a digest of their id inside each label. The place of a row
in that order decides its side, so the split does not depend on partitioning,
and a lost task recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martlens.fixed_values import FOLDS, SEED, TEST_PARTS

_PREFIX = 4  # hexadecimal digits, so 65,536 slices of the digest range


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")))


def digest_cutoffs(df: DataFrame, label: str, wanted: DataFrame, on: str) -> DataFrame:
    """Digest of the row at a given place in the digest order of its label.

    ``df`` has ``label`` and ``_digest``; ``wanted`` has ``label``, a cutoff
    number ``on`` and the 1-based ``place``. Slice counts (at most 65,536 per
    label) locate the slice that holds the place. Only rows of such a slice are
    ranked: about one in 65,536 per cutoff, as digests are uniform.
    """
    prefix = F.substring("_digest", 1, _PREFIX)
    rows = df.select(label, "_digest").withColumn("_slice", prefix)
    upto = Window.partitionBy(label).orderBy("_slice")
    slices = (
        rows.groupBy(label, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
    )
    hit = (
        slices.join(F.broadcast(wanted), label)
        .where((F.col("place") > F.col("_upto") - F.col("_n")) & (F.col("place") <= F.col("_upto")))
        .select(label, "_slice", on, (F.col("place") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    order = Window.partitionBy(label, on).orderBy("_digest")
    return (
        rows.join(F.broadcast(hit), [label, "_slice"])
        .withColumn("_row", F.row_number().over(order))
        .where(F.col("_row") == F.col("_rank"))
        .select(label, on, F.col("_digest").alias("_cutoff"))
    )


def _label_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))


def stratified_split(
    df: DataFrame,
    label: str = "churned",
    key: str = "customer_id",
    parts: int = TEST_PARTS,
    seed: int = SEED,
) -> DataFrame:
    """Adds ``is_test``: one row in ``parts``, rounded up, dealt to the labels.

    Each label gets its share rounded down; rows left over go to the labels with
    the largest fractions, ties to the smaller label.
    """
    marked = df.withColumn("_digest", _digest(key, seed))
    # A row for each label; the windows run over those.
    everything, ranked = Window.partitionBy(), Window.orderBy(F.desc("_rest"), label)
    tests = F.expr(f"(_total + {parts - 1}) div {parts}")
    wanted = (
        _label_sizes(df, label)
        .withColumn("_total", F.sum("_size").over(everything))
        .withColumn("_tests", tests)
        .withColumn("_base", F.expr("_tests * _size div _total"))
        .withColumn("_rest", F.expr("_tests * _size % _total"))
        .withColumn("_left", F.col("_tests") - F.sum("_base").over(everything))
        .withColumn("_extra", (F.row_number().over(ranked) <= F.col("_left")).cast("long"))
        .select(label, F.lit(1).alias("_part"), (F.col("_base") + F.col("_extra")).alias("place"))
    )
    cutoffs = digest_cutoffs(marked, label, wanted, "_part").drop("_part")
    is_test = F.coalesce(F.col("_digest") <= F.col("_cutoff"), F.lit(False))
    return (
        marked.join(F.broadcast(cutoffs), label, "left")
        .withColumn("is_test", is_test)
        .drop("_digest", "_cutoff")
    )


def stratified_folds(
    df: DataFrame,
    folds: int = FOLDS,
    label: str = "churned",
    key: str = "customer_id",
    seed: int = SEED,
) -> DataFrame:
    """Adds ``fold`` (0-based); fold sizes per label differ by at most one.

    Each fold is a contiguous run of the digest order.
    """
    marked = df.withColumn("_digest", _digest(key, seed))
    ends = F.explode(F.sequence(F.lit(1), F.lit(folds - 1)))
    wanted = (
        _label_sizes(df, label)
        .select(label, "_size", ends.alias("_end"))
        .select(label, "_end", F.expr(f"_size * _end div {folds}").alias("place"))
    )
    cutoffs = (
        digest_cutoffs(marked, label, wanted, "_end")
        .groupBy(label)
        .agg(F.collect_list("_cutoff").alias("_cutoffs"))
    )
    passed = F.size(F.filter("_cutoffs", lambda c: F.col("_digest") > c))
    return (
        marked.join(F.broadcast(cutoffs), label, "left")
        .withColumn("fold", F.when(F.col("_cutoffs").isNull(), 0).otherwise(passed))
        .drop("_digest", "_cutoffs")
    )


def stratified_split_counts(matrix: DataFrame) -> DataFrame:
    return (
        stratified_split(matrix)
        .groupBy("churned", "is_test")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("churned", "is_test")
    )


def fold_counts(matrix: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Rows per fold and label."""
    return (
        stratified_folds(matrix, folds)
        .groupBy("fold", "churned")
        .agg(F.count(F.lit(1)).alias("customers"))
        .orderBy("fold", "churned")
    )


def balanced_weights(df: DataFrame, label: str = "churned") -> DataFrame:
    """Weight ``n / (classes * n_class)`` per class."""
    all_classes = Window.partitionBy()
    return _label_sizes(df, label).select(
        label,
        F.col("_size").alias("customers"),
        (
            F.sum("_size").over(all_classes).cast("double")
            / (F.count(F.lit(1)).over(all_classes) * F.col("_size"))
        ).alias("weight"),
    )
