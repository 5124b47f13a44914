"""Weighted random forest on the feature matrix: fit, cross-validate, score."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.churn.evaluate import roc_auc_by
from martlens.churn.split import balanced_weights, stratified_folds, stratified_split
from martlens.fixed_values import (
    DEPTH,
    FEATURES,
    FOLDS,
    MIN_LEAF,
    SEED,
    TOP_FEATURES,
    TREES,
)
from martlens.session import written


@contextmanager
def _held(df: DataFrame):
    """Keep a frame in memory, or on disk beyond it, while it is reused.

    A forest passes over its input once per level, so the rows are spread first;
    a matrix read from few files would train in few tasks. The number of parts
    follows the size of the data and the shuffle settings, not the cores that
    happen to be registered. Bagging draws by the order of rows in a part, so they
    are sorted: the files they came from do not matter then.
    """
    rows = df.repartition("customer_id").sortWithinPartitions("customer_id")
    df = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def fit_forest(
    train: DataFrame,
    features: Sequence[str] | None = None,
    label: str = "churned",
    trees: int = TREES,
    depth: int = DEPTH,
    min_leaf: int = MIN_LEAF,
    seed: int = SEED,
    max_bins: int = 128,
) -> PipelineModel:
    """Forest with balanced class weights; growth is distributed by MLlib.

    ``features`` defaults to all known features the frame has. The node a row has
    reached in each tree is kept beside the row, on disk beyond memory: a level then
    does not walk every tree from its root again. The trees are the same without it.
    """
    inputs = features or [f for f in FEATURES if f in train.columns]
    weights = balanced_weights(train, label).select(label, "weight")
    weighted = train.join(F.broadcast(weights), label)
    assembler = VectorAssembler(inputCols=list(inputs), outputCol="features")
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=label,
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        maxBins=max_bins,
        cacheNodeIds=True,
        seed=seed,
    )
    return Pipeline(stages=[assembler, forest]).fit(weighted)


def score(model: PipelineModel, matrix: DataFrame, label: str = "churned") -> DataFrame:
    """Customer, label and the model's probability of churn."""
    return model.transform(matrix).select(
        "customer_id", label, vector_to_array("probability")[1].alias("score")
    )


def train(matrix: DataFrame, features: Sequence[str] | None = None, **forest) -> PipelineModel:
    """Fit on the training side of the split: the model of :func:`train_and_score`."""
    with _held(stratified_split(matrix)) as split:
        return fit_forest(split.where(~F.col("is_test")), features, **forest)


def train_and_score(
    matrix: DataFrame, features: Sequence[str] | None = None, **forest
) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training side of the split; scored rows of the test side.

    The scores are written, as every evaluation of them is a pass of its own.
    """
    with _held(stratified_split(matrix)) as split:
        model = fit_forest(split.where(~F.col("is_test")), features, **forest)
        return model, written(score(model, split.where("is_test")))


def cv_scores(
    matrix: DataFrame,
    folds: int = FOLDS,
    features: Sequence[str] | None = None,
    parallelism: int = 1,
    **forest,
) -> DataFrame:
    """Written table (customer_id, churned, score, fold): every row is scored by the
    forest that was fitted on the other folds.

    Class weights are those of each training side. The folds are independent
    jobs, of which ``parallelism`` overlap: each holds its own bagged copy of the
    rows, with one count and up to four node numbers per tree.
    """
    with _held(stratified_folds(matrix, folds)) as folded:

        def one(fold: int) -> DataFrame:
            model = fit_forest(folded.where(F.col("fold") != fold), features, **forest)
            tested = score(model, folded.where(F.col("fold") == fold))
            return written(tested.withColumn("fold", F.lit(fold)))

        with ThreadPool(min(parallelism, folds)) as pool:
            return reduce(DataFrame.unionByName, pool.map(one, range(folds)))


def cv_auc(matrix: DataFrame, folds: int = FOLDS, **options) -> DataFrame:
    """Mean and population deviation of the AUC over stratified folds."""
    return auc_of_folds(cv_scores(matrix, folds, **options))


def auc_of_folds(scores: DataFrame) -> DataFrame:
    """The figures of :func:`cv_auc` from the table of out-of-fold scores."""
    return roc_auc_by(scores, "fold").agg(
        F.count("auc").cast("int").alias("folds"),
        F.avg("auc").alias("mean_auc"),
        F.stddev_pop("auc").alias("std_auc"),
    )


def importances_check(importance: DataFrame) -> DataFrame:
    """Number of features and flags, and whether sum and flags are right."""
    flagged = F.when(F.col("is_top"), F.col("importance"))
    others = F.when(~F.col("is_top"), F.col("importance"))
    return importance.agg(
        F.count(F.lit(1)).alias("features"),
        (F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"),
        F.sum(F.col("is_top").cast("long")).alias("flagged"),
        (F.min(flagged) >= F.max(others)).alias("flagged_are_largest"),
    )


def importances(
    model: PipelineModel, matrix: DataFrame, top: int = TOP_FEATURES
) -> DataFrame:
    """Importance per feature, lowest first, with the strongest flagged."""
    names = model.stages[0].getInputCols()
    values = model.stages[-1].featureImportances.toArray().tolist()
    ranked = sorted(zip(names, values), key=lambda pair: (pair[1], pair[0]))
    first_top = len(ranked) - top
    rows = [(name, value, i >= first_top) for i, (name, value) in enumerate(ranked)]
    return matrix.sparkSession.createDataFrame(
        rows, "feature string, importance double, is_top boolean"
    )
