"""The forest as a table of nodes, and scores and importances from that table alone.

The table is what another engine needs to give the same figures: one row a node, with
its feature and limit or, in a leaf, the share of churned customers.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlens.fixed_values import TOP_FEATURES
from martlens.session import shared_folder, written


def forest_nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """Written table of the nodes of all trees.

    Columns: tree, node (0 is the root), feature, threshold, left and right (nodes;
    left for values up to the threshold; all four null in a leaf), churned (share of
    the weight of churned customers), weight (of all customers), gain.
    """
    folder = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    model.stages[-1].write().save(folder)
    names = F.array(*[F.lit(name) for name in model.stages[0].getInputCols()])
    stored = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    split, stats = F.col("leftChild") >= 0, F.col("impurityStats")
    total = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b)
    return written(stored.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(split, F.get(names, F.col("split.featureIndex"))).alias("feature"),
        F.when(split, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(split, F.col("leftChild")).alias("left"),
        F.when(split, F.col("rightChild")).alias("right"),
        (F.get(stats, F.lit(1)) / total).alias("churned"), total.alias("weight"), "gain",
    ))


def score_by_nodes(nodes: DataFrame, matrix: DataFrame, label: str = "churned") -> DataFrame:
    """Customer, label and probability of churn: the mean of the leaves reached.

    Customers walk down all trees at once, a level for each join. The nodes are at
    most ``trees * (2 ** (depth + 1) - 1)`` rows, so they are broadcast.
    """
    depth = _depth(nodes)
    features = [r.feature for r in nodes.where("feature IS NOT NULL").select("feature").distinct().collect()]
    values = F.array(*[F.col(f).cast("double") for f in features]).cast("array<double>")
    place = F.array_position(F.array(*[F.lit(f) for f in features]).cast("array<string>"), F.col("feature"))
    every_tree = F.explode(F.sequence(F.lit(0), F.lit(nodes.agg(F.max("tree")).first()[0])))
    at = matrix.select("customer_id", label, values.alias("values"), every_tree.alias("at_tree"))
    at = at.withColumn("at_node", F.lit(0))
    split = nodes.where("feature IS NOT NULL").withColumn("place", (place - 1).cast("int"))
    inner = F.broadcast(split.select("tree", "node", "place", "threshold", "left", "right"))
    for _ in range(depth):
        here = (F.col("at_tree") == F.col("tree")) & (F.col("at_node") == F.col("node"))
        goes = F.when(F.col("place").isNull(), F.col("at_node")).when(
            F.get("values", F.col("place")) <= F.col("threshold"), F.col("left")
        ).otherwise(F.col("right"))
        at = at.join(inner, here, "left").select(
            "customer_id", label, "values", "at_tree", goes.alias("at_node")
        )
    leaves = F.broadcast(nodes.where("feature IS NULL").select("tree", "node", F.col("churned").alias("share")))
    reached = at.join(leaves, (F.col("at_tree") == F.col("tree")) & (F.col("at_node") == F.col("node")))
    return reached.groupBy("customer_id", label).agg(F.avg("share").alias("score"))


def _depth(nodes: DataFrame) -> int:
    """Levels below the root; nodes of a level are found from those above it."""
    links = nodes.where("feature IS NOT NULL").select(
        "tree", "node", F.explode(F.array("left", "right")).alias("child")
    )
    level, depth = nodes.where("node = 0").select("tree", "node"), 0
    while True:
        level = level.join(F.broadcast(links), ["tree", "node"]).select("tree", F.col("child").alias("node"))
        if level.isEmpty():
            return depth
        depth += 1


def importances_by_nodes(nodes: DataFrame, features: list[str], top: int = TOP_FEATURES) -> DataFrame:
    """Importance per feature, lowest first, with the strongest flagged.

    A tree gives each feature the gain of its splits times their weight, scaled to 1
    in all; the trees are added up and scaled to 1 again.
    """
    won = nodes.where("feature IS NOT NULL").groupBy("tree", "feature").agg(
        F.sum(F.col("gain") * F.col("weight")).alias("won")
    )
    per_tree = won.groupBy("tree").agg(F.sum("won").alias("all"))
    shares = won.join(per_tree, "tree").where(F.col("all") > 0).groupBy("feature").agg(
        F.sum(F.col("won") / F.col("all")).alias("share")
    )
    named = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    whole = shares.agg(F.sum("share")).scalar()
    found = named.join(F.broadcast(shares), "feature", "left").select(
        "feature", F.coalesce(F.col("share") / whole, F.lit(0.0)).alias("importance")
    )
    best = found.orderBy(F.desc("importance"), F.desc("feature")).limit(top).select(
        F.col("feature").alias("best")
    )
    return found.join(F.broadcast(best), F.col("feature") == F.col("best"), "left").select(
        "feature", "importance", F.col("best").isNotNull().alias("is_top")
    ).orderBy("importance", "feature")


def nodes_check(nodes: DataFrame, scored: DataFrame, importance: DataFrame, matrix: DataFrame) -> DataFrame:
    """Trees, customers, and how many figures of the model the table does not give."""
    again = score_by_nodes(nodes, matrix).select("customer_id", F.col("score").alias("again"))
    far = F.coalesce(F.abs(F.col("score") - F.col("again")) > 1e-9, F.lit(True))
    probabilities = scored.join(again, "customer_id", "left").agg(
        F.count(F.lit(1)).alias("customers"), F.count(F.when(far, 1)).alias("other_probabilities")
    )
    names = [r.feature for r in importance.select("feature").collect()]
    ours = importances_by_nodes(nodes, names).select(
        "feature", F.col("importance").alias("again"), F.col("is_top").alias("top_again")
    )
    differs = (F.abs(F.col("importance") - F.col("again")) > 1e-9) | (F.col("is_top") != F.col("top_again"))
    features = importance.join(ours, "feature").agg(
        F.count(F.lit(1)).alias("features"), F.count(F.when(differs, 1)).alias("other_importances")
    )
    both = features.select(F.struct("features", "other_importances")).scalar()
    return probabilities.withColumn("_both", both).select(
        "customers", "other_probabilities", "_both.features", "_both.other_importances",
        nodes.agg(F.countDistinct("tree")).scalar().alias("trees"),
    )
