"""Connected components of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; a hub with a third of all links is
combined before the shuffle and split by the skew join. Lineage is cut by written
tables, and only one number per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlens.session import written


def _stars(edges: DataFrame) -> DataFrame:
    """Links (u, v) of every u to the smallest node next to it, where v > that."""
    least = edges.groupBy("u").agg(F.min("v").alias("v")).select(
        F.col("u").alias("hub"), F.least("u", "v").alias("least")
    )
    return edges.join(least, F.col("u") == F.col("hub"))


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = _stars(both).where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("least").alias("v")),
        F.struct(F.col("u").alias("u"), F.col("least").alias("v")),
    ))
    rows = _stars(down).select(moved.alias("e")).select("e.u", "e.v")
    return rows.where(F.col("u") != F.col("v")).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Whether every u has one link, and no v is the u of another."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root"))
    return sums.where((F.col("child") > 1) | ((F.col("child") == 1) & (F.col("root") == 1))).agg(
        F.count(F.lit(1))
    ).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node with a link; the label is the smallest node.

    ``links`` has columns u and v. Links of a node to itself are ignored.
    """
    edges = links.select("u", "v").where(F.col("u") != F.col("v"))
    while True:
        edges = written(small_star(large_star(edges)))
        if are_stars(edges):
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        roots.select("node", F.col("node").alias("label"))
    )


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``labels``, joined by further links (u, v).

    Links are first moved to the labels of their ends, so that the work grows
    with the new links between components and not with all links so far.
    """
    for end in ("u", "v"):
        named = labels.select(F.col("node").alias("n"), "label")
        links = links.join(named, F.col(end) == F.col("n"), "left").withColumn(
            end, F.coalesce("label", end)
        ).select("u", "v")
    top = written(components(links.where(F.col("u") != F.col("v")).distinct()))
    old = labels.join(top.select(F.col("node").alias("n"), F.col("label").alias("l")),
                      F.col("label") == F.col("n"), "left").select("node", F.coalesce("l", "label").alias("label"))
    known = labels.select(F.col("node").alias("n"))
    return old.union(top.join(known, F.col("node") == F.col("n"), "left_anti"))
