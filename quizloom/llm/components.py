"""Connected components of links, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all ends of the edges (a, b); the label is one node of the component, the same for all.

    In each round every node hooks on to the neighbour of least hash, if that is less than its own, follows the hooks
    three times, and the edges shrink to the distinct ones between the nodes reached. Hashes keep chains of hooks
    short, and dense groups collapse in the first round. Rounds are cut by checkpoints; no row but one to tell whether
    edges are left reaches the driver.
    """

    def rank(node: str) -> Column:
        return F.struct(F.xxhash64(node).alias("hash"), F.col(node).alias("node"))

    edges = cut(edges.select("a", "b"))
    labels = None
    while labels is None or not edges.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))
        nearest = edges.select(ends.alias("end")).select("end.*").groupBy("node").agg(F.min(rank("near")).alias("least"))
        hook = cut(nearest.select("node", F.least(rank("node"), F.col("least"))["node"].alias("label")))
        step = hook.select(F.col("node").alias("label"), F.col("label").alias("next"))
        root = hook
        for _ in range(2):
            root = root.join(step, "label").select("node", F.col("next").alias("label"))
        root = cut(root)
        of_a, of_b = root.select(F.col("node").alias("a"), F.col("label").alias("c")), root.select(F.col("node").alias("b"), F.col("label").alias("d"))
        joined = edges.join(of_a, "a").join(of_b, "b").filter("c <> d")
        edges = cut(joined.select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct())
        if labels is None:
            labels = root
        else:
            onward = root.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = cut(labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
    return labels


def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, label) after the components that pairs (a, b) of labels, or of nodes without one, tie together have become one."""
    onward = components(pairs)
    alone = onward.join(labels.select(F.col("label").alias("node")).distinct(), "node", "left_anti")
    moved = labels.join(onward.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return cut(moved.union(alone.select("node", "label")))


def grouped(rows: DataFrame, distinct: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """rows with the least id of their component; distinct has the least_id of each key, labels the components of linked keys."""
    linked = distinct.join(labels.withColumnRenamed("node", key), key)
    named = cut(linked.groupBy("label").agg(F.min("least_id").alias("component_id")))
    of_linked = linked.join(named, "label").select(key, "component_id", F.col("label").alias("group"))
    classes = cut(distinct.join(of_linked, key, "left").select(key, F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("group", key).alias("group")))
    return rows.join(classes, key)
