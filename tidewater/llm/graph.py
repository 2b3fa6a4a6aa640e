"""Connected components of a link table, by rounds of DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, materialise


def thinned(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v), u > v, that connect what the edges (u, v) given connect, and never more of them.

    A node stays linked with its smallest neighbour below it, and its other neighbours below it are linked with
    that one instead; nodes of overlapping stars name the same few edges there, which fall together.
    """
    ends = edges.where("u is not null and v is not null and u <> v")
    ends = ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = ends.withColumn("least", F.min("v").over(Window.partitionBy("u")))
    return least.select(F.when(F.col("v") > F.col("least"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("least").alias("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest reachable node.

    Each round a node takes the least label among itself and its neighbours, then the label of
    that label.  Rounds end when no label changes, so any graph comes out exact.  Labels live in
    the shared folder between rounds.  Edges with a null end and self-links are left out.
    """
    links = thinned(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    links = materialise(links.union(links.select("v", "u")), "links")
    labels = materialise(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    stored = labels
    while True:
        near = links.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("least"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialise(step.join(jump, "label", "left").select("node", "old", F.least("label", "far").alias("label")), "labels")
        moved = step.where("old <> label").limit(1).count()
        discard(stored)
        stored, labels = step, step.select("node", "label")
        if not moved:
            discard(links)
            return labels.withColumnRenamed("label", "component")
