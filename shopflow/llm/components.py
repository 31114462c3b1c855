"""Connected components of a distributed edge table.

Minimum-label propagation with pointer jumping.  Every step is a join and a
combining aggregate; labels are written to the shared folder after each
round, so the lineage stays short.  Nothing but a count reaches the driver.
A node with very many edges is no special case: minima combine before the
shuffle, and adaptive execution may split the joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopflow.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialize(both.union(both.select("v", "u")).where(F.col("u") != F.col("v")).distinct(), "edges")
    labels = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label"))
                             .select(F.col("u").alias("node"), "label"), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near")))
        hooked = labels.join(near, labels.node == near.u).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # Jump: the label of the label, which is itself a node.
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = materialize(hooked.join(jump, "label", "left")
                                .select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")
