"""Connected components of an edge table, by rounds of minimum labels and pointer jumping.

Every round is written to the shared folder, so lineage stays short and a lost executor costs one
round. Nothing but the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): every node of an edge with the smallest node that it reaches. Self loops, repeated
    and reversed edges are fine; rows with a null end are ignored."""
    edges = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    both = materialize(edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label = materialize(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label"))
                        .select(F.col("x").alias("node"), "label"))
    while True:
        # smallest label among the neighbours' labels, offered to the node and to its present root
        offer = both.join(label, both["y"] == label["node"]).select("x", "label")
        mine = label.select(F.col("node").alias("x"), F.col("label").alias("old"))
        best = offer.groupBy("x").agg(F.min("label").alias("offer")).join(mine, "x")
        best = best.select("x", "old", F.least("offer", "old").alias("new"))
        roots = best.groupBy(F.col("old").alias("root")).agg(F.min("new").alias("root_new"))
        # a node follows what its root was offered (pointer jumping along roots)
        step = best.join(roots, best["old"] == roots["root"], "left").select(
            F.col("x").alias("node"), F.least("new", F.coalesce("root_new", "new")).alias("label"), "old")
        step = materialize(step)
        if not step.where("label <> old").limit(1).count():
            return step.select("node", "label")
        label = step.select("node", "label")
