"""Connected components of a table of links, by joins.

Every node points to the least node it knows of; in each round it learns the least pointer among its
neighbours, and then follows pointers to pointers. Rounds grow with the logarithm of a component's
diameter. Each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhour.llm.tables import land


def components(links: DataFrame, node: str = "node") -> DataFrame:
    """``node, component`` for the ends of ``a, b``; a component is named by its least node."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b")
    edges = land(both, "edges")
    labels = land(
        edges.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("label")
        ),
        "labels",
    )
    while True:
        # what neighbours point to, told to this node and to the node it points to
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("heard")
        )
        known = labels.join(seen, "node").select("node", "label", F.least("label", "heard").alias("low"))
        hooks = (
            known.select(F.col("label").alias("node"), "low")
            .union(known.select("node", "low"))
            .groupBy("node")
            .agg(F.min("low").alias("low"))
        )
        jumps = hooks.select(F.col("node").alias("low"), F.col("low").alias("next"))
        stepped = hooks.join(jumps, "low", "left").select("node", F.coalesce("next", "low").alias("label"))
        after = land(
            stepped.join(labels.select("node", F.col("label").alias("before")), "node").select(
                "node", "label", (F.col("label") != F.col("before")).alias("moved")
            ),
            "labels",
        )
        if not after.where("moved").limit(1).count():
            return after.select(F.col("node").alias(node), F.col("label").alias("component"))
        labels = after.select("node", "label")
