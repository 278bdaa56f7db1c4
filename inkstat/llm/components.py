"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of ``links(a, b)``.

    Rounds of neighbourhood minima with a jump through the minimum's own label, each written to
    the shared folder; a hub's links are folded by a partial ``min`` and never gathered. Ends
    when no label falls. Nulls are no nodes; an empty table gives an empty table.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = scratch.save(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = scratch.save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{name}-0")
    turn = 0
    while True:
        near = edges.join(label, edges.b == label.node).groupBy("a").agg(F.min("component").alias("near"))
        best = label.join(near, label.node == near.a).select("node", "component", F.least("component", "near").alias("best"))
        jump = label.select(F.col("node").alias("best"), F.col("component").alias("over"))
        turn += 1
        moved = scratch.save(best.join(jump, "best", "left").select("node", F.least("best", F.coalesce("over", "best")).alias("component"), (F.least("best", F.coalesce("over", "best")) < F.col("component")).alias("fell")), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        if not moved.where("fell").limit(1).count():
            scratch.drop(f"{name}-edges")
            return moved.select("node", "component")
        label = moved.select("node", "component")
