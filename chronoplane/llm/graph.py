"""Connected components by contraction, with scratch tables between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that isn't the least of its component.

    ``edges`` has (u, v) of any orderable type.  Each round every node points to
    its least neighbour below it, pointers are followed to their ends by doubling,
    and the edges are contracted; rounds end when no edge is left.
    """
    known = None
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        up = materialize(edges.groupBy("u").agg(F.min("v").alias("p")).withColumnRenamed("u", "node"), "pointers")
        while True:
            step = up.join(up.select(F.col("node").alias("p"), F.col("p").alias("pp")), "p", "left")
            up = materialize(step.select("node", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "pointers")
            moved = not up.where("moved").isEmpty()
            up = up.drop("moved")
            if not moved:
                break
        to = lambda c: up.select(F.col("node").alias(c), F.col("p").alias(f"p{c}"))
        moved = edges.join(to("u"), "u").join(to("v"), "v", "left").select("pu", F.coalesce("pv", "v").alias("pv"))
        edges = materialize(moved.where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct(), "edges")
        if known is not None:
            further = up.select(F.col("node").alias("root"), "p")
            up = known.join(further, "root", "left").select("node", F.coalesce("p", "root").alias("p")).unionByName(up)
        known = materialize(up.select("node", F.col("p").alias("root")), "roots")
        if edges.isEmpty():
            return known
