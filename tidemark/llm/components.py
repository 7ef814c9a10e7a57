"""Connected components by distributed label passing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of `edges` with the smallest node of its component.

    Each round a node takes the least root among its neighbours', then its root's root, so chains halve. Rounds end when nothing
    changes; each is a written table, and no more than a count of changes comes to the driver. Nulls and loops add nothing.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y").distinct()
    both = scratch.table(pairs.union(pairs.select("y", "x")).distinct(), "edges")
    state = scratch.table(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("near"))
        taken = state.join(near, F.col("node") == F.col("x")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = state.select(F.col("node").alias("via"), F.col("root").alias("above"))
        new = scratch.table(taken.join(jump, F.col("root") == F.col("via")).select("node", "was", F.least("root", "above").alias("root")), "roots")
        if new.filter("was <> root").isEmpty():
            return new.select("node", "root")
        state = new.select("node", "root")
