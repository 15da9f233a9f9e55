"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from insumo.sources.shared import forget, saved


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component of edges (x, y), by label propagation with pointer jumping, a table a round,
    until no label changes. An edge from a node to itself keeps the node."""
    both = saved(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    state = saved(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = both.join(state.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        step = state.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.alias("s").join(step.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left")
        new = saved(jump.select("node", F.least("label", "up").alias("label"), "old"), "labels")
        changed = new.filter("label <> old").limit(1).count()
        forget(state)
        state = new.drop("old")
        state.saved_at = new.saved_at
        if not changed:
            forget(both)
            return state
