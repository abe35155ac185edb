"""Connected components by least labels and pointer jumping, every round a written table; nothing goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.functions.frames import together
from tonearm.llm.common import Tables


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """edges (a, b) to (node, label): label is the least node that can be reached. Nodes without edges have no row.

    Sides are read from written tables, so that Spark can split the rows of a node with very many edges.
    """
    both = tables.write(together(edges.select("a", "b"), edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = tables.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    turn, changed = 0, True
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        turn += 1
        done = tables.write(step, f"{name}-{turn}")
        changed = not done.filter("label <> old").isEmpty()
        if turn > 1:
            tables.drop(f"{name}-{turn - 2}")
        labels = done.select("node", "label")
    return labels
