"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docintake.llm.common import stored


#: Rows of a task, about, for tables that shrink from round to round.
TASK_ROWS = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); a component is named by its smallest node.

    In each round every node points to the smallest of itself and its neighbours, and the edges between the
    nodes pointed to are the next round's graph, which has at most half the nodes that still have edges. All
    rounds are joins and partial aggregates on thin rows; each round is written down, so that lineage stays
    short and hot nodes' join partitions can be split, and runs in as many tasks as its rows call for.
    ``edges`` is read several times: pass a stored table. Self loops are nodes without partners; null ends are
    ignored; an empty table gives an empty table."""
    edges = edges.filter("a is not null and b is not null").select("a", "b")
    labels, n = None, edges.count()
    while labels is None or n:
        tasks = max(1, -(-n // TASK_ROWS))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("to")).coalesce(tasks), "pointers")
        if labels is None:
            labels = step.withColumnRenamed("to", "component")
        else:
            ahead = step.select(F.col("node").alias("component"), "to")
            labels = labels.join(ahead, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        a, b = (step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").filter("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = stored(moved.distinct().coalesce(tasks), "edges")
        n = edges.count()
    return labels
