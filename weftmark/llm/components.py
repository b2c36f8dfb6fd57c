"""Connected components of an edge table by repeated contraction.

Each round every vertex with a smaller neighbour hooks onto its smallest one, the hooks are
flattened by pointer doubling, and the edges are renamed to the roots, so the graph shrinks
until no edge is left. Only counts reach the driver. Minima are aggregated map-side, and
every join is between two plain stage tables, so a root with a third of all vertices is split
by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import staged


def _as_edges(df: DataFrame) -> DataFrame:
    return (df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
            .filter("hi <> lo").distinct())


def _flattened(hooks: DataFrame) -> DataFrame:
    """Point every vertex at the end of its chain of hooks."""
    while True:
        nxt = hooks.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        step = staged(hooks.join(nxt, "to", "left").select(
            "node", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("moved")), "hooks")
        hooks = step.drop("moved")
        if not step.filter("moved").head(1):
            return hooks


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of one ordered type -> (node, root), a row for each vertex of an edge.

    ``root`` is the same for all vertices of a component. Self-loops, nulls and repeated edges
    add nothing; no edges give no rows.
    """
    left = staged(_as_edges(edges.filter("a is not null and b is not null")), "edges")
    labels = staged(left.select(F.col("hi").alias("node")).union(left.select("lo")).distinct()
                    .withColumn("root", F.col("node")), "labels")
    while left.head(1):
        hooks = _flattened(staged(left.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to")), "hooks"))
        labels = staged(labels.join(hooks.withColumnRenamed("node", "root"), "root", "left")
                        .select("node", F.coalesce("to", "root").alias("root")), "labels")
        half = left.join(hooks.withColumnRenamed("node", "hi"), "hi", "left").select(
            F.coalesce("to", "hi").alias("a"), "lo")
        half = staged(half.filter("a <> lo"), "half")
        full = half.join(hooks.withColumnRenamed("node", "lo"), "lo", "left").select(
            "a", F.coalesce("to", "lo").alias("b"))
        left = staged(_as_edges(full), "edges")
    return labels
