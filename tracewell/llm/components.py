"""Connected components of a large edge table, by hooking and contraction.

Each round hooks every node to its smallest neighbour, shortens those pointers until they end in
roots, and contracts the edges, which leaves half of the nodes at most. Nodes and edges stay in tables; a hub's rows are only ever joined against a table with one row
for each key, both sides shuffled for that join alone, so that a skewed key can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that can be reached.

    Loops, repeated edges and edges with a null end are left out; a node that only such edges have
    isn't listed. An empty table gives an empty result.
    """
    edges = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    while True:
        hooks = cut(edges.groupBy(F.col("a").alias("from_node")).agg(F.min("b").alias("to_node")))
        if hooks.isEmpty():
            return roots
        while not _pointing_on(hooks).isEmpty():
            hooks = cut(_shortened(hooks))
        roots = _relabelled(roots, "root", hooks)
        edges = _relabelled(_relabelled(edges, "a", hooks), "b", hooks).filter("a <> b")
        edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _relabelled(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    joined = rows.join(hooks, rows[column] == hooks["from_node"], "left")
    return joined.select(*(F.coalesce("to_node", column).alias(column) if c == column else c for c in rows.columns))


def _pointing_on(hooks: DataFrame) -> DataFrame:
    """The hooks whose target is hooked itself."""
    return hooks.join(hooks.select(F.col("from_node").alias("via")), F.col("to_node") == F.col("via"), "left_semi")


def _shortened(hooks: DataFrame) -> DataFrame:
    beyond = hooks.select(F.col("from_node").alias("via"), F.col("to_node").alias("beyond"))
    return hooks.join(beyond, F.col("to_node") == F.col("via"), "left").select("from_node", F.coalesce("beyond", "to_node").alias("to_node"))
