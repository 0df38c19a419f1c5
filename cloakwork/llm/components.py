"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.shared import staged


def _links(a, b, links: DataFrame) -> DataFrame:
    """Each link once, from the lesser node to the greater; none to oneself."""
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links; the component is its least node.

    In each round a node points to its least neighbour, if that is less, and then to where
    that one points.  Nodes with the same end become one, and only links between different
    ones go on, so links fall away fast and at least half of the linked nodes with them.
    Pointers and links are written out after each round.  Null nodes and links to oneself
    are left out.
    """
    given = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges, labels = staged(_links(F.col(a), F.col(b), given), "links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        first = first.select("node", F.least("node", "least").alias("near"))
        ends = first.select(F.col("node").alias("near"), F.col("near").alias("component"))
        pointers = staged(first.join(ends, "near").select("node", "component"), "labels")
        if labels is None:
            labels = pointers
        else:
            moved = pointers.select(F.col("node").alias("component"), F.col("component").alias("to"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        of_a = pointers.select(F.col("node").alias("a"), F.col("component").alias("one"))
        of_b = pointers.select(F.col("node").alias("b"), F.col("component").alias("two"))
        edges = staged(_links(F.col("one"), F.col("two"), edges.join(of_a, "a").join(of_b, "b")), "links")
        if edges.isEmpty():
            return staged(labels, "labels")
