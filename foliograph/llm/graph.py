"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge (a, b); a component is named by its smallest node.

    Labels spread to neighbours and are then replaced by their own label's
    label, until none changes; every round is stored in the shared folder. No
    edge list or label ever reaches the driver, and a hot node's edges are
    reduced before they are shuffled or split by the adaptive skew join.

    Defined results: edges from a node to itself name no end; repeated edges
    count once; edges with a null end are left out; no edges give an empty table.
    The result is stored; its stored_at names where, for textops.discard().
    """
    both = T.stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = T.stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        was = labels.select("node", "component")
        near = both.join(was, both.b == was.node).groupBy("a").agg(F.min("component").alias("low"))
        low = was.join(near, was.node == near.a).select("node", F.least("component", "low").alias("to"), F.col("component").alias("was"))
        other = was.select(F.col("node").alias("via"), F.col("component").alias("beyond"))
        jumped = low.join(other, F.col("to") == F.col("via"), "left").select("node", F.least(F.col("to"), F.coalesce("beyond", "to")).alias("component"), F.col("was"))
        new = T.stored(jumped, "labels")
        T.discard(labels)
        if new.where("component != was").isEmpty():
            T.discard(both)
            named = new.drop("was")
            named.stored_at = new.stored_at
            return named
        labels = new
