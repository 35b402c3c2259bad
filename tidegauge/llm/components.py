"""Connected components of a link table by contraction: every node becomes its smallest neighbour, again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import cut, drop


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, for every id of ``links`` (a, b). No links give no rows.

    A round maps each node to the least of itself and its neighbours and rewrites the links; those inside a node
    vanish, so stars go in one round and chains in a logarithm of their length. What a round leaves is written to the
    shared folder. Sums are partial before they are shuffled; joins on a hub are ones that Spark may split.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("to")), "least")
        before = [edges, least]
        if labels is None:
            labels = cut(least.select(F.col("node").alias("id"), F.col("to").alias("component")), "labels")
        else:
            moved = least.where("node <> to")
            before.append(labels)
            labels = cut(labels.join(moved, labels["component"] == moved["node"], "left").select("id", F.coalesce("to", "component").alias("component")), "labels")
        first = edges.join(least.withColumnsRenamed({"node": "a", "to": "x"}), "a")
        second = first.join(least.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        edges = cut(second.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        drop(*before)
    if labels is None:
        out = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        out.cut_folder = edges.cut_folder
        return out
    drop(edges)
    return labels
