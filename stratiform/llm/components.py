"""Connected components of a table of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratiform.session import stage


def _rank(column: str):
    """A fixed random order of nodes: chains contract by a constant share in every round."""
    return F.struct(F.xxhash64(F.lit(3), column).alias("order"), F.col(column).alias("node"))


def components(links: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of ``links`` (a, b).

    In each round a node goes to the first of its neighbours and itself in a random order;
    links between nodes that went to the same place vanish, the others go on between the
    places. Rounds grow with the logarithm of the nodes. Neighbours are only reduced to
    their first, never gathered, so a node may have any number of links. Every round is a
    written table. Null ends are not links; a link of a node to itself makes it a component.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = stage(links.select("a", "b").distinct(), "links")
    places = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    places = places.withColumn("place", F.col("node"))
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        first = both.groupBy("a").agg(F.min(_rank("b")).alias("near"))
        first = stage(
            first.select(F.col("a").alias("from"), F.least(F.col("near"), _rank("a"))["node"].alias("to")), "first"
        )
        left = first.select(F.col("from").alias("a"), F.col("to").alias("to_a"))
        right = first.select(F.col("from").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(left, "a").join(right, "b").where("to_a <> to_b")
        edges = stage(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
        places = places.join(first, places["place"] == first["from"], "left")
        places = stage(places.select("node", F.coalesce("to", "place").alias("place")), "places")
    least = places.groupBy("place").agg(F.min("node").alias("component"))
    return stage(places.join(least, "place").select("node", "component"), "components")
