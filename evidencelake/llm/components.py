"""Connected components of an edge table, in rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencelake.session import materialise



def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs, or of any type that has an order: (node, label) for every node, label being the smallest node of its component.

    Large-star and small-star rounds by turns: each node's larger, then its smaller neighbours are hung onto the smallest one, until nothing
    changes (a number of rounds that grows with the logarithm of the component sizes). Minima are reduced before the shuffle, so a node with
    very many edges is no hot spot; each round is written to the shared folder.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = materialise(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(smallest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(hung.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
