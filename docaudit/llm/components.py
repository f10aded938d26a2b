"""Connected components of a graph given as a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import spread_join, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; the root is the smallest node that can be reached.

    Alternates two steps until nothing changes, each a minimum per node and one join: every node
    hands its larger neighbours, then its smaller ones, to the smallest of them. The number of
    rounds grows with the logarithm of the graph; each round is written to the shared folder. Links
    from a node to itself, null ends and repeated links are ignored. No links give no rows.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = written(links.filter(F.col(a) != F.col(b)).select(u, v).distinct(), "links")
    before = None
    while True:
        size, total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == 0 or (size, total) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v"), F.col("v")).distinct())
        before = size, total
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = spread_join(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, ["u"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least).distinct(), "links")
