"""Connected components of a link table by alternating large-star and small-star passes, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm._common import dropped, saved


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links of long ids -> (node, component): the smallest id reachable, for each id that has a link.

    Null ids, self links and repeated links have no effect. No pass gathers a node's links in one
    task: a pass takes the smallest neighbour by a partial aggregate and joins it back, and AQE may
    split a hot node in that join. Passes end when the set of links no longer changes.
    """
    a, b = F.col("a"), F.col("b")
    edges = saved(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    before = None
    while True:
        # Large star: each larger neighbour is moved to the node's smallest neighbour, itself included.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours are moved to the smallest of them.
        down = large.where(a != b).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(b.alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = saved(small.where(a != b).distinct(), name)
        dropped(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
