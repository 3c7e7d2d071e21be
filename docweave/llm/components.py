"""Connected components of a graph given by its links, as rounds of joins on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, store


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node with a link in ``links(a, b)``: the smallest node it can reach.

    Two kinds of step take turns until neither changes a link. In the large-star step every node links its larger
    neighbours to its smallest neighbour; in the small-star step a node links its smaller neighbours and itself to the
    smallest one. Links become trees of depth one in about log(nodes) rounds. A step is one aggregation, of which tasks
    reduce their rows first, and one join that run-time re-planning can split; every step's links are a stored table,
    so that nothing is collected and a lost executor costs one step.
    """
    spark = links.sparkSession
    edges, path = store(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        starred, large_path = store(large.filter("a != b").distinct())
        least = starred.groupBy("a").agg(F.min("b").alias("m"))
        small = starred.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(least.select("a", F.col("m").alias("b"))).distinct()
        edges, small_path = store(small)
        forget(spark, path, large_path)
        path = small_path
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
