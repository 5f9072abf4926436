"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import WorkFolder


def components(links: DataFrame, work: WorkFolder, name: str) -> DataFrame:
    """node, root (the least node that links reach) of each node of ``links`` (a, b: whole numbers).

    Each round joins every node's larger neighbours, then its smaller ones, to its least neighbour; a logarithmic
    number of rounds leaves one star per component. Rounds only take minima per node, which are summed up before
    the shuffle; the edges of a hub are matched with its one minimum by a join that adaptive execution splits.
    Every round is a written table, so that lost executors cost a round at most. Joins are by shuffle: a written table's
    rows take many times the memory of its files, by whose size the planner would broadcast them.
    """
    edges = work.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}-0")
    state, k = None, 0
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state, k = found, k + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = work.table(both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        edges = work.table(small.filter("u != v").distinct(), f"{name}-{k}")
        work.drop(f"{name}-{k - 1}", f"{name}-{k}-large")
