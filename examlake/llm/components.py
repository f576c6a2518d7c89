"""Connected components of a link table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of links (a, b: long).

    Alternates large and small stars: each node's larger neighbours, then its
    smaller ones, are linked to the least node around it, until nothing changes.
    Minima are aggregated before they are shuffled, so a node with very many
    links is no single task's work; joins on it are split at run time.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(table: DataFrame):
        return table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    n = before[0]
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least", 2 * n)
        large = materialize(both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star", n)
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "small", n)
        linked = large.join(down, "u")
        small = linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = materialize(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", n)
        discard(edges, least, large, down)
        edges = after
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
