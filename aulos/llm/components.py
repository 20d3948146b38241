"""Distributed union-find: connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aulos.llm.shared import materialize, release


def connected_components(links: DataFrame, tag: str = "links") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b long); root is its component's smallest node.

    Every round hangs the larger neighbours of each node, then its smaller ones, below the
    smallest node it sees; the loop ends when a round changes nothing. All rounds are
    aggregations with partial sums and joins that adaptive execution can split, and each round's
    links are files in the shared folder.
    """
    spark = links.sparkSession
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, tag)

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), tag)
        large = materialize(both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), tag)
        down = large.filter("v < u")
        least2 = materialize(down.groupBy("u").agg(F.min("v").alias("m")), tag)
        hung = down.join(least2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = least2.select("u", F.col("m").alias("v"))
        after = materialize(small.unionByName(hung).distinct(), tag)
        for old in (edges, least, large, least2):
            release(old)
        edges, now = after, mark(after)
        if now == seen:
            break
        seen = now
    if not seen[0]:
        return spark.createDataFrame([], "node long, root long")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
