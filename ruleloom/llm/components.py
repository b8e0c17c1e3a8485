"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every neighbour larger than u on the least node around u."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang u and its smaller neighbours on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionAll(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): for every node that has a link, the least node it is connected with.

    Rows with a null end and links of a node to itself do not count, repeated links
    count once; no link gives an empty table. Each round is a handful of aggregations and joins
    whose rows stay in proportion to the links, and the number of rounds grows with the
    logarithm of the nodes; a node with very many links is a skewed join key, which Spark
    splits. Every round is written to the shared folder.
    """
    bigger, smaller = F.greatest(left, right), F.least(left, right)
    edges = cut_lineage(links.where(F.col(left) != F.col(right)).select(bigger.alias("u"), smaller.alias("v")).distinct())
    seen = None
    while True:
        edges = cut_lineage(_small_star(_large_star(edges)).where("u != v").distinct())
        # Both steps only ever lower what a node hangs on; nothing changes any more once
        # the hashes of all rows add up to the same as before.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
