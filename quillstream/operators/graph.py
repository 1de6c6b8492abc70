"""Connected components of links, by alternating large-star and small-star rounds on checkpointed tables.

A round is an aggregation and a join; no node's neighbours are gathered in one row, and the rounds grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.session import checkpointed


def _ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(links: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least of itself and all neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _ordered(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small(links: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return _ordered(links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b); the root is the least node of the component. Nulls link nothing."""
    state, links = None, checkpointed(_ordered(links.where("a IS NOT NULL AND b IS NOT NULL")))
    while True:
        links = checkpointed(_small(_large(links)))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        state = now
