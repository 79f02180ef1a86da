"""Connected components of a link table, by large-star and small-star rounds: a few shuffles each, no group held whole.

A star of very many links has one centre; what its links look up by that centre is a row of the centre's own, so heavy
centres are few rows that are broadcast while all others meet in a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import lookup, materialize


def _least(spark: SparkSession, links: DataFrame) -> DataFrame:
    """a, m (the least b of its links) and n (how many), once per a."""
    return materialize(spark, links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "links-least")


def _round(spark: SparkSession, links: DataFrame, total: int) -> DataFrame:
    """One large-star and one small-star step over links (a > b); keeps components, and flattens them towards their minimum."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(spark, both)
    # large star: every larger neighbour of a moves to the least of a and its neighbours
    moved = lookup(both.where("b > a"), least, "a", "n", 2 * total).select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b")
    large = materialize(spark, moved.union(least.where("a > m").select("a", F.col("m").alias("b"))).distinct(), "links")
    # small star: a and all its smaller neighbours move to the least of these
    low = _least(spark, large)
    moved = lookup(large, low, "a", "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return materialize(spark, moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "links", replaces=large)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b) but the roots; root is the least node of the component.

    Links of a node with itself or with null count for nothing; repeated links are one. An empty table gives no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(spark, links, "links")
    while True:
        # done when every node has one link and no node that others link to has one of its own
        nodes = links.agg(F.count("*").alias("n"), F.countDistinct("a").alias("k")).first()
        if nodes["n"] == nodes["k"] and links.select("b").join(links.select(F.col("a").alias("k")), F.col("b") == F.col("k"), "left_semi").isEmpty():
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links = _round(spark, links, nodes["n"])
