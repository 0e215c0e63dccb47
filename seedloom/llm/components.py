"""Connected components of a link table by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b); the root is the component's smallest node.

    Each round links a node's larger neighbours, then its smaller ones, to its smallest neighbour, and checkpoints; it
    ends when a round changes nothing. Minima are aggregated before they are shuffled.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    pairs = checkpointed(pairs)
    state = None
    while True:
        print_of = pairs.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if state == (print_of.n, print_of.h) or not print_of.n:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = (print_of.n, print_of.h)
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpointed(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
