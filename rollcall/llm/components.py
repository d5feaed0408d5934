"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import discard, hold


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``); root is the smallest node of its component.

    Only minima per node are aggregated and joined, so a node with very many
    links is never gathered.  The state is written between rounds; the number
    of rounds grows with the logarithm of the size, ``rounds`` only guards
    against an endless loop (it raises, it does not cut).
    """
    edges = hold(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        # every node keeps its own minimum, so none falls out
        large = large.unionByName(least.filter("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        large = hold(large, "stars")
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u"))
        small = small.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        done = hold(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
        # finished when every node points at one root and no root points on
        several = done.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        onward = 0 if several else done.join(done.select(F.col("a").alias("r")), F.col("b") == F.col("r"), "left_semi").limit(1).count()
        discard(edges, large)
        edges = done
        if not several and not onward:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError("components did not settle")
