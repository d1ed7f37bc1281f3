"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.llm.tables import Scratch


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one root, and no root on another node."""
    ends = edges.select("u", F.lit(1).alias("up")).unionByName(
        edges.select(F.col("v").alias("u"), F.lit(None).cast("int").alias("up")))
    counts = ends.groupBy("u").agg(F.count("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return counts.where("up > 1 or up = 1 and n > 1").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for all nodes of links (a, b).

    Alternates two rewritings of the links until each node hangs on its root:
    first every node ties its larger neighbours to its smallest one, then its
    smaller neighbours. The number of rounds grows with the logarithm of the
    longest path, each is a few grouped passes over the links, and its result
    is written, so lineage stays short. Each shuffle costs the driver a thread and
    plans besides, so a round has as few as it can, and none only confirms the last.
    Repeated links need none either: the first round makes them distinct.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    turn = 0
    while True:
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = edges.unionByName(larger).groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        # Repeated rows, no more than there are links, go with those of the second rewriting.
        large = larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = scratch.write(small, f"{name}-{turn}")
        if turn:
            scratch.drop(f"{name}-{turn - 1}")
        if _are_stars(edges):
            break
        turn += 1
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.unionByName(own)
