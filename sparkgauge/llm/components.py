"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lookup, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b: not null longs); component is its smallest node.

    Rounds of two steps until nothing changes: every node's larger neighbours are linked to the smallest of
    its neighbours and itself, then so are its smaller ones. A node's minimum is combined before the shuffle and brought to its links by
    lookup(), so no task gathers the links of a hub; each round is written out, so a lost executor costs a round at most. An empty table gives no rows.
    """
    links = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n")), "lowest")
        far = lookup(both.where(F.col("b") > F.col("a")), low, ["a"], "n", how="inner").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(far.distinct(), "links")
        discard(low, collect=False)
        low = materialize(large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), "lowest")
        near = lookup(large, low, ["a"], "n", how="inner").select(F.col("b").alias("a"), F.col("low").alias("b")).where(F.col("a") != F.col("b"))
        small = materialize(near.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "links")
        discard(large, collect=False)
        # done when both tables have the same rows: then every link is a node's link to its component
        done = _print(small) == _print(links)
        discard(links, collect=False)
        if done:
            discard(small, collect=False)
            break
        discard(low, collect=False)
        links = small
    return low.select(F.col("a").alias("node"), F.col("low").alias("component")).unionByName(low.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())


def _print(links: DataFrame) -> tuple:
    """Number of rows and two sums of their hashes."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h).cast("decimal(38,0)"))).head())
