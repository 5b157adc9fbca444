"""Undirected weighted graphs as edge tables (a, b, w).

Traversals advance a whole frontier per round, join by join, and each round is written out; so a graph may be as
large as a table. A round's new labels are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: node, neighbour, w; parallel edges stay."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "w").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("neighbour"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("node").agg(F.count("*").alias("degree"))


def bfs(edges: DataFrame, start: int) -> DataFrame:
    """Hops from start to every node it reaches: node, depth."""
    links = cut(adjacency(edges).select("node", "neighbour").distinct(), "links")
    seen = cut(edges.sparkSession.createDataFrame([(start, 0)], "node long, depth long"), "seen")
    frontier = seen
    while True:
        found = frontier.join(links, "node").select(F.col("neighbour").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = cut(found.join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier), "seen")


def shortest(edges: DataFrame, start: int, slack: float = 1e-12) -> DataFrame:
    """Length of the shortest route from start to every node it reaches: node, dist. Only nodes that improved push on."""
    links = cut(adjacency(edges).groupBy("node", "neighbour").agg(F.min("w").alias("w")), "links")
    best = cut(edges.sparkSession.createDataFrame([(start, 0.0)], "node long, dist double"), "best")
    active = best
    while True:
        offers = active.join(links, "node").groupBy(F.col("neighbour").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        better = offers.join(best, "node", "left").where(F.col("dist").isNull() | (F.col("offer") < F.col("dist") - slack))
        active = cut(better.select("node", F.col("offer").alias("dist")), "active")
        if active.isEmpty():
            return best
        best = cut(best.unionByName(active).groupBy("node").agg(F.min("dist").alias("dist")), "best")


def connected(edges: DataFrame, nodes: DataFrame, start: int) -> DataFrame:
    """One row: reached, nodes, connected (false without nodes)."""
    every = nodes.agg(F.count("*").alias("nodes"))
    return bfs(edges, start).join(nodes, "node", "left_semi").agg(F.count("*").alias("reached")).crossJoin(every).withColumn("connected", (F.col("nodes") > 0) & (F.col("reached") == F.col("nodes")))


def route_length(edges: DataFrame, route: DataFrame) -> DataFrame:
    """Length of routes (route_id, at, node) by the lightest of parallel edges; a step that is no edge stops the job."""
    from pyspark.sql.window import Window

    light = adjacency(edges).groupBy("node", F.col("neighbour").alias("next")).agg(F.min("w").alias("w"))
    steps = route.withColumn("next", F.lead("node").over(Window.partitionBy("route_id").orderBy("at"))).where(F.col("next").isNotNull())
    w = F.coalesce("w", F.raise_error(F.lit("a step of the route is no edge")).cast("double"))
    return steps.join(light, ["node", "next"], "left").groupBy("route_id").agg(F.sum(w).alias("length"))


def wl_labels(edges: DataFrame, rounds: int = 3, digits: int = 12) -> DataFrame:
    """Weisfeiler-Lehman labels: degree, then hashes of the own and the sorted neighbours' labels. node, label."""
    links = cut(adjacency(edges).select("node", "neighbour"), "links")
    labels = links.groupBy("node").agg(F.count("*").cast("string").alias("label"))
    for _ in range(rounds):
        around = links.join(labels.withColumnsRenamed({"node": "neighbour", "label": "near"}), "neighbour").groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("near")), ",").alias("near"))
        text = F.concat("label", F.lit("|"), "near")
        labels = cut(labels.join(around, "node").select("node", F.substring(F.sha2(text.cast("binary"), 256), 1, digits).alias("label")), "labels")
    return labels
