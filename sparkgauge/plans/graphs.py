"""Graph queries, on a graph of suppliers: a chain with gaps and a chord from every node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .registry import query
from .views import table

SQL_EDGES = """edges AS (SELECT s_suppkey AS a, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS b, round(1 + abs(s_acctbal) / 1000, 3) AS w FROM supplier WHERE s_suppkey % 3 > 0
    UNION ALL SELECT s_suppkey, s_suppkey + 1, 2.5::DOUBLE FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey + 1 < (SELECT count(*) FROM supplier)),
    adj AS (SELECT a AS node, b AS neighbour, w FROM edges UNION ALL SELECT b, a, w FROM edges)"""
SQL_BFS = f"WITH RECURSIVE {SQL_EDGES}, walk(node, depth) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT a.neighbour, depth + 1 FROM walk JOIN adj a USING (node) WHERE depth < 24), bfs AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), "s_acctbal")
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    s = s.crossJoin(F.broadcast(n))  # one row
    chords = s.where(F.col("a") % 3 > 0).select("a", ((F.col("a") * 7 + 3) % F.col("n")).alias("b"), F.round(1 + F.abs("s_acctbal") / 1000, 3).alias("w"))
    chain = s.where((F.col("a") % 5 > 0) & (F.col("a") + 1 < F.col("n"))).select("a", (F.col("a") + 1).alias("b"), F.lit(2.5).alias("w"))
    return chords.unionByName(chain)


@query(f"WITH {SQL_EDGES} SELECT node, neighbour, w FROM adj")
def graph_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(edges(spark, sf))


@query(f"WITH {SQL_EDGES} SELECT node, count(*) AS degree FROM adj GROUP BY 1 HAVING count(*) >= 3")
def graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(edges(spark, sf)).where(F.col("degree") >= 3)


@query(SQL_BFS + " SELECT node, depth FROM bfs")
def graph_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(edges(spark, sf), 1)


@query(SQL_BFS + " SELECT min(node) AS node, max(depth) AS depth FROM bfs WHERE depth = (SELECT max(depth) FROM bfs)")
def graph_farthest(spark: SparkSession, sf: str) -> DataFrame:
    """The farthest node, the smallest of equals."""
    return graph.bfs(edges(spark, sf), 1).agg(F.max(F.struct("depth", (-F.col("node")).alias("n"))).alias("m")).select((-F.col("m.n")).alias("node"), F.col("m.depth").alias("depth"))


@query(SQL_BFS + " SELECT (SELECT count(*) FROM bfs) AS reached, (SELECT count(*) FROM supplier) AS nodes, (SELECT count(*) FROM bfs) = (SELECT count(*) FROM supplier) AS connected")
def graph_connected(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connected(edges(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")), 1)


@query()
def graph_dijkstra(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest routes from node 1."""
    return graph.shortest(edges(spark, sf), 1).select("node", F.round("dist", 6).alias("dist"))


@query(f"WITH {SQL_EDGES}, light AS (SELECT node, neighbour, min(w) AS w FROM adj GROUP BY ALL), r AS (SELECT s_suppkey // 5 AS route_id, s_suppkey AS node, lead(s_suppkey) OVER (PARTITION BY s_suppkey // 5 ORDER BY s_suppkey) AS next FROM supplier WHERE s_suppkey % 5 > 0) SELECT route_id, round(sum(w), 6) AS length FROM r JOIN light ON light.node = r.node AND light.neighbour = r.next GROUP BY 1")
def graph_route_length(spark: SparkSession, sf: str) -> DataFrame:
    route = table(spark, sf, "supplier").where(F.col("s_suppkey") % 5 > 0).select(F.floor(F.col("s_suppkey") / 5).alias("route_id"), F.col("s_suppkey").alias("at"), F.col("s_suppkey").alias("node"))
    return graph.route_length(edges(spark, sf), route).select("route_id", F.round("length", 6).alias("length"))


def _sql_wl(n: int) -> str:
    steps = ["l0 AS (SELECT node, count(*)::VARCHAR AS label FROM adj GROUP BY 1)"]
    for i in range(n):
        steps.append(f"l{i + 1} AS (SELECT l.node, substr(sha256(any_value(l.label) || '|' || string_agg(m.label, ',' ORDER BY m.label)), 1, 12) AS label FROM l{i} l JOIN adj a ON a.node = l.node JOIN l{i} m ON m.node = a.neighbour GROUP BY l.node)")
    return ", ".join(steps)


@query(f"WITH {SQL_EDGES}, {_sql_wl(3)} SELECT node, label FROM l3")
def wl_hash(spark: SparkSession, sf: str) -> DataFrame:
    return graph.wl_labels(edges(spark, sf))
