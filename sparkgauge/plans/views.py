"""Views that give the star-schema tables the shape of evaluation records.

A row of lineitem is an attempt: provider and task come from its keys, its flags say whether it was evaluated, succeeded
or failed in transport. part gives the tasks, embeddings the polylines. The SQL_* texts are the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import Fold, segmented_scan

PROVIDERS, TASKS = 7, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per attempt. Catalyst prunes the columns a query doesn't use down to the scan."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % PROVIDERS).alias("provider"), (F.col("l_partkey") % TASKS).alias("task_id"),
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_suppkey").alias("shard"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("latency_s"), (F.col("l_quantity") * 100).cast("long").alias("tokens_in"), F.col("l_extendedprice").cast("long").alias("tokens_out"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        (status == "F").alias("evaluated"), ((status == "F") & (flag == "R")).alias("success"), ((flag == "N") & (status == "O")).alias("has_error"), flag.alias("flag"),
    )


SQL_ATTEMPTS = """attempts AS (SELECT l_suppkey % 7 AS provider, l_partkey % 100 AS task_id, l_orderkey AS run, l_linenumber::BIGINT AS line, l_suppkey AS shard, l_partkey AS part, l_extendedprice AS price,
    l_quantity AS latency_s, trunc(l_quantity * 100)::BIGINT AS tokens_in, trunc(l_extendedprice)::BIGINT AS tokens_out, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ts,
    l_linestatus = 'F' AS evaluated, l_linestatus = 'F' AND l_returnflag = 'R' AS success, l_returnflag = 'N' AND l_linestatus = 'O' AS has_error, l_returnflag AS flag FROM lineitem)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task dimension: at most TASKS rows, so joins to it may always broadcast it."""
    size = F.col("p_size")
    tier = F.when(size <= 16, "easy").when(size <= 33, "medium").otherwise("hard")
    return table(spark, sf_dir, "part").where(F.col("p_partkey") < TASKS).select(F.col("p_partkey").alias("task_id"), tier.alias("tier"), F.col("p_type").alias("family"), F.col("p_brand").alias("archetype"), F.col("p_name").alias("task_name"), size.cast("long").alias("size"), F.col("p_retailprice").alias("length_px"))


SQL_TASKS = """tasks AS (SELECT p_partkey AS task_id, CASE WHEN p_size <= 16 THEN 'easy' WHEN p_size <= 33 THEN 'medium' ELSE 'hard' END AS tier, p_type AS family, p_brand AS archetype, p_name AS task_name, p_size::BIGINT AS size, p_retailprice AS length_px FROM part WHERE p_partkey < 100)"""


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and a polyline of 32 pixel points: pts array<struct<x, y>>."""
    at = lambda i: F.lit(100.0) + F.lit(400.0) * F.col("embedding")[i].cast("double")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: point(at(i * 2), at(i * 2 + 1)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), pts.alias("pts"))


#: The points as rows: vec_id, i (from 0), x, y.
SQL_POINTS = """points AS (SELECT vec_id, i, 100.0::DOUBLE + 400.0::DOUBLE * embedding[2 * i + 1]::DOUBLE AS x, 100.0::DOUBLE + 400.0::DOUBLE * embedding[2 * i + 2]::DOUBLE AS y FROM embeddings, (SELECT unnest(range(0, 32)) AS i) n)"""


def trials(rows: DataFrame) -> DataFrame:
    """attempts with trial, dense from 0 within provider and task."""
    numbered = segmented_scan(rows, ["provider", "task_id"], ["run", "line", "part", "shard", "price"], {"trial": Fold(F.lit(1).cast("long"))})
    return numbered.withColumn("trial", F.col("trial") - 1)


SQL_TRIALS = "trials AS (SELECT *, row_number() OVER (PARTITION BY provider, task_id ORDER BY run, line, part, shard, price) - 1 AS trial FROM attempts)"
