"""Reading and writing record files: tolerant JSON lines, id lists, archives and their census."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType().add("x", "double").add("y", "double")
#: Record fields that readers keep; everything else is never parsed.
ATTEMPT = (
    T.StructType().add("provider", "string").add("model", "string").add("maze", "string").add("trial", "integer").add("shard", "integer").add("run_id", "string").add("timestamp", "string").add("latency_s", "double")
    .add("usage", T.MapType(T.StringType(), T.DoubleType())).add("submission", T.StructType().add("points", T.ArrayType(POINT))).add("reasoning", "string").add("error", "string")
    .add("evaluation", T.StructType().add("success", "boolean").add("schema_valid", "boolean").add("starts_correctly", "boolean").add("ends_correctly", "boolean").add("collision_free", "boolean").add("efficiency_canary", "boolean").add("first_collision", T.StructType().add("segment_index", "integer").add("x_px", "double").add("y_px", "double")))
    .add("derived", T.StructType().add("route_progress", "double").add("failure_category", "string"))
)
TASK_INDEX = T.StructType().add("task_id", "string").add("family", "string").add("tier", "string").add("archetype", "string").add("graph_hash", "string").add("mask_sha256", "string")


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Rows of JSON lines (plain or gzip) with source, and _corrupt_record where a line isn't JSON; blank lines are skipped."""
    text = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source")).where(F.trim("value") != "")
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return text.select("source", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("source", "r.*")


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def census(rows: DataFrame) -> DataFrame:
    """Lines, malformed ones and rows with an error, a trace and an evaluation, per file."""
    ok = F.col("_corrupt_record").isNull()
    has = lambda c: F.count_if(ok & F.col(c).isNotNull())
    return rows.groupBy("source").agg(F.count_if(ok).alias("rows"), F.count_if(~ok).alias("malformed"), F.count_if(ok & (F.coalesce("error", F.lit("")) != "")).alias("errors"), has("reasoning").alias("traces"), has("evaluation").alias("evaluated"), F.sort_array(F.collect_set("provider")).alias("providers"))


def discover(spark: SparkSession, paths: list[str], name: str = "attempts.jsonl") -> list[str]:
    """Files that paths (files, folders or patterns) lead to, sorted: a folder stands for its file of that name, what is missing is dropped. None at all raises."""
    jvm, found = spark.sparkContext._jvm, set()
    for p in paths:
        pattern = jvm.org.apache.hadoop.fs.Path(p)
        fs = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.globStatus(pattern) or []:
            at = status.getPath()
            if status.isDirectory() and not at.getName().endswith(".jsonl"):  # a folder of that kind is a log that Spark has written
                at = jvm.org.apache.hadoop.fs.Path(at, name)
                if not fs.exists(at):
                    continue
            found.add(at.toString())
    if not found:
        raise FileNotFoundError(f"no {name} at {', '.join(paths)}")
    return sorted(found)


def built_splits(spark: SparkSession, root: str) -> list[str]:
    """Sorted names of the folders below root that hold an index.jsonl."""
    try:
        return sorted(p.rsplit("/", 2)[1] for p in discover(spark, [f"{root.rstrip('/')}/*/index.jsonl"]))
    except FileNotFoundError:
        return []


def read_run_config(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(providers: provider, type, model, enabled; default trials) of a run's JSON document; a provider is enabled and there is one trial unless it says otherwise."""
    whole = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small document
    rows = [(name, p.get("type"), p.get("model"), bool(p.get("enabled", True))) for name, p in sorted((whole.get("providers") or {}).items())]
    return spark.createDataFrame(rows, "provider string, type string, model string, enabled boolean"), int(whole.get("trials", 1))


def write_verdicts(verdicts: DataFrame, path: str) -> None:
    """One JSON line per failed row: its key, primary and secondary modes, quotes as evidence, and measures to four places; nulls stay out."""
    measures = F.transform_values("measures", lambda _, v: F.round(v, 4))
    verdicts.withColumn("measures", measures).write.mode("overwrite").json(path)


def write_index(index: DataFrame, path: str, manifest: dict) -> None:
    """A split's index as JSON lines in the order of ids, and beside it (``-manifest``) its build manifest with the number of rows and the sha256 of all hashes."""
    index.orderBy("task_id").write.mode("overwrite").json(path)
    spark = index.sparkSession
    sums = index.agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.sha2(F.col("mask_sha256").cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("hash_sum")).head()
    spark.createDataFrame([(json.dumps(manifest | {"rows": sums.rows, "hash_sum": sums.hash_sum}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-manifest")


def task_documents(worlds: DataFrame, split: str) -> DataFrame:
    """task_id, task and truth (JSON documents) of built worlds: coordinates from 0 to 1 to four places, lengths to two."""
    unit = lambda p: F.struct(F.round(p["x"] / (F.col("w") - 1), 4).alias("x"), F.round(p["y"] / (F.col("h") - 1), 4).alias("y"))
    task_id = F.format_string("%s-%s-s%04d", F.col("family"), F.coalesce("tier", F.lit("any")), F.col("slot"))
    points = F.transform("route", unit)
    task = F.struct(task_id.alias("task_id"), F.lit(split).alias("split"), "family", "tier", "w", "h", F.get(points, F.lit(0)).alias("start"), F.element_at(points, -1).alias("goal"), "mask_sha256", "graph_hash")
    truth = F.struct(task_id.alias("task_id"), F.round("length_px", 2).alias("length_px"), points.alias("points"))
    return worlds.where(F.col("rejection").isNull()).select(task_id.alias("task_id"), F.to_json(task).alias("task"), F.to_json(truth).alias("truth"), "mask", "h", "w")


def write_tasks(documents: DataFrame, path: str) -> None:
    """Task and truth documents as JSON lines in two tables, and masks as a third, so that they are joined by task_id and never listed file by file."""
    documents.select("task").write.mode("overwrite").text(f"{path}/tasks")
    documents.select("truth").write.mode("overwrite").text(f"{path}/truths")
    documents.select("task_id", "mask", "h", "w").write.mode("overwrite").parquet(f"{path}/masks")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task documents joined with their truth and mask."""
    unit = "struct<x:double,y:double>"
    tasks = spark.read.schema(f"task_id string, split string, family string, tier string, w int, h int, start {unit}, goal {unit}, mask_sha256 string, graph_hash string").json(f"{path}/tasks")
    truths = spark.read.schema(f"task_id string, length_px double, points array<{unit}>").json(f"{path}/truths")
    return tasks.join(truths, "task_id").join(spark.read.parquet(f"{path}/masks").select("task_id", "mask"), "task_id")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids by line or comma, trimmed; blanks and parts that begin with # are dropped."""
    parts = spark.read.text(path).select(F.explode(F.split("value", ",")).alias("part"))
    return parts.where((F.trim("part") != "") & ~F.col("part").startswith("#")).select(F.trim("part").alias("id"))


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, leg (the folder below root, _root for none), bytes and sha256 of every file below root. Files are hashed where they are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    top = re.sub(r"^\w+:/+", "/", root.rstrip("/")) + "/"
    relative = F.expr(f"substring(path, locate({json.dumps(top)}, path) + {len(top)})")
    folder = F.regexp_extract(relative, r"^(.*)/[^/]*$", 1)
    return rows.select(relative.alias("path"), F.when(folder == "", "_root").otherwise(folder).alias("leg"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Files that are gone or changed: path, problem."""
    both = recorded.select("path", F.col("sha256").alias("was")).join(found.select("path", F.col("sha256").alias("now")), "path", "left")
    return both.where(F.col("now").isNull() | (F.col("was") != F.col("now"))).select("path", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """8-bit gray PNG masks: path, h, w and their bytes; a pixel above 127 is open."""
    image = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    return image.select(F.col("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.data").alias("gray"))


def write_merged(rows: DataFrame, path: str, order: list[str]) -> None:
    """Ordered JSON lines: files follow each other in the total order, so no single task writes it all."""
    rows.orderBy(*order).write.mode("overwrite").json(path)


def write_archive(rows: DataFrame, path: str) -> None:
    """gzip JSON lines, a folder per provider, counted again after writing."""
    rows.write.mode("overwrite").partitionBy("provider").option("compression", "gzip").json(path)
    if rows.sparkSession.read.text(path, recursiveFileLookup=True).count() != rows.count():
        raise ValueError(f"{path} has other than the rows written")
