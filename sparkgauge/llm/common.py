"""Shared plumbing: scratch tables in the cluster's shared folder, and joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the number of heavy keys that are broadcast; between them it is that of the shuffle partitions.
LEAST_HEAVY, MOST_HEAVY = 1024, 16384
#: Tables of the catalog that operators make have names of these kinds, and 32 hexadecimal digits.
TABLES = ("digest_index_", "warc_payloads_")


def heavy_share(spark: SparkSession) -> int:
    """A key is heavy when it owns more than one row in this many; so there are fewer heavy keys than this, and no other key exceeds a mean partition."""
    return min(MOST_HEAVY, max(LEAST_HEAVY, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or the context's checkpoint folder. A local session without either has one of its own."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or spark.conf.get("spark.sparkgauge.scratch", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkgauge-")
        spark.conf.set("spark.sparkgauge.scratch", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame, collect: bool = True) -> None:
    """Delete tables that materialize() wrote and nothing reads any more; the driver's garbage collection lets Spark drop finished shuffles."""
    jvm = SparkSession.active().sparkContext._jvm
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI.create(folder))
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if collect:
        jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of the operators once their results have been consumed, and tables that failed jobs have left in the catalog."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(path) if fs.exists(path) else []:
        name = status.getPath().getName()
        if len(name) > 33 and name[-33] == "-" and all(c in "0123456789abcdef" for c in name[-32:]):
            fs.delete(status.getPath(), True)
    for table in spark.catalog.listTables():
        if re.fullmatch(f"({'|'.join(TABLES)})[0-9a-f]{{32}}", table.name):
            spark.sql(f"DROP TABLE {table.name}")


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, how: str = "left") -> DataFrame:
    """rows joined with groups (left or inner), which has one row per key and in ``count`` the rows of that key.

    A key with more than 1 / heavy_share() of all rows would land in one task. There are fewer than
    heavy_share() such keys whatever the input, so these few groups are broadcast, and their rows
    never move. The remaining rows meet their groups in a sort-merge join, where no key is large.
    Every row takes one of the two ways; null keys match each other.
    ``groups`` should be a materialized table, as it is read three times.
    """
    limit = groups.agg((F.coalesce(F.sum(count), F.lit(0)) / heavy_share(rows.sparkSession)).cast("long").alias("__limit"))
    sized = groups.crossJoin(F.broadcast(limit))  # one row
    gained = [c for c in groups.columns if c not in keys]
    renamed = [F.col(c).alias(f"__g_{c}") for c in keys]
    heavy = sized.where(F.col(count) > F.col("__limit")).select(*renamed, *gained)
    light = sized.where(F.col(count) <= F.col("__limit")).select(*renamed, *gained)
    on = _same(keys)
    done = rows.join(F.broadcast(heavy), on).select(*rows.columns, *gained)
    rest = rows.join(F.broadcast(heavy.select([f"__g_{c}" for c in keys])), on, "left_anti")
    return done.unionByName(rest.join(light, on, how).select(*rows.columns, *gained))


def keep_rows(docs: DataFrame, decided: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of docs that decided keeps, with their own columns.

    keys gives, for columns of decided, their expressions on docs; decided has a row with ``kept`` for each row of docs.
    Where several rows of docs have equal keys, and so equal ids and texts, one of them stays.
    """
    flags = decided.groupBy(*[F.col(c).alias(f"__g_{c}") for c in keys]).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    flags = materialize(flags.where("__kept").drop("__kept"), "kept")
    cond = F.lit(True)
    for c, expr in keys.items():
        cond = cond & expr.eqNullSafe(F.col(f"__g_{c}"))
    met = docs.join(flags, cond)
    if flags.where(F.col("__n") > 1).isEmpty():
        return met.select(*docs.columns)
    single = met.where(F.col("__n") == 1).select(*docs.columns)
    return single.unionByName(met.where(F.col("__n") > 1).dropDuplicates([f"__g_{c}" for c in keys]).select(*docs.columns))


def _same(keys: list[str]) -> Column:
    cond = F.lit(True)
    for c in keys:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return cond
