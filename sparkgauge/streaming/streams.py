"""Structured Streaming counterparts of the record log: append, resume, keep-best, two sinks, and event-time windows.

Every function takes a streaming DataFrame and returns one, or starts a query over what is available and waits for it.
Sinks and checkpoints lie in the folder the session names, so a restarted driver goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def read_log(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream, with the schema it has now.

    The stream source takes a lone file only by a pattern, so the last letter becomes one.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def append_all(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Write what is available to an append-only Parquet sink."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available and read its sink back."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    append_all(stream, path)
    return spark.read.schema(stream.schema).parquet(path)


def drain_last(stream: DataFrame, name: str, keys: list[str], version: str) -> DataFrame:
    """Run an update-mode stream; the sink gets every version of a key, and that of the last batch is returned."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a batch that is run again replaces itself

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    rows = spark.read.parquet(f"{path}/batch=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch_id", version)).alias("r")).select(*keys, "r.*")


def two_sinks(stream: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
    """Each batch goes to two tables; a batch that is run again replaces its own files."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            first(batch).write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
            second(batch).write.mode("overwrite").parquet(f"{path}/summaries/batch={batch_id}")
        finally:
            batch.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/rows/batch=*"), spark.read.parquet(f"{path}/summaries/batch=*")


def keep_best(stream: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The best row of each key so far by the order, the largest first, emitted whenever its key has new rows (update mode).

    An aggregation that combines before the shuffle, in the JVM. Lateness has no bound, so neither has the state: one row per key.
    """
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best")).select(*keys, "best.*")


def tumbling(stream: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Counts and sums per window of event time."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def sessions(stream: DataFrame, ts: str, gap: str, late: str) -> DataFrame:
    """Sessions of a user: events with no pause longer than gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), "user_id").agg(F.count("*").alias("n"))
