"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a Spark table bucketed and sorted by SHA-256 of the normalised text. Its files lie in a folder of their own that all
executors share, and its name tells their buckets, so a later session opens them without the first one's catalog. A batch is
reduced to one row per digest, joined to the index bucket by bucket (sort-merge, and the index side needs no
exchange), and the digests that are new are appended, clustered by bucket, so a batch adds one file to each. Spark trusts a
bucket's order only where the bucket is one file: with several batches it sorts each bucket again when it is read.
compact() makes the buckets one sorted file each.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, lookup, materialize, shared_dir


def normalise(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalise(text).cast("binary"), 256)


class DigestIndex:
    """A table (text_sha256, keep_id) with one row per text that was ever kept.

    The files of a generation lie in ``path/<number>-<buckets>-<type of ids>``; compact() starts the next. Opening a path that
    has a generation goes on with it, whatever session wrote it. ``add`` is idempotent: a batch that is added twice, or again
    after a failure, decides alike, since a document whose own id the index holds stays. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.number, self.table = 0, None
        for name in sorted(self._generations()):
            number, n, kind = name.split("-", 2)
            self.buckets, self.number = int(n), int(number)
            self._register(kind)

    @classmethod
    def fresh(cls, spark: SparkSession, buckets: int | None = None) -> DigestIndex:
        """An empty index in a new folder of the scratch folder."""
        return cls(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets)

    def _folder(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _generations(self) -> list[str]:
        """Names of the generations that were written to the end."""
        fs, path = self._folder()
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return [n for n in names if re.fullmatch(r"\d{6}-\d+-\w+", n) and fs.exists(self._below(path, f"{n}/_SUCCESS"))]

    def _below(self, path, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, name)

    def _register(self, kind: str) -> None:
        """A table of this session's catalog over the files of the generation; bucket numbers are in the files' names."""
        self.table, place = f"digest_index_{uuid.uuid4().hex}", f"{self.path}/{self.number:06}-{self.buckets}-{kind}"
        self.spark.sql(f"CREATE TABLE {self.table} (text_sha256 STRING, keep_id {kind}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def exists(self) -> bool:
        return self.table is not None

    def close(self) -> None:
        """Take the table out of the catalog; its files stay."""
        if self.exists():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
            self.table = None

    def drop(self) -> None:
        """Delete the index."""
        self.close()
        fs, path = self._folder()
        fs.delete(path, True)

    def _append(self, rows: DataFrame) -> None:
        """Append rows, each bucket by the one task that has all of it: one more file, sorted, for each bucket."""
        if not self.exists():
            self.number += 1
            self._register(rows.schema["keep_id"].dataType.simpleString())
        writer = rows.repartition(self.buckets, "text_sha256").write.mode("append").format("parquet")
        writer.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.table)

    def compact(self) -> None:
        """Write the index anew as the next generation, one sorted file to a bucket, and delete the old one. An index that doesn't exist stays so."""
        if self.exists():
            old, self.table = self.table, None
            # a new expression, as Spark would take the old table's buckets for clustered and then read them in any order
            self._append(self.spark.table(old).withColumn("text_sha256", F.substring("text_sha256", 1, 64)))
            self.spark.sql(f"DROP TABLE {old}")
            fs, path = self._folder()
            for name in self._generations():
                if int(name[:6]) < self.number:
                    fs.delete(self._below(path, name), True)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decide on a batch and append its new digests.

        Returns one row per row of docs: doc_id, keep_id (id that stays: the index's, else the
        smallest of the batch), group_size (rows of the batch with this text), kept, text_sha256,
        and row_uid, a unique number in this batch. Of repeated rows with one id, one stays. A null
        id is larger than any other and stays only where its text has no other. Null text is empty text. An
        empty batch gives no rows. Other columns of docs are ignored, whatever their names.
        """
        hashed = materialize(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row_uid")), "digests")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_uid"))
        batch = materialize(hashed.groupBy("text_sha256").agg(first.alias("first"), F.count("*").alias("group_size")), "digest-groups")
        if not self.exists():
            self._append(batch.select("text_sha256", F.col("first.doc_id").alias("keep_id")).limit(0))
        known = self.spark.table(self.table)
        fresh = batch.join(known, "text_sha256", "left_anti")
        fresh_now = materialize(fresh.select("text_sha256", F.col("first.doc_id").alias("keep_id")), "digest-new")
        self._append(fresh_now)
        groups = batch.join(self.spark.table(self.table), "text_sha256", "left").select("text_sha256", "keep_id", "group_size", F.col("first.row_uid").alias("keep_uid"), F.col("first.doc_id").eqNullSafe(F.col("keep_id")).alias("here"))
        decided = lookup(hashed, materialize(groups, "digest-decisions"), ["text_sha256"], "group_size")
        return decided.select("doc_id", "keep_id", "group_size", (F.col("here") & (F.col("row_uid") == F.col("keep_uid"))).alias("kept"), "text_sha256", "row_uid")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """Decisions for all docs, against the index if one is given, else against a fresh one that is dropped again. See DigestIndex.add."""
    if index:
        return index.add(docs)
    index = DigestIndex.fresh(docs.sparkSession)
    decided = index.add(docs)  # written out but for a last join, which doesn't read the index
    index.drop()
    return decided


def dedup_in_batches(docs: DataFrame, edges: list[int], index: DigestIndex | None = None) -> DataFrame:
    """Decisions for all docs, added to one index in batches: doc_ids up to the first edge, then up to the next, and the rest (null ids too).

    As a batch has larger ids than those before it, the smallest doc_id of a text stays, and the decisions are those of a single batch.
    group_size counts all rows of docs. row_uid is unique. Edges must ascend; a batch may be empty, and so may docs.
    """
    spark = docs.sparkSession
    held = index or DigestIndex.fresh(spark)
    low, parts = None, []
    for high in [*edges, None]:
        inside = F.lit(True) if low is None else F.col("doc_id") > low
        rest = F.lit(True) if high is None else F.col("doc_id") <= high
        batch = docs.where(F.coalesce(inside & rest, F.lit(high is None)))
        parts.append(materialize(held.add(batch).withColumn("row_uid", F.struct(F.lit(len(parts)).alias("batch"), "row_uid")), "batch-decisions"))
        low = high
    if index is None:
        held.drop()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    sizes = materialize(every.groupBy("text_sha256").agg(F.count("*").alias("total")), "group-sizes")
    return lookup(every, sizes, ["text_sha256"], "total").withColumn("group_size", F.col("total")).drop("total")


def middle_id(docs: DataFrame) -> int:
    """The middle of the least and the largest doc_id; 0 where there is none."""
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).head()
    return 0 if ends.low is None else (ends.low + ends.high) // 2


def distinct_documents(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with their own columns: of equal texts the smallest doc_id, of equal rows one, null text as empty text.

    A null doc_id stays only where its text has no other. An empty table gives none.
    """
    return keep_rows(docs, exact_dedup(docs, index), {"doc_id": F.col("doc_id"), "text_sha256": digest(F.col("text"))})
