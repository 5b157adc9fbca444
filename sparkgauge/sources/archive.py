"""Archives of runs: compressed copies of attempt logs at any depth, chained digests that prove what they hold, a manifest, and a report that compares both with the live files.

A leg is the folder of a log, as its whole path below the root: sharded runs share folder names, so a name alone would let one
copy replace another. Lines keep their places. Every BLOCK lines of a leg have a digest, made by any task, and the digests
are chained in order: equal chains mean equal lines in equal order, and where the first block differs tells where a log was
changed. So it is proved in parallel, without a file in one task, that a copy is a prefix of a live log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import Fold, segmented_scan
from .files import ATTEMPT
from .scratch import cut

#: Fixed value: a log that was touched less than so many seconds ago is still being written.
LIVE_SECONDS = 180
#: Lines of a digest.
BLOCK = 4096
LINE = T.StructType([*ATTEMPT.fields, T.StructField("raw_response", T.StringType()), T.StructField("_corrupt_record", T.StringType())])
MANIFEST = "leg string, malformed long, errors long, traces long, raw long, snapshot boolean, note string, archived long, head string, last string"


def placed(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """rows (leg and others) with place, from 1 along order within a leg; a leg may have any share of the rows."""
    return segmented_scan(rows, ["leg"], order, {"place": Fold(F.lit(1).cast("long"))})


def lines(spark: SparkSession, root: str, name: str = "attempts.jsonl") -> DataFrame:
    """leg, place, touched and value of every line of the logs at any depth below root; a log in the root itself is of the leg ``_root``. None at all raises."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath().rstrip("/")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    if not text.inputFiles():
        raise FileNotFoundError(f"no {name} below {root}")
    meta = F.col("_metadata")
    folder = F.regexp_replace(F.url_decode(F.replace(meta["file_path"], F.lit("+"), F.lit("%2B"))), r"^[a-zA-Z0-9]+:(//[^/]*)?", "")
    below = F.substr(folder, F.lit(len(base) + 2))
    leg = F.when(below == name, "_root").otherwise(F.substr(below, F.lit(1), F.greatest(F.length(below) - len(name) - 1, F.lit(0))))
    rows = text.select(leg.alias("leg"), meta["file_modification_time"].alias("touched"), "value", meta["file_block_start"].alias("__at"), F.monotonically_increasing_id().alias("__row"))
    return placed(cut(rows, "lines"), ["__at", "__row"]).drop("__at", "__row")


def block_digests(rows: DataFrame) -> DataFrame:
    """leg, block, lines, digest for rows (leg, place, value): sha256 over the sha256 of each line, in order."""
    each = F.struct("place", F.sha2(F.col("value").cast("binary"), 256).alias("h"))
    digest = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda x: x["h"]), "").cast("binary"), 256)  # BLOCK at most
    return rows.groupBy("leg", F.floor((F.col("place") - 1) / BLOCK).alias("block")).agg(F.count("*").alias("lines"), digest.alias("digest"))


def chain_heads(blocks: DataFrame) -> DataFrame:
    """leg, lines and head: the digests of a leg chained in order, each hashed with what came before."""
    links = F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])
    return blocks.groupBy("leg").agg(F.sum("lines").alias("lines"), F.aggregate(links, F.lit(""), lambda a, d: F.sha2(F.concat(a, d).cast("binary"), 256)).alias("head"))


def summary(held: DataFrame, now: str | None = None) -> DataFrame:
    """A record of each leg of lines(): lines, malformed ones, rows with an error, a trace and an answer (blank lines are none of these), whether it is live, and a note. now is the present if not given."""
    read = held.withColumn("r", F.from_json("value", LINE, {"columnNameOfCorruptRecord": "_corrupt_record"})).withColumn("blank", F.trim("value") == "")
    bad, error = ~F.col("blank") & F.col("r._corrupt_record").isNotNull(), F.coalesce("r.error", F.lit("")) != ""
    good = ~F.col("blank") & ~bad
    record = read.groupBy("leg").agg(F.count("*").alias("lines"), F.count_if(good).alias("rows"), F.count_if(bad).alias("malformed"), F.count_if(good & error).alias("errors"), F.count_if(good & F.col("r.reasoning").isNotNull()).alias("traces"), F.count_if(good & F.col("r.raw_response").isNotNull()).alias("raw"), F.max("touched").alias("touched"))
    present = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    live = F.unix_seconds(present) - F.unix_seconds("touched") < LIVE_SECONDS
    note = F.when(F.col("rows") == 0, "no attempts").when(F.col("errors") == F.col("rows"), "all attempts failed in transport").when((F.col("raw") == 0) & (F.col("errors") == 0), "no raw responses").when(live, "still being written")
    return record.select("leg", "lines", "malformed", "errors", "traces", "raw", live.alias("snapshot"), note.alias("note"))


def scan(spark: SparkSession, root: str, now: str | None = None) -> DataFrame:
    return summary(lines(spark, root), now)


def build(spark: SparkSession, root: str, out: str, now: str | None = None) -> DataFrame:
    """Copy all legs below root, compressed, and write their digests and at last their manifest, which is returned.

    Logs are read once: what is copied is what the record counts and the digests say, also of a log that grows meanwhile.
    The copies are read back and must give the same digests, or no manifest is written.
    """
    held = cut(lines(spark, root), "archive")
    ordered = held.repartitionByRange("leg", "place").sortWithinPartitions("leg", "place")
    ordered.select("leg", "value").write.mode("overwrite").partitionBy("leg").option("compression", "gzip").text(f"{out}/runs")
    blocks = cut(block_digests(held), "digests")
    blocks.coalesce(8).write.mode("overwrite").parquet(f"{out}/blocks")
    if not _differences(blocks, _copied_blocks(spark, out)).isEmpty():
        raise OSError(f"the copies in {out} don't hold what was read")
    last = held.groupBy("leg").agg(F.max_by("value", "place").alias("last"))
    manifest = summary(held, now).join(chain_heads(blocks).withColumnRenamed("lines", "archived"), "leg").join(last, "leg")
    manifest.drop("lines").write.mode("overwrite").json(f"{out}/manifest")
    return read_manifest(spark, out)


def _copies(spark: SparkSession, out: str) -> DataFrame:
    """leg, place and value of the copied lines: files of a leg follow each other by name."""
    meta = F.col("_metadata")
    rows = spark.read.schema("value string, leg string").text(f"{out}/runs").select("leg", "value", meta["file_name"].alias("__file"), F.monotonically_increasing_id().alias("__row"))
    return placed(cut(rows, "copies"), ["__file", "__row"]).drop("__file", "__row")


def _copied_blocks(spark: SparkSession, out: str) -> DataFrame:
    return block_digests(_copies(spark, out))


def _differences(known: DataFrame, found: DataFrame) -> DataFrame:
    """leg and line: the first line of the first block of known that found doesn't have as it is, or of one that only found has."""
    other = found.select(F.col("leg").alias("__leg"), F.col("block").alias("__block"), F.col("digest").alias("__digest"))
    both = known.join(other, (F.col("leg") == F.col("__leg")) & (F.col("block") == F.col("__block")), "full")
    wrong = both.where(~F.col("digest").eqNullSafe(F.col("__digest")))
    return wrong.groupBy(F.coalesce("leg", "__leg").alias("leg")).agg((F.min(F.coalesce("block", "__block")) * BLOCK + 1).alias("line"))


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{out}/manifest")


def verify(spark: SparkSession, out: str, root: str | None = None) -> DataFrame:
    """leg and problem: copies that aren't what the digests say, digests that don't give the manifest's head, and, with root, live logs that differ from their copies or have none.

    A snapshot's log may have grown, and its last copied line may have been cut off, but what was copied must still be a
    prefix of it: an edited, lost or reordered line is reported with the first line of its block.
    """
    manifest = cut(read_manifest(spark, out), "manifest")
    blocks = spark.read.schema("leg string, block long, lines long, digest string").parquet(f"{out}/blocks")
    heads = chain_heads(blocks).select(F.col("leg").alias("__leg"), F.col("head").alias("__head"))
    chained = manifest.join(heads, F.col("leg") == F.col("__leg"), "full").where(~F.col("head").eqNullSafe(F.col("__head"))).select(F.coalesce("leg", "__leg").alias("leg"), F.lit("manifest and digests differ").alias("problem"))
    copies = cut(_copied_blocks(spark, out), "copied")
    changed = _differences(blocks, copies).join(copies.groupBy("leg").agg(F.sum("lines").alias("held")), "leg", "left")
    copied = changed.select("leg", F.when(F.col("held").isNull(), "copy is missing").otherwise(F.concat(F.lit("copy differs from line "), F.col("line").cast("string"))).alias("problem"))
    found = chained.unionByName(copied)
    if root:
        found = found.unionByName(_against_live(cut(lines(spark, root), "live"), manifest, blocks))
    return found


def _against_live(live: DataFrame, manifest: DataFrame, blocks: DataFrame) -> DataFrame:
    size = live.groupBy("leg").agg(F.count("*").alias("now"))
    known = manifest.select("leg", "archived", "snapshot", "last")
    both = cut(known.withColumnRenamed("leg", "__leg").join(size, F.col("__leg") == F.col("leg"), "full"), "legs")
    told = F.when(F.col("__leg").isNull(), "log has no copy").when(F.col("leg").isNull(), "log is gone").when(F.col("now") < F.col("archived"), "log has lost lines").when(~F.col("snapshot") & (F.col("now") > F.col("archived")), "log has grown")
    found = both.select(F.coalesce("__leg", "leg").alias("leg"), told.alias("problem"))
    same = both.where(told.isNull())
    kept = live.join(same.select("leg", "archived", "snapshot", "last"), "leg").where(F.col("place") <= F.col("archived"))
    torn = F.col("snapshot") & (F.col("place") == F.col("archived")) & F.startswith("value", "last")
    upto = kept.select("leg", "place", F.when(torn, F.col("last")).otherwise(F.col("value")).alias("value"))
    held = blocks.join(same.select("leg"), "leg", "left_semi")
    moved = _differences(held, block_digests(upto)).select("leg", F.concat(F.lit("log differs from line "), F.col("line").cast("string")).alias("problem"))
    return found.where(F.col("problem").isNotNull()).unionByName(moved)
