r"""Content-addressed WARC archive.

An archive is two tables. ``payloads`` holds the bytes of every distinct payload once, under its SHA-256;
``records`` holds the exact header block of every record and the digest of its payload. Joining them gives
the original WARC records byte for byte, and the bytes are verified against their digests on the way. Payloads are bucketed by
their digest, so the join leaves them where they are. Records are exported as plain WARC files, and a parser reads
such files back.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialize, shared_dir

#: A payload shorter than this is never revisited: a revisit record would hardly be smaller.
MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"
#: Bytes of records that a WARC file has by the archive's mean, so that a reader can hold one.
FILE_BYTES = 16_000_000


class Archive(NamedTuple):
    records: DataFrame
    payloads: DataFrame


def _uri(text: Column) -> Column:
    """A header value must not hold line ends: they are percent-encoded."""
    return F.regexp_replace(F.regexp_replace(text, "\r", "%0D"), "\n", "%0A")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z", path: str | None = None) -> Archive:
    """Archive every page as one WARC record; path is a shared folder (by default a new scratch folder).

    Of records with equal payloads of MIN_REVISIT_BYTES or more, the one with the largest id is the response
    and the others are revisits that refer to it; rows repeated under that very id are responses too. A null id
    is smaller than any other. A null body is an empty payload, and a null url the target ``about:blank``. An
    empty table gives an empty archive. Other columns are ignored.
    The payloads are also a table of the catalog (see drop_archive), since only that keeps their buckets.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    # one row per payload, combined before the shuffle; equal payloads, so any of them will do
    stored = rows.groupBy("sha256").agg(F.first("payload").alias("payload"), F.max("id").alias("owner"), F.count("*").alias("copies"))
    stored = stored.select("sha256", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), "owner", "copies")
    # as many buckets as the aggregation has partitions, so each task has whole buckets
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"warc_payloads_{uuid.uuid4().hex}"
    stored.write.bucketBy(buckets, "sha256").option("path", f"{path}/payloads").saveAsTable(table)
    payloads = spark.table(table)
    narrow = rows.select("id", "url", "sha256")
    known = lookup(narrow, payloads.select("sha256", "sha1", "bytes", "owner", "copies"), ["sha256"], "copies")
    revisit = (F.col("bytes") >= MIN_REVISIT_BYTES) & ~F.col("id").eqNullSafe(F.col("owner"))
    kind = F.when(revisit, "revisit").otherwise("response")
    record_id = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind), line("WARC-Record-ID", record_id(F.col("id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _uri(F.coalesce(F.col("url"), F.lit("about:blank")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("owner"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, 0).otherwise(F.col("bytes")).cast("string")), F.lit(CRLF),
    )
    known.select("id", head.alias("header"), "sha256").write.parquet(f"{path}/records")
    return Archive(spark.read.parquet(f"{path}/records"), payloads)


def drop_archive(archive: Archive) -> None:
    """Take the payload table out of the catalog, where write_archive put it; the files stay."""
    spark = archive.records.sparkSession
    folders = {f.rpartition("/")[0] for f in archive.payloads.inputFiles()}
    for t in spark.catalog.listTables():
        if t.name.startswith("warc_payloads_") and (not folders or {f.rpartition("/")[0] for f in spark.table(t.name).inputFiles()} == folders):
            spark.sql(f"DROP TABLE {t.name}")


def read_archive(spark: SparkSession, path: str) -> Archive:
    return Archive(spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads"))


def verify(archive: Archive) -> DataFrame:
    """Records joined with what their payload's bytes give: id, header, sha256, record_type, refers_to, payload_digest, payload_bytes.

    Digests and lengths are recomputed from the stored bytes, once for all records that refer to them; one that
    differs from a header or from its address stops the job, so damage is never passed on.
    """
    held = archive.payloads.select("sha256", F.sha2("payload", 256).alias("found256"), F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "copies")
    rows = lookup(archive.records, held, ["sha256"], "copies")
    get = lambda name: F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)", 1)
    number = lambda name: F.regexp_extract(get(name), r"<urn:page:(-?\d+)>", 1)
    revisit = get("WARC-Type") == "revisit"
    sound = (F.col("found256") == F.col("sha256")) & (get("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest")) & (get("Content-Length").cast("long") == F.when(revisit, 0).otherwise(F.col("payload_bytes")))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged WARC payload "), "sha256")))
    as_id = lambda name: F.when(number(name) != "", number(name).cast("long"))
    return rows.select(as_id("WARC-Record-ID").alias("id"), "header", "sha256", get("WARC-Type").alias("record_type"), F.when(revisit, as_id("WARC-Refers-To")).alias("refers_to"), checked.alias("payload_digest"), "payload_bytes")


def reconstruct(archive: Archive) -> DataFrame:
    """verify(archive) with the full payload of every record, revisits included.

    Payloads below MIN_REVISIT_BYTES can be those of any number of records, and are small enough for lookup() to
    broadcast the heavy ones (under HEAVY_SHARE times that size). Larger ones meet their records in a
    sort-merge join, whose hot partitions adaptive execution splits.
    """
    rows, short = verify(archive), F.col("bytes") < MIN_REVISIT_BYTES
    small = archive.payloads.where(short).select("sha256", "payload", "copies")
    large = archive.payloads.where(~short).select("sha256", "payload")
    of_small = lookup(rows.where(F.col("payload_bytes") < MIN_REVISIT_BYTES), small, ["sha256"], "copies").drop("copies")
    return of_small.unionByName(rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).join(large, "sha256", "left"))


def _bodies(archive: Archive) -> DataFrame:
    """Records (id, header) with body, the payload where the record carries it: in responses, not in revisits.

    A payload of MIN_REVISIT_BYTES or more has one response, so that join has no hot key and the bucketed payloads stay in place. A
    shorter one is that of any number of responses; lookup() broadcasts the heavy ones.
    """
    length = F.regexp_extract("header", r"\r\nContent-Length: (\d+)", 1).cast("long")
    rows = archive.records.select("id", "header", "sha256", (F.regexp_extract("header", r"\r\nWARC-Type: ([^\r]*)", 1) == "revisit").alias("revisit"), length.alias("length"))
    short = F.col("bytes") < MIN_REVISIT_BYTES
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged WARC payload "), "sha256")))
    small = archive.payloads.where(short).select("sha256", checked.alias("body"), "copies")
    large = archive.payloads.where(~short).select("sha256", checked.alias("body"))
    responses = rows.where(~F.col("revisit"))
    of_small = lookup(responses.where(F.col("length") < MIN_REVISIT_BYTES), small, ["sha256"], "copies")
    of_large = responses.where(F.col("length") >= MIN_REVISIT_BYTES).join(large, "sha256", "left")
    parts = [x.select("id", "header", "body") for x in (of_small, of_large)]
    return parts[0].unionByName(parts[1]).unionByName(rows.where("revisit").select("id", "header", F.lit(b"").alias("body")))


def export_records(archive: Archive) -> DataFrame:
    """The WARC records as bytes, one per row (id, record): header, payload unless a revisit, two line ends. A missing or damaged payload stops the job."""
    body = F.coalesce("body", F.raise_error(F.lit("missing WARC payload")).cast("binary"))
    return _bodies(archive).select("id", F.concat(F.col("header").cast("binary"), body, F.lit((CRLF * 2).encode())).alias("record"))


def export_files(archive: Archive, path: str, codec: str = "gzip") -> None:
    """Write plain WARC files: Spark's text sink, with the two line ends that close a record as its separator.

    A file has as many records as make FILE_BYTES by their mean length. An empty archive gives a file without records.
    """
    size = archive.payloads.agg((F.sum("bytes") / F.sum(F.lit(1))).alias("mean")).head().mean or 0
    body = F.coalesce("body", F.raise_error(F.lit("missing WARC payload")).cast("binary")).cast("string")
    rows = _bodies(archive).select(F.concat("header", body))
    rows.write.option("lineSep", CRLF * 2).option("compression", codec).option("maxRecordsPerFile", max(1, int(FILE_BYTES // (size + 500)))).text(path)


PARSED = "id long, record_type string, refers_to long, payload_digest string, payload_bytes long, target string, header string"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], str, bytes]]:
    """(header fields by lower-case name, header block, block) of each record in the bytes of a WARC file. Anything but whole records raises."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at : end + 4].decode("utf-8")
        lines = head.split(CRLF)
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        n = int(fields["content-length"])
        block, at = data[end + 4 : end + 4 + n], end + 4 + n + 4
        if len(block) < n or data[at - 4 : at] != b"\r\n\r\n":
            raise ValueError(f"damaged WARC record {fields.get('warc-record-id')}")
        yield fields, head, block


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [x.split()[0] for x in PARSED.split(", ")], (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        for content in batch.column(0):
            data = content.as_py()
            rows = []
            for f, head, block in parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                revisit, said = f["warc-type"] == "revisit", f["warc-payload-digest"].removeprefix("sha1:")
                if not revisit and hashlib.sha1(block).hexdigest() != said:
                    raise ValueError(f"damaged WARC payload {f.get('warc-record-id')}")
                rows.append((_page(f["warc-record-id"]), f["warc-type"], _page(f.get("warc-refers-to")), said, None if revisit else len(block), f.get("warc-target-uri"), head))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files below path (PARSED), plain or compressed by gzip, parsed and checked against their digests.

    payload_digest and payload_bytes are those of the full payload: a revisit has them from the response it refers to, and one whose
    response is missing or holds another payload stops the job. Files without records give no rows.
    """
    rows = materialize(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, PARSED), "warc-records")
    key = [F.col("id").alias("refers_to"), "payload_digest"]
    asked = rows.where(F.col("record_type") == "revisit").groupBy("refers_to", "payload_digest").agg(F.count("*").alias("n"))
    held = rows.where(F.col("record_type") != "revisit").groupBy(*key).agg(F.first("payload_bytes").alias("found"))
    groups = materialize(asked.join(held, ["refers_to", "payload_digest"]), "warc-referred")
    revisits = lookup(rows.where(F.col("record_type") == "revisit"), groups, ["refers_to", "payload_digest"], "n")
    size = F.coalesce("found", F.raise_error(F.concat(F.lit("no response for "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("long"))
    return rows.where(F.col("record_type") != "revisit").unionByName(revisits.withColumn("payload_bytes", size).select(*rows.columns))
