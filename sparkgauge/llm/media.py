"""Media columns of baseline JPEG: dimensions, luminance thumbnails from DC coefficients, and hashes.

``describe`` reads any baseline JPEG: it parses the markers, Huffman-decodes the scans and keeps the DC coefficients of the
first component as a thumbnail of one sample a block, so no transform is needed. ``store`` keeps texts as such images,
losslessly. Rows never move: both are one pass over their table, and what is between them lies in the shared folder.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jpeg
from .common import materialize

#: Bytes of payloads that are coded together.
AT_ONCE = 1 << 20
STORED = "id bigint, n_bytes bigint, media binary"
DESCRIBED = {"width": pa.int32(), "height": pa.int32(), "components": pa.int32(), "thumb_width": pa.int32(), "thumb_height": pa.int32(), "thumbnail": pa.binary(), "thumb_sha256": pa.string(), "average_hash": pa.string(), "comment": pa.string(), "error": pa.string(), "payload": pa.binary()}
MEDIA = "width int, height int, components int, thumb_width int, thumb_height int, thumbnail binary, thumb_sha256 string, average_hash string, comment string, error string, payload binary"


def padded(text: bytes) -> bytes:
    """text and bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def average_hash(thumb: np.ndarray) -> str:
    """64 bits in hexadecimal: whether each cell of an 8 x 8 grid over the thumbnail is lighter than their mean."""
    down, across = ((np.arange(8) * n) // 8 for n in thumb.shape)
    ends = [np.append(x[1:], n) for x, n in zip((down, across), thumb.shape, strict=True)]
    area = np.maximum(1, ends[0] - down)[:, None] * np.maximum(1, ends[1] - across)[None]
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), down, axis=0), across, axis=1) / area
    return np.packbits(cells > cells.mean()).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, group, first = batch.column(0), [], [], 0

        def coded(until: int) -> pa.RecordBatch:
            return pa.record_batch({"id": ids.slice(first, until - first), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(jpeg.encode(group), pa.binary())})  # noqa: B023

        held = 0
        for i, text in enumerate(batch.column(1)):
            group.append(padded(x := text.as_py()))
            sizes.append(len(x))
            held += len(x)
            if held >= AT_ONCE:
                yield coded(i + 1)
                first, sizes, group, held = i + 1, [], [], 0
        if group:
            yield coded(batch.num_rows)


def store(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """A row (id, n_bytes, media) for each of docs: its text in UTF-8, padded to 64 bytes, as a JPEG that holds it losslessly.

    A null text is empty, and the empty text 64 bytes 0. Repeated rows and null ids stay. The table lies in the shared folder, compressed.
    """
    rows = docs.select(doc_id.cast("bigint").alias("id"), F.coalesce(text.cast("string"), F.lit("")).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(_store, STORED), "media")


def _described(with_payload: bool):
    @F.arrow_udf(f"struct<{MEDIA.replace(', ', ',').replace(' ', ':')}>")
    def describe(media: pa.Array) -> pa.Array:
        rows = []
        for image in jpeg.decode([x.as_py() or b"" for x in media]):
            row = dict.fromkeys(DESCRIBED)
            if image.error:
                rows.append(row | {"error": image.error})
                continue
            thumb = image.thumbnail()
            row |= {"width": image.width, "height": image.height, "components": len(image.parts), "thumb_width": thumb.shape[1], "thumb_height": thumb.shape[0], "thumbnail": thumb.tobytes()}
            row |= {"thumb_sha256": hashlib.sha256(thumb).hexdigest(), "average_hash": average_hash(thumb), "comment": image.comment.decode("latin-1")}
            if with_payload:
                try:
                    row["payload"] = jpeg.payload(image)
                except jpeg.Corrupt as e:
                    row["error"] = str(e)
            rows.append(row)
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in DESCRIBED.items()], list(DESCRIBED))

    return describe


def describe(table: DataFrame, media: str = "media") -> DataFrame:
    """table with the column ``image``: the fields of MEDIA but payload, read from its baseline JPEGs.

    What is null, empty, cut off or no baseline JPEG has only ``error``, which says why. All rows and columns stay, but a column
    ``image`` is replaced. Equal bytes give equal fields.
    """
    return table.withColumn("image", _described(False)(F.col(media))).withColumn("image", F.col("image").dropFields("payload"))


def features(stored: DataFrame) -> DataFrame:
    """For the table of store(), per row: id, n_bytes, digests of payload and media as read back, and a feature of size, thumbnail hash and average hash.

    An image that can't be read back raises an error, as nothing stored may be lost.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            media = [x.as_py() for x in batch.column(2)]
            for data, image in zip(media, jpeg.decode(media), strict=True):
                if image.error:
                    raise jpeg.Corrupt(image.error)
                held, thumb = jpeg.payload(image), image.thumbnail()
                feature = f"{image.width}x{image.height} {hashlib.sha256(thumb).hexdigest()} {average_hash(thumb)}"
                for c, v in zip(out, (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature), strict=True):
                    out[c].append(v)
            yield pa.record_batch({"id": batch.column(0), "n_bytes": batch.column(1), **{c: pa.array(v, pa.string() if c.endswith("sha256") or c == "feature" else pa.int64()) for c, v in out.items()}})

    return stored.mapInArrow(digests, "id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
