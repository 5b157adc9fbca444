"""Best-fit packing of token sequences.

Documents become pieces of at most the capacity, and pieces are packed by bulk-synchronous best fit. Pieces of more than
half the capacity open a sequence each. In a superstep all other pieces and the gaps of the open sequences are range-sorted into one
order of sizes. Every task sweeps its range upwards: a gap is given to the largest piece below it that is still free, so a piece gets the
smallest gap above it (its successor) that no closer piece wants. What a range leaves, gaps without a piece below and pieces without
a gap above, is matched across ranges by rank. The gaps are then updated, and so on until every piece has its place. Where pieces are larger than
all gaps, the largest ones take part alone, a band of sizes (BANDS) at a time, and those of them that are larger than all gaps open new
sequences, as many as their volume fills: smaller pieces come when these are full. A gap that holds several of the largest pieces
takes part as so many slots. The outcome doesn't depend on how the rows are spread.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shared_dir
from .tokens import encoder

CAPACITY, END_ID = 2048, 0
#: Pieces and slots that a task sweeps: so many, or more where there would be more ranges than shuffle partitions, up to a bound.
RANGE_ROWS, MOST_ROWS = 50_000, 1_000_000
#: A band is this part of the capacity; pieces of up to a quarter of it need no bands.
BANDS = 42
PIECES = "doc_id long, row_uid long, piece int, start long, length int, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of n ids: full ones, after a first one that may be shorter."""
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return list(zip(edges, edges[1:], strict=False))


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of all docs (doc_id, text): PIECES, and ids (little-endian bytes) if kept.

    A document is its ids and END_ID; null text is empty, so that every row has a piece. Rows of one doc_id,
    equal or null, are documents of their own (row_uid).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), END_ID.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = encode(text.as_py() or "") + end
                for i, (a, b) in enumerate(cut(len(ids) // 4, capacity)):
                    held = ids[4 * a : 4 * b]
                    rows.append((doc_id, uid, i, a, b - a, zlib.crc32(held)) + (held,) * keep_ids)
            if not rows:
                continue
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=[x.split()[0] for x in PIECES.split(", ")] + ["ids"] * keep_ids)

    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row_uid"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECES + ", ids binary" * keep_ids)


#: Rows of a superstep: pieces without a sequence (kind 0), slots that took none (1), and pieces with their sequence (2); gap is the sequence's before it.
WAITING, FREE, PLACED = 0, 1, 2
STATE = "kind int, row_uid long, piece int, length int, seq long, gap int"
SWEPT = STATE + ", range int, rank long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range in the order of sizes (kind, row_uid, piece, length, seq, gap): pairs of a slot and the largest free piece below it, and what is left, ranked."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    uid, piece, length, seq, gap = (table.column(c).to_numpy() for c in ("row_uid", "piece", "length", "seq", "gap"))
    stack, pairs, free = [], [], []
    for i, kind in enumerate(table.column("kind").to_pylist()):
        if kind == WAITING:
            stack.append(i)
        elif stack:
            pairs.append((stack.pop(), i))
        else:
            free.append(i)
    mine, theirs = (np.array(x, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ())))
    stack, free = np.array(stack, np.int64), np.array(free, np.int64)
    rows, slots = np.concatenate([mine, stack, free]), np.concatenate([theirs, stack, free])
    kinds = np.repeat(np.array([PLACED, WAITING, FREE], np.int32), [len(mine), len(stack), len(free)])
    rank = np.concatenate([np.zeros(len(mine), np.int64), np.arange(len(stack)), np.arange(len(free))])
    number = np.full(len(rows), TaskContext.get().partitionId(), np.int32)
    out = [kinds, uid[rows], piece[rows], length[rows], seq[slots], gap[slots], number, rank]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=[x.split()[0] for x in SWEPT.split(", ")])


def _across(swept: DataFrame) -> DataFrame:
    """STATE rows of swept, with what the ranges left matched by rank.

    A range leaves free slots, all smaller than its waiting pieces. With pieces as opening and slots as closing brackets over all ranges,
    partners have the same depth and follow one another at it. The depth before each range comes from a row a range. A depth
    occurs twice in a range at most, so no task gathers more than that.
    """
    left = swept.where(F.col("kind") != PLACED)
    count = lambda kind: F.count(F.when(F.col("kind") == kind, True))
    ranges = left.groupBy("range").agg(count(WAITING).alias("n_waiting"), count(FREE).alias("n_free"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("depth", F.coalesce(F.sum(F.col("n_waiting") - F.col("n_free")).over(before), F.lit(0)))
    depth = F.when(F.col("kind") == FREE, F.col("depth") - F.col("rank") - 1).otherwise(F.col("depth") - F.col("n_free") + F.col("rank"))
    at = Window.partitionBy("level").orderBy("range", F.col("kind").desc())
    met = left.join(F.broadcast(ranges), "range").withColumn("level", depth)
    met = met.select("*", F.lead(F.struct("kind", "seq", "gap")).over(at).alias("next"), F.lag("kind").over(at).alias("last"))
    placed = (F.col("kind") == WAITING) & F.coalesce(F.col("next.kind") == FREE, F.lit(False))
    met = met.where((F.col("kind") == WAITING) | ~F.coalesce(F.col("last") == WAITING, F.lit(False)))
    met = met.select(F.when(placed, PLACED).otherwise(F.col("kind")).alias("kind"), "row_uid", "piece", "length", F.when(placed, F.col("next.seq")).otherwise(F.col("seq")).alias("seq"), F.when(placed, F.col("next.gap")).otherwise(F.col("gap")).alias("gap"))
    return swept.where(F.col("kind") == PLACED).select(met.columns).unionByName(met)


def _match(waiting: DataFrame, gaps: DataFrame, largest: int, n_waiting: int, n_gaps: int) -> DataFrame:
    """STATE rows after waiting pieces (row_uid, piece, length; up to largest) have met gaps (seq, gap)."""
    conf = gaps.sparkSession.conf
    # no more slots than twice the pieces, but for one a gap
    slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / largest), F.lit(-(-2 * n_waiting // n_gaps)))).cast("int")
    none = [F.lit(0).cast(t).alias(c) for c, t in (("row_uid", "long"), ("piece", "int"), ("length", "int"))]
    cut = gaps.withColumn("slots", slots).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("slots"))))
    free = cut.select(F.floor(F.col("gap") / F.col("slots")).cast("int").alias("size"), F.lit(FREE).alias("kind"), *none, "seq", "gap", F.xxhash64("seq", "slot").alias("tie"))
    pieces = waiting.select(F.col("length").alias("size"), F.lit(WAITING).alias("kind"), "row_uid", "piece", "length", F.lit(0).cast("long").alias("seq"), F.lit(0).alias("gap"), F.xxhash64("row_uid", "piece").alias("tie"))
    order, n = ["size", "kind", "tie"], 3 * n_waiting + n_gaps
    ranges = max(min(-(-n // RANGE_ROWS), int(conf.get("spark.sql.shuffle.partitions"))), -(-n // MOST_ROWS))
    both = pieces.unionByName(free)
    dealt = both.repartitionByRange(ranges, *order) if ranges > 1 else both.coalesce(1)
    swept = dealt.sortWithinPartitions(*order).select(*[x.split()[0] for x in STATE.split(", ")]).mapInArrow(_sweep, SWEPT)
    return _across(materialize(swept, "swept")) if ranges > 1 else swept.drop("range", "rank")


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (PIECES; a materialized table) with sequence_id and offset; none has a length over capacity.

    Equal sizes are ranked by a hash of (row_uid, piece), so ties and repeated rows have a fixed order. An empty table gives none.
    The driver gets counts and extreme sizes only. Every superstep is written out.
    """
    spark, base = pieces.sparkSession, f"{shared_dir(pieces.sparkSession)}/packing-{uuid.uuid4().hex}"
    big = F.col("length") > capacity // 2
    own = F.when(big, -1 - F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    state = pieces.select(F.when(big, PLACED).otherwise(WAITING).alias("kind"), "row_uid", "piece", "length", own.alias("seq"), F.when(big, capacity).otherwise(0).alias("gap"))
    step = opened = 0
    while True:
        state.write.parquet(f"{base}/step={step}")
        state = spark.read.schema(STATE).parquet(f"{base}/step={step}")
        waiting = state.where(F.col("kind") == WAITING)
        left = waiting.agg(F.count("*").alias("n"), F.min("length").alias("least"), F.max("length").alias("most")).head()
        if not left.n:
            break
        used = F.sum(F.when(F.col("kind") == PLACED, F.col("length")).otherwise(0))
        gaps = state.where(F.col("kind") != WAITING).groupBy("seq").agg((F.min("gap") - used).cast("int").alias("gap")).where(F.col("gap") >= left.least)  # others hold no piece any more
        known = gaps.agg(F.count("*").alias("n"), F.coalesce(F.max("gap"), F.lit(0)).alias("most")).head()
        above = left.most - max(1, capacity // BANDS) if left.most > max(known.most, capacity // 4) else 0
        new, n_waiting, n_gaps, rest = 0, left.n, known.n, None
        if left.most > known.most:
            band = F.col("length") > above
            told = waiting.where(band).agg(F.sum(F.when(F.col("length") > known.most, F.col("length"))).alias("volume"), F.count("*").alias("n")).head()
            new, n_waiting = -(-told.volume // capacity), told.n
            opening = spark.range(opened, opened + new).select(F.col("id").alias("seq"), F.lit(capacity).alias("gap"))
            opened += new
            if above > 0:
                none = [F.lit(0).cast(t).alias(c) for c, t in (("row_uid", "long"), ("piece", "int"), ("length", "int"))]
                idle = gaps.where(F.col("gap") <= above).select(F.lit(FREE).alias("kind"), *none, "seq", "gap")
                rest = waiting.where(~band).unionByName(idle)
                gaps, waiting = gaps.where(F.col("gap") > above), waiting.where(band)
            gaps = gaps.unionByName(opening)
        state, step = _match(waiting, gaps, left.most, n_waiting, n_gaps + new), step + 1
        state = state.unionByName(rest) if rest is not None else state
    placed = spark.read.schema(STATE + ", step int").parquet(base).where(F.col("kind") == PLACED).select("row_uid", "piece", "length", "seq", "step")
    before = Window.partitionBy("seq").orderBy("step", F.col("length").desc(), "row_uid", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(F.col("row_uid").alias("p_uid"), F.col("piece").alias("p_piece"), F.col("seq").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
    return pieces.join(placed, (F.col("row_uid") == F.col("p_uid")) & (F.col("piece") == F.col("p_piece"))).drop("p_uid", "p_piece")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenize all docs once into a table of pieces and pack them. See tokenize_pieces and best_fit."""
    return best_fit(materialize(tokenize_pieces(docs, tokenizer, capacity, keep_ids), "pieces"), capacity)
