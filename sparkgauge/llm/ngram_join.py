"""Jaccard join of word n-gram sets with Bayesian candidate pruning.

1. Every text becomes the set of its five-word shingles (64-bit hashes), a MinHash signature and a fingerprint of the set.
   Texts with equal sets are one class, and only one row of a class takes part from here on.
2. Classes that share a band of the signature are candidates. Each band's classes are compared, those of a large one in pairs of blocks:
   MinHash values step by step, and a pair is dropped as soon as the posterior probability that its similarity reaches the
   threshold falls below the tolerance. Of the pairs that remain, a task returns a spanning forest only.
3. Components of these forests hold every remaining pair. A component's classes, sorted by set size and dealt in
   blocks where they are many, are compared again, each pair of blocks in a task, and what remains is verified exactly on the
   shingle sets. Of two blocks whose sizes rule a match out, nothing is compared.
4. A task returns each class's number of links and a spanning forest, and components of the forests are the groups.

No pair is ever written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keep_rows, lookup, materialize
from .components import connected_components

WORDS, THRESHOLD = 5, 0.8
#: Signature length, and rows of a band. A pair at the threshold shares no band with probability (1 - 0.8**4)**32, 5e-8.
HASHES, ROWS = 128, 4
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Classes in a block when signatures are compared, and when sets are; shingles of the latter, unless a single set has more.
SIGN_BLOCK, BLOCK, BLOCK_SHINGLES = 512, 128, 500_000
#: Against rounding where whole numbers are compared.
SLACK = 1e-6
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=[7, 11]))
    return rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-case words between white space, in order."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x{85}\x{a0}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of WORDS words in a row; a shorter text is one shingle, an empty one has none."""
    n = len(words) - WORDS + 1
    if not len(words):
        return words
    if n < 1:
        words, n = np.concatenate((words, np.zeros(1 - n, np.uint64))), 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total = _scramble(total + words[i : i + n] + np.uint64(i + 1))
    return np.unique(total)


def signature(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of one set, scrambled to 16 bits: different ones are equal with probability 2**-16, which only adds candidates."""
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(sets), 512):
        out = np.minimum(out, (a[:, None] * sets[None, i : i + 512] + b[:, None]).min(axis=1))
    return (_scramble(out) >> np.uint64(48)).astype(np.uint16)


def prune_limits(threshold: float, tolerance: float) -> list[int]:
    """After each step, the most matches with which a pair is dropped. With a flat prior the posterior of the similarity after m of n
    matches is Beta(m + 1, n - m + 1), whose tail above t is a binomial sum."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, most = 0.0, -1
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail < tolerance:
                most = m
        out.append(most)
    return out


def _words_of(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    lists = batch.column(column)
    flat, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
    for i in range(len(lists)):
        yield flat[at[i] : at[i + 1]]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _parameters()
    for batch in batches:
        prints, sizes, signatures = [], [], []
        for words in _words_of(batch, 2):
            found = shingles(words)
            prints.append(blake2b(found.tobytes(), digest_size=16).digest())
            sizes.append(len(found))
            signatures.append(signature(found, a, b).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())], names=["doc_id", "text_hash", "print", "size", "signature"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = HASHES // ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, n, ROWS).astype(np.uint64)
        key = np.zeros(rows.shape[:2], np.uint64)
        for i in range(ROWS):
            key = _scramble(key + rows[:, :, i] + np.uint64(1))
        key = _scramble(key + np.arange(n, dtype=np.uint64))  # a band meets itself alone
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), n))], names=["band", "node"])


def _forest(sides: np.ndarray, sizes: np.ndarray, signs: np.ndarray, threshold: float, limits: list[int]) -> list[tuple[int, int]]:
    """Edges (position, root) of a spanning forest of the pairs that pruning leaves. Where both sides occur, only pairs across them count.

    A class that a component has reached is compared no more, which leaves the components as they are.
    """
    first = signs[:, :STEP]
    if len(sizes) <= 32:
        matches = (first[:, None, :] == first[None, :, :]).sum(axis=2, dtype=np.uint8)
    else:
        matches = np.zeros((len(sizes), len(sizes)), np.uint8)
        for column in np.ascontiguousarray(first.T):
            matches += column[:, None] == column[None, :]
    near = (matches > limits[0]) & (np.minimum.outer(sizes, sizes) + SLACK >= threshold * np.maximum.outer(sizes, sizes))
    if sides.any():
        near &= sides[:, None] != sides[None, :]
    np.fill_diagonal(near, False)
    left, out = near.any(axis=1), []
    for root in np.flatnonzero(left).tolist():
        if not left[root]:
            continue
        left[root], todo = False, [root]
        while todo:
            x = todo.pop()
            met = np.flatnonzero(near[x] & left)
            total = matches[x, met].astype(np.int32)
            for step, limit in enumerate(limits[1:], 1):
                at = slice(step * STEP, (step + 1) * STEP)
                total += (signs[met, at] == signs[x, at]).sum(axis=1, dtype=np.int32)
                met, total = met[total > limit], total[total > limit]
            left[met] = False
            todo += met.tolist()
            out += [(y, root) for y in met.tolist()]
    return out


def _survivors(threshold: float, tolerance: float):
    """Rows sorted by group and pair of blocks: (group, left, right, side, node, size, signature) -> (a, b), a forest of the pairs that pruning leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, key, rows, out = prune_limits(threshold, tolerance), None, [], []

        def settle() -> None:
            if len(rows) > 1:
                sides, nodes, sizes, signs = zip(*rows, strict=True)
                found = _forest(np.array(sides), np.array(sizes), np.frombuffer(b"".join(signs), np.uint16).reshape(len(rows), HASHES), threshold, limits)
                out.extend((nodes[x], nodes[y]) for x, y in found)
            rows.clear()

        def flush() -> pa.RecordBatch:
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for *k, side, node, size, sign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    settle()
                    key = k
                    if len(out) > 50_000:
                        yield flush()
                rows.append((side, node, size, sign))
        settle()
        if out:
            yield flush()

    return run


def _in_blocks(rows: DataFrame, threshold: float, block: int, load: int | None = None) -> DataFrame:
    """rows (group, node, size, whole) for each pair of blocks they take part in: group, left, right, side, node.

    A group that is whole is one block. Another is cut by size, and further by hash into blocks of about ``block`` rows and ``load`` in
    sizes; sets of sizes in bands that are neither equal nor next to each other differ too much, so such blocks don't meet.
    """
    band_of = F.floor(F.log("size") / math.log(1 / threshold) + 1e-9)
    small = rows.where("whole").select("group", *[F.lit(0).cast("long").alias(c) for c in ("left", "right")], F.lit(0).alias("side"), "node")
    big = rows.where(~F.col("whole")).select("group", "node", "size", band_of.alias("size_band"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("total") / (load or 1)) if load else F.lit(1))
    counts = materialize(big.groupBy("group", "size_band").agg(F.count("*").alias("n"), F.sum("size").alias("total")).withColumn("n_blocks", F.least(parts, F.col("n")).cast("long")).drop("total"), "size-bands")
    number = lambda block: F.col("size_band") * 2**32 + block
    dealt = lookup(big, counts, ["group", "size_band"], "n").select("group", "node", number(F.pmod(F.xxhash64("node"), F.col("n_blocks"))).alias("block"))
    above = counts.select("group", (F.col("size_band") - 1).alias("size_band"), F.col("n_blocks").alias("n_next"))
    edges = counts.join(above, ["group", "size_band"], "left").select("group", "size_band", "n_blocks", "n_next", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("at")).repartition("group", "size_band", "at")
    own = F.transform(F.sequence(F.col("at"), F.col("n_blocks") - 1), number)  # each block lists its partners, so those of a large group are written by many tasks
    following = F.when(F.col("n_next").isNotNull(), F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("n_next", F.lit(1)) - 1), lambda j: number(j) + 2**32)).otherwise(F.array().cast("array<long>"))
    pairs = materialize(edges.select("group", number(F.col("at")).cast("long").alias("left"), F.explode(F.concat(own.cast("array<long>"), following.cast("array<long>"))).alias("right")), "block-pairs")
    sides = pairs.select("group", "left", "right", F.col("left").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where(F.col("left") < F.col("right")).select("group", "left", "right", F.col("right").alias("block"), F.lit(1).alias("side")))
    return small.unionByName(dealt.join(sides, ["group", "block"]).select("group", "left", "right", "side", "node"))


def candidates(classes: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, component) of the classes (node, size, signature) that pruning leaves with a candidate.

    Only pairs that share a band are compared. Bands of the very same classes count as one. An empty set has no candidates.
    """
    h = F.xxhash64("node")
    bands = materialize(classes.where(F.col("size") > 0).select("node", "signature").mapInArrow(_bands, "band long, node long"), "bands")
    shared = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h)).alias("y")).where(F.col("n") > 1)
    shared = materialize(shared.groupBy("n", "low", "x", "y").agg(F.min("band").alias("band")).select("band", "n"), "shared-bands")
    members = lookup(bands, shared, ["band"], "n", how="inner").join(classes.select("node", "size"), "node")
    rows = _in_blocks(materialize(members.select(F.col("band").alias("group"), "node", "size", (F.col("n") <= SIGN_BLOCK).alias("whole")), "band-members"), threshold, SIGN_BLOCK)
    discard(bands)
    rows = rows.join(classes.select("node", "size", "signature"), "node").select("group", "left", "right", "side", "node", "size", "signature")
    rows = rows.repartitionByRange("group", "left", "right").sortWithinPartitions("group", "left", "right")
    return materialize(connected_components(materialize(rows.mapInArrow(_survivors(threshold, tolerance), "a long, b long"), "survivors")), "candidates")


def _links(left: list, right: list, threshold: float, limits: list[int], same: bool) -> Iterator[tuple[int, int]]:
    """Positions of the similar pairs of two blocks; a block with itself gives each pair once."""
    sizes = [np.array([len(x[3]) for x in side]) for side in (left, right)]
    small, large = np.minimum.outer(*sizes), np.maximum.outer(*sizes)
    alive = small + SLACK >= threshold * large
    if same:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    i, j = np.nonzero(alive)
    matches = np.zeros(len(i), np.int32)
    signs = [np.stack([x[2] for x in side]) for side in (left, right)]
    for step, limit in enumerate(limits):
        at = slice(step * STEP, (step + 1) * STEP)
        for lo in range(0, len(i), 65536):
            part = slice(lo, lo + 65536)
            matches[part] += (signs[0][i[part], at] == signs[1][j[part], at]).sum(axis=1, dtype=np.int32)
        keep = matches > limit
        i, j, matches = i[keep], j[keep], matches[keep]
    if len(i) * 4 < len(left) + len(right):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            common = len(np.intersect1d(left[a][3], right[b][3], assume_unique=True))
            if common + SLACK >= threshold * (len(left[a][3]) + len(right[b][3]) - common):
                yield a, b
        return
    # many pairs: all intersections at once, over slices of the shingles that more than one set has
    rows = left if same else left + right
    flat = np.concatenate([x[3] for x in rows])
    names, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.nonzero(times > 1)[0]
    number = np.full(len(names), -1)
    number[shared] = np.arange(len(shared))
    column, owner = number[column], np.repeat(np.arange(len(rows)), [len(x[3]) for x in rows])
    common = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(shared), 8192):
        inside = (column >= lo) & (column < lo + 8192)
        m = np.zeros((len(rows), min(8192, len(shared) - lo)), np.float32)
        m[owner[inside], column[inside] - lo] = 1
        common += m[: len(left)] @ (m if same else m[len(left) :]).T
    met = common[i, j]
    good = met + SLACK >= threshold * (sizes[0][i] + sizes[1][j] - met)
    yield from zip(i[good].tolist(), j[good].tolist(), strict=True)


def _compare(threshold: float, tolerance: float):
    """Rows sorted by group and pair of blocks: (group, left, right, side, node, copies, signature, words) -> (node, links, link_docs, root)."""

    def settle(key: tuple | None, rows: list, limits: list[int]) -> Iterator[tuple[int, int, int, int]]:
        seen, sides = set(), ([], [])
        for side, node, copies, sign, words in rows:
            if (side, node) not in seen:  # a row that occurs twice in docs
                seen.add((side, node))
                sides[side].append((node, copies, np.frombuffer(sign, np.uint16), shingles(words)))
        same = key is None or key[1] == key[2]
        if not sides[0] or not (same or sides[1]):
            return
        left, right = sides[0], sides[0] if same else sides[1]
        every = left if same else left + right
        shift = 0 if same else len(left)
        root, links, docs = list(range(len(every))), [0] * len(every), [0] * len(every)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in _links(left, right, threshold, limits, same):
            b += shift
            links[a], links[b], docs[a], docs[b] = links[a] + 1, links[b] + 1, docs[a] + every[b][1], docs[b] + every[a][1]
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
        for x, (node, *_) in enumerate(every):
            if links[x]:
                yield node, links[x], docs[x], every[top(x)][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits, key, rows, out = prune_limits(threshold, tolerance), None, [], []

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["node", "links", "link_docs", "root"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for k, words in zip(zip(*cols, strict=True), _words_of(batch, 7), strict=True):
                if k[:3] != key:
                    out += settle(key, rows, limits)
                    key, rows = k[:3], []
                    if len(out) > 50_000:
                        yield flush()
                        out = []
                rows.append((*k[3:], words.copy()))
        out += settle(key, rows, limits)
        if out:
            yield flush()

    return run


def _row_key() -> dict[str, Column]:
    return {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, row_uid, text_hash, class_id, class_size, n_links, n_link_docs, group_id, group_size, kept.

    class_id is the smallest doc_id of the texts with the same shingle set, n_links the number of other classes at the threshold or
    above, n_link_docs their rows. group_id is the smallest doc_id that links lead to, group_size the group's rows; kept is true of
    exactly one row of a group, one with the group_id. Words are lower-case and split at white space; a text of fewer than five words is
    one shingle; texts without a word (null, empty) are one class without links. Rows of one doc_id and text are copies like any other.
    Null doc_ids come after all others. Other columns are ignored. An empty table gives no rows.
    """
    key = [c.alias(n) for n, c in _row_key().items()]
    worded = docs.select(*key, word_hashes(F.col("text").cast("string")).alias("words"))
    sketches = materialize(worded.mapInArrow(_sketch, "doc_id long, text_hash long, print binary, size int, signature binary").withColumn("row_uid", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_uid", "text_hash"))
    classes = sketches.groupBy("print").agg(first.alias("first"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "print", "copies", "size", "signature", F.col("first.doc_id").alias("class_id"), F.col("first.row_uid").alias("class_uid"), F.col("first.text_hash").alias("text_hash")), "classes")

    component = candidates(classes, threshold, tolerance)
    held = classes.join(component, "node").select("node", "component", "size")
    totals = materialize(held.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total")), "components")
    held = lookup(held, totals, ["component"], "n").select(F.col("component").alias("group"), "node", "size", ((F.col("n") <= BLOCK) & (F.col("total") <= BLOCK_SHINGLES)).alias("whole"))
    dealt = materialize(_in_blocks(materialize(held, "component-members"), threshold, BLOCK, BLOCK_SHINGLES), "dealt")
    texts = docs.select(*key, F.col("text").cast("string").alias("text")).withColumnsRenamed({"doc_id": "t_id", "text_hash": "t_hash"})
    wanted = classes.join(component, "node").select("node", "copies", "signature", "class_id", "text_hash")
    members = texts.join(wanted, F.col("t_id").eqNullSafe(F.col("class_id")) & (F.col("t_hash") == F.col("text_hash"))).select("node", "copies", "signature", "text")
    rows = materialize(members, "members").join(dealt, "node").select("group", "left", "right", "side", "node", "copies", "signature", "text")
    # by range, as a hash would put several pairs of a large group in one task
    sorted_rows = rows.repartitionByRange("group", "left", "right").sortWithinPartitions("group", "left", "right").select("group", "left", "right", "side", "node", "copies", "signature", word_hashes(F.col("text")).alias("words"))
    found = materialize(sorted_rows.mapInArrow(_compare(threshold, tolerance), "node long, links long, link_docs long, root long"), "links")

    # counts and groups of the classes that have links
    counts = found.groupBy("node").agg(F.sum("links").alias("n_links"), F.sum("link_docs").alias("n_link_docs"))
    grouped = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    ranked = classes.select("node", "print", "copies", "class_id", "class_uid").join(counts, "node", "left").join(grouped, "node", "left")
    ranked = materialize(ranked.withColumn("component", F.coalesce("component", "node")), "ranked")
    of_group = materialize(ranked.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("no_id"), "class_id", "class_uid")).alias("g"), F.sum("copies").alias("group_size"), F.count("*").alias("n_classes")), "groups")
    result = lookup(ranked, of_group, ["component"], "n_classes")
    result = materialize(result.select("print", "class_id", F.col("copies").alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_link_docs", F.lit(0)).alias("n_link_docs"), F.col("g.class_id").alias("group_id"), F.col("g.class_uid").alias("group_uid"), "group_size"), "class-results")
    out = lookup(sketches.select("doc_id", "row_uid", "text_hash", "print"), result, ["print"], "class_size")
    return out.select("doc_id", "row_uid", "text_hash", "class_id", "class_size", "n_links", "n_link_docs", "group_id", "group_size", (F.col("row_uid") == F.col("group_uid")).alias("kept"))


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of docs that are kept, with their own columns: of each group, and of equal rows, one. See jaccard_join for nulls, ties and empty texts."""
    return keep_rows(docs, jaccard_join(docs, threshold, tolerance), _row_key())
