"""Centroid clustering by kd-tree filtering, in whole numbers.

Every partition cuts its vectors into blocks and builds a balanced kd-tree over each; nodes hold counts, sums and boxes.
The trees are written once, and every round reads them with the centroids in hand: a node drops each centroid that is
strictly farther than another one from every point of its box, gives all its vectors away when one centroid is left, and
hands the rest down; leaves compare their vectors with what is left. Tasks return a sum and a count per centroid, so a
round moves centroids * dimensions numbers a task, however many vectors there are and however often one is repeated.
All arithmetic is in integers, so the outcome doesn't depend on how the rows are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Vectors of a tree and of a leaf at most: a tree of 64 dimensions takes 2 MB or so.
BLOCK, LEAF = 4096, 32
#: Numbers of a temporary array while nodes are compared with centroids.
AT_ONCE = 1 << 20
TREE = "ids array<bigint>, size int, points binary, counts binary, sums binary, low binary, high binary"


def limit(dims: int) -> int:
    """The largest component, positive or negative, for which every squared distance between corners and centroids fits a long: 2^26 at 64 dimensions."""
    return 1 << ((58 - (dims - 1).bit_length()) // 2)


def whole(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component as a long, held within limit(dims) on both sides."""
    most = F.lit(limit(dims)).cast("bigint")
    return F.transform(vector, lambda x: F.greatest(-most, F.least(most, F.floor(x.cast("double") * scale))))


def usable(vector: Column, dims: int) -> Column:
    """Exactly dims components, each of them finite and not null; a null vector isn't usable."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, finite), F.lit(False))


def _bounds(n: int) -> list[np.ndarray]:
    """For each level of a tree over n points, where its nodes begin and the last one ends."""
    depth = max(0, (-(-n // LEAF) - 1).bit_length())
    return [(np.arange((1 << k) + 1, dtype=np.int64) * n) >> k for k in range(depth + 1)]


def build(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points along the leaves, and counts, sums and boxes of all nodes, level by level from the root."""
    n, order, levels = len(points), np.arange(len(points)), _bounds(len(points))
    for at, below in zip(levels[:-1], levels[1:], strict=True):
        for a, middle, b in zip(at[:-1], below[1::2], at[1:], strict=True):
            mine = points[order[a:b]]
            axis = int(np.argmax(mine.max(0) - mine.min(0)))
            order[a:b] = order[a:b][np.argpartition(mine[:, axis], middle - a)]
    sorted_points, starts = points[order], levels[-1][:-1]
    nodes = [{"sums": np.add.reduceat(sorted_points, starts), "low": np.minimum.reduceat(sorted_points, starts), "high": np.maximum.reduceat(sorted_points, starts)}] if n else []
    for _ in levels[:-1]:
        below = nodes[0]
        nodes.insert(0, {"sums": below["sums"][::2] + below["sums"][1::2], "low": np.minimum(below["low"][::2], below["low"][1::2]), "high": np.maximum(below["high"][::2], below["high"][1::2])})
    return order, {k: np.concatenate([x[k] for x in nodes]) for k in ("sums", "low", "high")} | {"counts": np.concatenate([np.diff(at) for at in levels])}


def _trees(dims: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.Array, np.ndarray]] = []
        n = 0

        def tree() -> pa.RecordBatch:
            points = np.concatenate([p for _, p in waiting])
            order, nodes = build(points)
            ids = pa.concat_arrays([i for i, _ in waiting]).take(pa.array(order))
            row = {"points": points[order].astype("<i4"), **{k: v.astype("<i8") for k, v in nodes.items()}}
            return pa.record_batch({"ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "size": pa.array([len(order)], pa.int32()), **{k: pa.array([row[k].tobytes()], pa.binary()) for k in ("points", "counts", "sums", "low", "high")}})

        for batch in batches:
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for a in range(0, len(points), BLOCK):
                piece = slice(a, min(a + BLOCK - n, len(points)))
                rest = slice(piece.stop, min(a + BLOCK, len(points)))
                for part in (piece, rest):
                    if part.stop > part.start:
                        waiting.append((batch.column(0).slice(part.start, part.stop - part.start), points[part]))
                        n += part.stop - part.start
                    if n == BLOCK:
                        yield tree()
                        waiting.clear()
                        n = 0
        if n:
            yield tree()

    return make


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all centroids; floats where they are exact, as their product is faster."""
    most = max(1, *(int(np.abs(x).max(initial=0)) for x in (points, centroids)))
    kind = np.float64 if 4 * points.shape[1] * most * most < 1 << 53 else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)


def farther(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Per box and centroid: is it strictly farther than another living one from every point of the box?

    The other one is the nearest to the middle. The difference of two squared distances is linear in the point, so it is
    least at a corner of the box.
    """
    twice = ((2 * centroids[None] - (low + high)[:, None]) ** 2).sum(2)
    best = np.argmin(np.where(alive, twice, np.iinfo(np.int64).max), axis=1)
    towards = centroids[None] - centroids[best][:, None]
    reach = np.where(towards > 0, towards * high[:, None], towards * low[:, None]).sum(2)
    norms = (centroids * centroids).sum(1)
    return norms[None] - norms[best][:, None] - 2 * reach > 0


def walk(points: np.ndarray, nodes: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Filter one tree: (node, first, end, centroid) of the nodes given away whole, and positions and centroids of the points resolved in leaves."""
    k, levels = len(centroids), _bounds(len(points))
    frontier, alive, given, base = np.zeros(1, np.int64), np.ones((1, k), bool), [], 0
    step = max(1, AT_ONCE // centroids.size)
    for depth, at in enumerate(levels):
        where = base + frontier
        for a in range(0, len(frontier), step):
            part = slice(a, a + step)
            alive[part] &= ~farther(nodes["low"][where[part]], nodes["high"][where[part]], centroids, alive[part])
        single = alive.sum(1) == 1
        given += [(int(base + j), int(at[j]), int(at[j + 1]), int(c)) for j, c in zip(frontier[single], np.argmax(alive[single], axis=1), strict=True)]
        frontier, alive = frontier[~single], alive[~single]
        if depth + 1 < len(levels):
            frontier, alive, base = np.stack([2 * frontier, 2 * frontier + 1], 1).ravel(), np.repeat(alive, 2, axis=0), base + len(at) - 1
    at = levels[-1]
    sizes = at[frontier + 1] - at[frontier]
    inside = np.repeat(at[frontier] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    far = np.where(np.repeat(alive, sizes, axis=0), _distances(points[inside], centroids), np.iinfo(np.int64).max)
    return given, inside, np.argmin(far, axis=1) if len(inside) else np.zeros(0, np.int64)


def _read(row: dict, dims: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    matrix = lambda x, kind: np.frombuffer(x, kind).astype(np.int64).reshape(-1, dims)
    return matrix(row["points"], "<i4"), {k: matrix(row[k], "<i8") for k in ("sums", "low", "high")} | {"counts": np.frombuffer(row["counts"], "<i8")}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i] for name in batch.schema.names} | {k: batch.column(k)[i].as_buffer() for k in ("points", "counts", "sums", "low", "high")}


def _totals(centroids: np.ndarray):
    """Per task: count and sums of every centroid's vectors, as rows (centroid, at, value); at -1 has the count."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for row in _rows(batches):
            points, nodes = _read(row, dims)
            given, inside, nearest = walk(points, nodes, centroids)
            for node, _, _, c in given:
                count[c] += nodes["counts"][node]
                sums[c] += nodes["sums"][node]
            count += np.bincount(nearest, minlength=k)
            np.add.at(sums, nearest, points[inside])
        met = np.flatnonzero(count)
        value = np.concatenate([count[met, None], sums[met]], axis=1)
        yield pa.record_batch({"centroid": pa.array(np.repeat(met, dims + 1).astype(np.int32)), "at": pa.array(np.tile(np.arange(-1, dims, dtype=np.int32), len(met))), "value": pa.array(value.ravel())})

    return add


def _assignments(centroids: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            points, nodes = _read(row, centroids.shape[1])
            given, inside, nearest = walk(points, nodes, centroids)
            cluster = np.empty(len(points), np.int64)
            cluster[inside] = nearest
            for _, a, b, c in given:
                cluster[a:b] = c
            distance = ((points - centroids[cluster]) ** 2).sum(1)
            yield pa.record_batch({"vec_id": row["ids"].values, "cluster": pa.array(cluster.astype(np.int32)), "distance": pa.array(distance)})

    return assign


def forest(vectors: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """The trees of all usable vectors, written to the shared folder: a row a tree."""
    rows = vectors.where(usable(F.col(vector), dims)).select(F.col(vec_id).cast("bigint").alias("ids"), whole(F.col(vector), dims, scale).alias("points"))
    return materialize(rows.mapInArrow(_trees(dims), TREE), "kd-trees")


def first_centroids(vectors: DataFrame, vec_id: str, vector: str, k: int, dims: int, scale: int) -> np.ndarray:
    """The k usable vectors of least sha256 of ``1:<vec_id>``, in its order; equal ids by their components, and vectors without an id never."""
    rows = vectors.where(usable(F.col(vector), dims) & F.col(vec_id).isNotNull()).select(F.sha2(F.concat(F.lit("1:"), F.col(vec_id).cast("bigint").cast("string")).cast("binary"), 256).alias("hash"), whole(F.col(vector), dims, scale).alias("start"))
    return np.array([r.start for r in rows.orderBy("hash", "start").limit(k).collect()], dtype=np.int64).reshape(-1, dims)


def moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid's floored mean of its vectors; one without vectors stays. k * (dims + 1) sums come to the driver."""
    out = centroids.copy()
    totals = trees.mapInArrow(_totals(centroids), "centroid int, at int, value bigint").groupBy("centroid", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    counts = {r.centroid: int(r.value) for r in totals if r["at"] < 0}
    for r in totals:
        if r["at"] >= 0:
            out[r.centroid, r["at"]] = int(r.value) // counts[r.centroid]
    return out


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (its components).

    Vectors that are null or have another number of components, a null, NaN or infinite one, give no row; all others give
    one each: repeated rows and equal ids count as vectors of their own, a null id too (but it starts no centroid).
    Components beyond limit(dims) after scaling, 2^26 at 64 dimensions, are held at it. Fewer usable vectors than k start
    fewer centroids; vectors of equal distance go to the smaller number. An empty table, or one without an id, gives no rows.
    Other columns of vectors aren't read. Only the k centroids and their totals come to the driver, which are broadcast too.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, vec_id, vector, k, dims, scale)
    out = f"{vec_id} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>"
    if not len(centroids):
        return spark.createDataFrame([], out)
    trees = forest(vectors, vec_id, vector, dims, scale)
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    rows = materialize(trees.mapInArrow(_assignments(centroids), "vec_id bigint, cluster int, distance bigint"), "assignments")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    inertia = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"))
    inertia = {r.cluster: int(r.inertia) for r in inertia.select("cluster", F.least(most, "inertia").alias("inertia")).collect()}
    total = min((1 << 63) - 1, sum(inertia.values()))
    known = spark.createDataFrame([(c, i, total, list(map(int, centroids[c]))) for c, i in inertia.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    known = known.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256))
    joined = rows.join(F.broadcast(known), "cluster")  # k rows at most
    return joined.select(F.col("vec_id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
