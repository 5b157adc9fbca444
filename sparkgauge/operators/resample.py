"""Seeded resampling and regression of clusters (tasks), for any number of clusters in a group and any number of groups.

Clusters of a group are dealt into blocks by a hash, and each block is packed into one row. A replicate draws as many
clusters as there are, with replacement: how many of them fall into each block is one multinomial draw, which every task
repeats from the seed, and a block then draws its own. Statistics that are sums over clusters need one pass, after which
only a row per replicate and block is shuffled; Newton's method needs one such pass a step, for all replicates at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut

RESAMPLES = 10_000
#: Clusters of a block, and numbers of a temporary array of weights.
BLOCK, AT_ONCE = 1 << 15, 1 << 21


def in_blocks(values: DataFrame, group: Column | None, cluster: str, stats: Column, size: int | None = None) -> DataFrame:
    """A row for each block of a group's clusters: grp, block, sizes (of all blocks of the group), stats (an array of doubles per cluster, in order of clusters).

    Each cluster has one row in values. Blocks are cut by a hash of the cluster, so they don't depend on how rows are spread.
    """
    rows = values.select((F.lit(0) if group is None else group).alias("grp"), F.col(cluster).alias("cluster"), stats.cast("array<double>").alias("stats"))
    rows = cut(rows, "clusters")
    most = rows.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    block = F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-most // (size or BLOCK)))))
    packed = rows.groupBy("grp", block.alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("cluster", "stats"))), lambda x: x["stats"]).alias("stats"))
    packed = cut(packed, "blocks")
    sizes = packed.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("block", F.size("stats").cast("long").alias("n")))).alias("sizes"))
    joined = packed.withColumnRenamed("grp", "__g").join(sizes, F.col("__g").eqNullSafe(F.col("grp")))
    return cut(joined.select("grp", "block", "sizes", "stats"), "blocks")


def draws(mine: int, sizes: Sequence[int], resamples: int, seed: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """How often each cluster of a block is drawn, a row a replicate, some replicates at a time; sizes are those of all blocks, mine is its place among them."""
    n, total = sizes[mine], sum(sizes)
    step = max(1, AT_ONCE // n)
    shares = np.random.default_rng(seed)
    for a in range(0, resamples, step):
        c = min(step, resamples - a)
        if len(sizes) == 1:
            at, rep = rng.integers(0, n, size=(c, n)).ravel(), np.repeat(np.arange(c), n)
        else:
            own = shares.multinomial(total, np.array(sizes) / total, size=c)[:, mine]
            at, rep = rng.integers(0, n, size=int(own.sum())), np.repeat(np.arange(c), own)
        yield np.bincount(rep * n + at, minlength=c * n).reshape(c, n).astype(float)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, list[int], np.ndarray, int]]:
    """group, place, sizes and statistics of each block, and its number."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, block = batch.column(2)[i].as_py(), batch.column(1)[i].as_py()
            stats = batch.column(3)[i].values
            matrix = stats.flatten().to_numpy(zero_copy_only=False).reshape(len(stats), -1)
            yield batch.column(0).slice(i, 1), [x["block"] for x in sizes].index(block), [x["n"] for x in sizes], matrix, block


def replicates(blocks: DataFrame, width: int, resamples: int, seed: int = 0, flips: bool = False) -> DataFrame:
    """grp, replicate, s0, s1, ...: sums of each statistic over the clusters that a replicate draws; replicate -1 has every cluster once.

    With flips, f too: the sum of the first statistic under random signs, for a sign-flip test. The sums of blocks are
    added in the cluster; for a group of one block the draws are numpy's for that seed.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, mine, sizes, stats, block in _blocks(batches):
            rng = np.random.default_rng(seed) if len(sizes) == 1 else np.random.default_rng([seed, block])
            sums = np.concatenate([stats.sum(0)[None], *(w @ stats for w in draws(mine, sizes, resamples, seed, rng))])
            out = {"grp": grp.take(pa.array(np.zeros(len(sums), np.int64))), "replicate": pa.array(np.arange(-1, resamples))}
            out |= {f"s{k}": pa.array(np.ascontiguousarray(sums[:, k])) for k in range(width)}
            if flips:
                step = max(1, AT_ONCE // len(stats))
                parts = [rng.choice([-1.0, 1.0], size=(min(step, resamples - a), len(stats))) @ stats[:, 0] for a in range(0, resamples, step)]
                out["f"] = pa.array(np.concatenate([stats[:, :1].sum(0), *parts]))
            yield pa.record_batch(out)

    names = [f"s{k}" for k in range(width)] + ["f"] * flips
    kind = blocks.schema["grp"].dataType.simpleString()
    rows = blocks.mapInArrow(kernel, f"grp {kind}, replicate long, {', '.join(f'{n} double' for n in names)}")
    return rows.groupBy("grp", "replicate").agg(*[F.sum(n).alias(n) for n in names])


def _between(value: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    return tuple(F.percentile(F.when(F.col("replicate") >= 0, value), F.lit(q)) for q in (alpha / 2, 1 - alpha / 2))


def _known(value: Column) -> Column:
    return F.max(F.when(F.col("replicate") < 0, value))


def bootstrap_ci(values: DataFrame, group: str, task: str, value: str, resamples: int = RESAMPLES, seed: int = 0, size: int | None = None) -> DataFrame:
    """group, mean, lo, hi of each group's task values; null values are left out, and a group without others gives no row."""
    blocks = in_blocks(values.where(F.col(value).isNotNull()), F.col(group), task, F.array(F.col(value), F.lit(1.0)), size)
    mean = F.col("s0") / F.col("s1")
    low, high = _between(mean)
    return replicates(blocks, 2, resamples, seed).groupBy(F.col("grp").alias(group)).agg(_known(mean).alias("mean"), low.alias("lo"), high.alias("hi"))


def paired_bootstrap(values: DataFrame, group: str, task: str, value: str, resamples: int = RESAMPLES, seed: int = 0, size: int | None = None) -> DataFrame:
    """group, tasks, diff, lo, hi, p of each group's paired differences, one a task. Sums that differ by rounding only are ties."""
    blocks = in_blocks(values.where(F.col(value).isNotNull()), F.col(group), task, F.array(F.col(value), F.lit(1.0)), size)
    sums = cut(replicates(blocks, 2, resamples, seed, flips=True), "replicates")
    mean = F.col("s0") / F.col("s1")
    low, high = _between(mean)
    seen = sums.groupBy("grp").agg(_known(F.col("s1")).cast("long").alias("tasks"), _known(mean).alias("diff"), low.alias("lo"), high.alias("hi"))
    flipped = sums.where("replicate >= 0").select(F.col("grp").alias("__g"), "f").join(seen, F.col("__g").eqNullSafe(F.col("grp")))
    far = F.round(F.abs(F.col("f") / F.col("tasks")), 9) >= F.round(F.abs("diff"), 9)
    return flipped.groupBy("grp", "tasks", "diff", "lo", "hi").agg(F.avg(far.cast("double")).alias("p")).withColumnRenamed("grp", group)


def logistic_fit(spark: SparkSession, rows: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """Standardised coefficients over rows of any number, by spark.ml: moments and the fit are distributed.

    Returns term, beta, odds_ratio.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    held = VectorAssembler(inputCols=columns, outputCol="raw").transform(rows.select(*columns, F.col(outcome).cast("double").alias("label")))
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(held).transform(held)
    model = LogisticRegression(maxIter=50, regParam=0.0, standardization=False).fit(scaled)
    terms = [("intercept", float(model.intercept)), *zip(columns, map(float, model.coefficients), strict=True)]
    return spark.createDataFrame([(t, b, float(np.exp(b))) for t, b in terms], "term string, beta double, odds_ratio double")


def logistic_ci(spark: SparkSession, counts: DataFrame, task: str, columns: list[str], resamples: int = 400, seed: int = 0, size: int | None = None) -> DataFrame:
    """Coefficients with task-clustered intervals: term, beta, lo, hi.

    counts: one row per task with its predictors, n and c (successes); weighted rows give the same fit as single attempts.
    Every replicate standardises its own draw. A step of Newton's method is one pass over the blocks of tasks for all replicates;
    a row per replicate, resamples * (columns + 1)^2 numbers in all, comes to the driver, which solves the steps.
    """
    blocks = in_blocks(counts.where(F.col("n") > 0).na.drop(subset=[*columns, "n", "c"]), None, task, F.array(*columns, "n", "c"), size)
    d, p = len(columns), len(columns) + 1
    beta, moments = np.zeros((resamples + 1, p)), np.zeros((resamples + 1, 1 + 2 * d))
    moments[:, 0] = 1.0
    for first in range(2):  # means, then deviations from them
        for r, x in _summed(blocks, lambda x, w, a, m=moments.copy(), f=first: _moments(x, w, m[a : a + len(w)], d, f), 1 + d, resamples, seed):
            moments[r + 1, 1 + d * first : 1 + d * (first + 1)] = np.array(x[1:]) / max(x[0], 1)
    scale = np.sqrt(moments[:, 1 + d :])
    scale = np.where(scale > 0, scale, 1)
    for _ in range(50):
        total = np.zeros((resamples + 1, p + p * p))
        for r, x in _summed(blocks, lambda x, w, a, b=beta.copy(): _newton(x, w, b[a : a + len(w)], moments[a : a + len(w), 1 : 1 + d], scale[a : a + len(w)]), p + p * p, resamples, seed):
            total[r + 1] = x
        step = np.linalg.solve(total[:, p:].reshape(-1, p, p) + 1e-6 * np.eye(p), (total[:, :p] - 1e-6 * beta)[:, :, None])[:, :, 0]
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    low, high = np.quantile(beta[1:], [0.025, 0.975], axis=0)
    return spark.createDataFrame([(t, float(beta[0, k]), float(low[k]), float(high[k])) for k, t in enumerate(["intercept", *columns])], "term string, beta double, lo double, hi double")


def _moments(x: np.ndarray, w: np.ndarray, known: np.ndarray, d: int, second: int) -> np.ndarray:
    """Per replicate: clusters, and sums of the predictors or of their squared deviations from known means."""
    total = w.sum(1, keepdims=True)
    if not second:
        return np.concatenate([total, w @ x[:, :d]], axis=1)
    return np.concatenate([total, np.einsum("rn,rnd->rd", w, (x[None, :, :d] - known[:, None, 1 : 1 + d]) ** 2)], axis=1)


def _newton(x: np.ndarray, w: np.ndarray, beta: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Per replicate: gradient and information of the weighted log-likelihood."""
    d = mean.shape[1]
    design = np.concatenate([np.ones((len(w), len(x), 1)), (x[None, :, :d] - mean[:, None]) / scale[:, None]], axis=2)
    rate = 1 / (1 + np.exp(-np.clip(np.einsum("rnp,rp->rn", design, beta), -30, 30)))
    n, c = x[:, d], x[:, d + 1]
    gradient = np.einsum("rnp,rn->rp", design, w * (c - n * rate))
    information = np.einsum("rnp,rnq->rpq", design * (w * np.maximum(rate * (1 - rate), 1e-8) * n)[:, :, None], design)
    return np.concatenate([gradient, information.reshape(len(w), -1)], axis=1)


def _summed(blocks: DataFrame, of: object, width: int, resamples: int, seed: int) -> Iterator[tuple[int, list[float]]]:
    """For replicate -1, all clusters once, and each drawn one: sums over blocks of what ``of`` says of a block, its weights and its first replicate's place."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mine, sizes, stats, block in _blocks(batches):
            rng, at = np.random.default_rng([seed, block]), 0
            for weights in ([np.ones((1, len(stats)))], draws(mine, sizes, resamples, seed, rng)):
                for w in weights:
                    step = max(1, AT_ONCE // (8 * len(stats)))
                    for a in range(0, len(w), step):
                        values = of(stats, w[a : a + step], at)
                        yield pa.record_batch({"replicate": pa.array(np.arange(at - 1, at - 1 + len(values))), **{f"s{k}": pa.array(np.ascontiguousarray(values[:, k])) for k in range(width)}})
                        at += len(values)

    rows = blocks.mapInArrow(kernel, f"replicate long, {', '.join(f's{k} double' for k in range(width))}")
    for r in rows.groupBy("replicate").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).collect():
        yield r[0], list(r[1:])


def variance_ci(cells: DataFrame, topology: str, style: str, rate: str, resamples: int = 2000, seed: int = 0, size: int | None = None) -> DataFrame:
    """part, share, lo, hi: shares with intervals from resampling topologies. cells has a row per topology and style.

    Styles are a bounded dimension, topologies are not: each becomes a row of sums from which the shares of any draw follow.
    Cells without a rate are left out.
    """
    held = cells.where(F.col(rate).isNotNull()).select(F.col(topology).alias("t"), F.col(style).alias("s"), F.col(rate).cast("double").alias("g"))
    styles = sorted(r.s for r in held.select("s").distinct().collect())
    rows = held.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("s", "g"))).alias("m"), F.avg("g").alias("row"), F.sum("g").alias("sum"), F.count("g").cast("double").alias("n"))
    of = lambda s: F.try_element_at("m", F.lit(s))
    per = [F.coalesce(of(s), F.lit(0.0)) for s in styles] + [of(s).isNotNull().cast("double") for s in styles] + [F.coalesce(of(s) - F.col("row"), F.lit(0.0)) for s in styles]
    rest = F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, g: a + F.pow(g - F.col("row"), 2.0))
    stats = F.array(F.col("sum"), F.col("n"), F.col("row"), F.pow("row", 2.0), F.lit(1.0), rest, *per)
    k = len(styles)
    sums = replicates(in_blocks(rows, None, "t", stats, size), 6 + 3 * k, resamples, seed)
    whole = F.col("s0") / F.col("s1")
    column = [F.when(F.col(f"s{6 + k + i}") > 0, F.col(f"s{6 + i}") / F.col(f"s{6 + k + i}")) for i in range(k)]
    total = lambda parts: sum((F.coalesce(x, F.lit(0.0)) for x in parts), F.lit(0.0))
    a = k * (F.col("s3") - 2 * whole * F.col("s2") + whole * whole * F.col("s4"))
    b = F.col("s4") * total(F.pow(c - whole, 2.0) for c in column)
    c = F.col("s5") + total(F.pow(x - whole, 2.0) * F.col(f"s{6 + k + i}") - 2 * (x - whole) * F.col(f"s{6 + 2 * k + i}") for i, x in enumerate(column))
    parts = sums.select("replicate", F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.when(a + b + c > 0, v / (a + b + c)).otherwise(F.lit(0.0)).alias("share")) for n, v in (("topology", a), ("style", b), ("interaction", c))])).alias("x"))
    low, high = _between(F.col("x.share"))
    return parts.groupBy(F.col("x.part").alias("part")).agg(_known(F.col("x.share")).alias("share"), low.alias("lo"), high.alias("hi"))
