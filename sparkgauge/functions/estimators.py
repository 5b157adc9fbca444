"""Estimators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased chance that one of k of n attempts, c of them good, is good; 1 if fewer than k are bad; an error if k > n."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    miss = F.aggregate(steps, F.lit(1.0), lambda a, i: a * (n - c - i).cast("double") / (n - i).cast("double"))
    return F.when(n < k, F.raise_error(F.lit("k exceeds the attempts"))).when(n - c < k, F.lit(1.0)).otherwise(F.lit(1.0) - miss)


def binomial_two_sided(a: Column, b: Column) -> Column:
    """Exact two-sided binomial p at one half for a against b discordant pairs; 1 without any. Sums in logs, so large counts don't overflow."""
    n, low = (a + b).cast("double"), F.least(a, b)
    # log of C(n, i) / 2^n by lgamma would need a UDF; the running product of (n - j) / (j + 1) stays in logs instead
    logs = F.aggregate(
        F.sequence(F.lit(0), low.cast("int")),
        F.struct((n * F.log(F.lit(0.5))).alias("term"), F.lit(0.0).alias("total")),
        lambda s, i: F.struct((s["term"] + F.when(i < low, F.log(F.greatest(n - i, F.lit(1.0)) / (i + 1))).otherwise(0.0)).alias("term"), (s["total"] + F.exp(s["term"])).alias("total")),
        lambda s: s["total"],
    )
    return F.when(a + b == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * logs))


def nearest_rank(values: Column, percent: float) -> Column:
    """Nearest-rank percentile of an array, index rounded half to even; NaN for an empty one. Use on bounded groups."""
    ordered = F.array_sort(values)
    index = F.least(F.size(values) - 1, F.rint(F.lit(percent / 100.0) * (F.size(values) - 1)).cast("int"))
    return F.when(F.size(values) == 0, F.lit(float("nan"))).otherwise(F.get(ordered, index))


def hash_index(parts: list[Column], n: Column) -> Column:
    """A number below n from the MD5 of parts: a reproducible draw, the same on any engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long"), n)
