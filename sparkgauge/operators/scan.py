"""Running totals along sorted keys, and order statistics on top of them, where a key may own any share of the rows.

A window per key puts a key into one task, which is right for keys of a task's size. The rows of larger keys are dealt by
ranges of key and order, so such a key spreads over as many blocks as it needs. Each block folds its own part of a key; a
key can only reach beyond a block as its first or last one, so the parts that need a carry are fewer than twice the blocks:
these are folded along the blocks and broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import cut

#: Keys of no more rows than this, or than a mean shuffle partition, stay whole. Rows are counted by this many hashes of their keys.
LARGE, HASHES = 1 << 17, 1 << 16
HOW = {"sum": (F.sum, lambda a, b: F.coalesce(a, b * 0) + F.coalesce(b, a * 0)), "max": (F.max, F.greatest), "min": (F.min, F.least)}


@dataclass(frozen=True)
class Fold:
    """A sum, max or min of value over rows of the same key: up to a row, before it (null where nothing is), or all of them. Nulls are passed over."""

    value: Column
    how: str = "sum"
    rows: str = "upto"

    def over(self, by: Sequence[str], order: Sequence[Column | str]) -> Column:
        frame = {"upto": (Window.unboundedPreceding, 0), "before": (Window.unboundedPreceding, -1), "all": (Window.unboundedPreceding, Window.unboundedFollowing)}[self.rows]
        return HOW[self.how][0](self.value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*frame))


def segmented_scan(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], folds: dict[str, Fold]) -> DataFrame:
    """rows with a column for each fold, along ``order`` within the rows of equal ``keys``.

    Null keys are a key of their own. Rows that are equal in order come one after the other in some order; in large keys they are dealt
    over several blocks like others. Columns of rows that have the name of a fold are replaced. Rows of large keys are written
    out once, with what their block alone says; besides, only HASHES counts come to the driver.
    """
    given = [c for c in rows.columns if c not in folds]
    hashed = F.pmod(F.xxhash64(*keys), F.lit(HASHES))
    sizes = {r.h: r["count"] for r in rows.groupBy(hashed.alias("h")).count().collect()}
    limit = max(LARGE, sum(sizes.values()) // int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    large = [(h,) for h, n in sizes.items() if n > limit]
    whole = lambda df: df.withColumns({name: f.over(keys, order) for name, f in folds.items()}).select(*given, *folds)
    if not large:
        return whole(rows)
    heavy = F.broadcast(rows.sparkSession.createDataFrame(large, "__h long"))  # HASHES rows at most
    rest = rows.join(heavy, hashed == F.col("__h"), "left_anti")
    return whole(rest).unionByName(_in_blocks(rows.join(heavy, hashed == F.col("__h"), "left_semi"), keys, order, folds, given))


def _in_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], folds: dict[str, Fold], given: Sequence[str]) -> DataFrame:
    names = {name: f"__{i}" for i, name in enumerate(folds)}
    dealt = rows.withColumns({f"{n}v": folds[name].value for name, n in names.items()}).drop(*[c for c in folds if c in rows.columns]).withColumn("__tie", F.monotonically_increasing_id())
    along = [*order, "__tie"]
    blocks = dealt.repartitionByRange(*keys, *along).withColumn("__block", F.spark_partition_id())
    inner = {name: Fold(F.col(f"{n}v"), folds[name].how, folds[name].rows) for name, n in names.items()}
    local = blocks.withColumns({names[name]: f.over(["__block", *keys], along) for name, f in inner.items()})
    table = cut(local.select(*given, "__block", *[x for n in names.values() for x in (n, f"{n}v")]), "scan")
    carry = _carries(table, keys, inner, names)
    on = F.col("__block") == F.col("__b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = table.join(F.broadcast(carry), on, "left")  # fewer rows than twice the blocks
    value = lambda name, n: F.coalesce(F.col(f"{n}c"), F.col(n)) if folds[name].rows == "all" else HOW[folds[name].how][1](F.col(f"{n}c"), F.col(n))
    return joined.select(*given, *[value(name, n).alias(name) for name, n in names.items()])


def _carries(table: DataFrame, keys: Sequence[str], folds: dict[str, Fold], names: dict[str, str]) -> DataFrame:
    """For each part of a key that lies in several blocks: what the other parts bring to it."""
    key = F.struct(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)])
    ends = table.groupBy("__block").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends = ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("__end")).groupBy("__end").count().where(F.col("count") > 1)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__end.__k{i}"))
    parts = table.join(F.broadcast(ends.select("__end")), on, "left_semi").groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"))
    totals = parts.agg(*[HOW[f.how][0](f"{names[name]}v").alias(f"{names[name]}t") for name, f in folds.items()])
    by = [f"__k{i}" for i in range(len(keys))]
    return totals.select(*by, "__b", *[Fold(F.col(f"{names[name]}t"), f.how, "all" if f.rows == "all" else "before").over(by, ["__b"]).alias(f"{names[name]}c") for name, f in folds.items()])


def nearest_ranks(values: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float], count: str | None = None) -> DataFrame:
    """keys, percent, value: the value whose place in sorted order is nearest to percent / 100 of the last place, ties to the even place.

    Rows are first reduced to counts by value, so repeated values cost nothing; a key's different values may fill any number of
    blocks. count names a column of multiplicities. Null values don't count, and a key without others gives no row.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg((F.sum(count) if count else F.count("*")).alias("__k"))
    ranked = segmented_scan(counted, keys, ["value"], {"__upto": Fold(F.col("__k")), "__n": Fold(F.col("__k"), rows="all")})
    index = F.least(F.col("__n") - 1, F.rint(F.col("percent") / 100.0 * (F.col("__n") - 1)).cast("long"))
    each = ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    return each.where((index < F.col("__upto")) & (index >= F.col("__upto") - F.col("__k"))).select(*keys, "percent", "value")
