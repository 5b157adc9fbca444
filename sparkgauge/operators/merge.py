"""Merging shards of attempt records: which duplicate stays, where duplicates disagree, and what is missing.

All operators are keyed aggregations, prefix scans or anti-joins; keep_best and per_leg combine before the shuffle, so a key
with very many duplicates costs one row per task, and scans spread it over several.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import Fold, segmented_scan


def keep_best(rows: DataFrame, keys: Sequence[str], evaluated: str, ts: str, arrival: Sequence[Column]) -> DataFrame:
    """One row per key: an evaluated one if there is any, then the latest timestamp (as text), then the first to arrive.

    arrival: numeric columns, ascending. A missing timestamp is the empty text.
    """
    order = F.struct(F.col(evaluated).alias("e"), F.coalesce(F.col(ts), F.lit("")).alias("t"), *[(-c).alias(f"a{i}") for i, c in enumerate(arrival)])
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("best"), F.count("*").alias("copies"))
    return best.select(*keys, "best.*", "copies")


def conflicts(rows: DataFrame, keys: Sequence[str], evaluated: str, success: str, ts: str, shard: str, arrival: Sequence[Column]) -> DataFrame:
    """Every row that disagrees with the best of the earlier rows of its key, both evaluated: key, arrival, kind.

    kind is cross_shard, or re_execution within one shard. The running best is a prefix scan, so a key may have any number of rows.
    """
    first = [x for i, c in enumerate(arrival) for x in (c.isNull().alias(f"n{i}"), (-c).alias(f"a{i}"))]
    rank = F.struct(F.col(evaluated).alias("e"), F.coalesce(F.col(ts), F.lit("")).alias("t"), *first, F.col(success).alias("s"), F.col(shard).alias("sh"))
    seen = segmented_scan(rows, keys, arrival, {"arrival": Fold(F.lit(1).cast("long")), "best": Fold(rank, "max", "before")})
    clash = F.col("best.e") & F.col(evaluated) & (F.col("best.s") != F.col(success))
    kind = F.when(F.col("best.sh") != F.col(shard), "cross_shard").otherwise("re_execution")
    return seen.where(clash).select(*keys, "arrival", kind.alias("kind"))


def per_leg(rows: DataFrame, leg: str, evaluated: str, success: str, error: str, task: str, canary: Column) -> DataFrame:
    """Attempts, evaluated, successes and transport failures of each leg, and the sorted tasks whose canary fired."""
    total = lambda c: F.count_if(c).alias
    return rows.groupBy(leg).agg(F.count("*").alias("attempts"), total(F.col(evaluated))("evaluated"), total(F.col(success))("successes"), total(F.col(error))("transport"), F.sort_array(F.collect_set(F.when(canary, F.col(task)))).alias("canary_tasks"))


def planned_units(providers: DataFrame, tasks: DataFrame, trials: int) -> DataFrame:
    """providers x tasks x trials; both are small dimensions, and the product is the plan itself."""
    return providers.crossJoin(F.broadcast(tasks)).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)).cast("array<bigint>")))


def missing_units(units: DataFrame, recorded: DataFrame, keys: Sequence[str], error: str) -> DataFrame:
    """Planned units without a recorded row that isn't an error."""
    done = recorded.where(~F.coalesce(F.col(error), F.lit(False))).select(*keys).distinct()
    return units.join(done, list(keys), "left_anti")


def ordinals(units: DataFrame, leg: str, task: str, trial: str, seed: int = 0) -> DataFrame:
    """Dense ordinal per leg: tasks shuffled by hash, a task's trials side by side."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(leg).cast("string"), F.col(task).cast("string")))
    places = segmented_scan(units.withColumn("__shuffled", key), [leg], ["__shuffled", task, trial], {"ordinal": Fold(F.lit(1).cast("long"))})
    return places.drop("__shuffled").withColumn("ordinal", F.col("ordinal") - 1)


def shard(units: DataFrame, index: int, count: int) -> DataFrame:
    """Every count-th unit of a leg from index on; all of them for a count of one or less."""
    if count <= 1:
        return units
    if not 0 <= index < count:
        raise ValueError(f"shard {index} of {count}")
    return units.where(F.col("ordinal") % count == index)
