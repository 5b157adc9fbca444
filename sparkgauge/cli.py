"""Command line: merge shards, take an inventory, build and verify splits, select an evaluation set, print the leaderboard.

    python -m sparkgauge.cli merge OUT SHARD...     exit code 1 on cross-shard conflicts or canaries
    python -m sparkgauge.cli inventory ROOT
    python -m sparkgauge.cli build OUT --slots 16 / verify OUT
    python -m sparkgauge.cli evalset INDEX OUT --seed 0
    python -m sparkgauge.cli leaderboard ATTEMPTS
    python -m sparkgauge.cli run CONFIG INDEX --shard 0/4 --done LOG...     the units still to be run, in order (a dry run: nothing is called)
    python -m sparkgauge.cli styleswap WORLDS OUT --styles notebook,volcanic
    python -m sparkgauge.cli archive ROOT OUT / check-archive OUT --live ROOT
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.estimators import pass_at_k
from .operators import generate, merge, render, select
from .sources import archive, files

KEYS = ["provider", "maze", "trial"]


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Good rows of attempt logs with what merging needs; arrival is the file's name, then the line's place in it."""
    rows = files.good(files.read_jsonl(spark, paths, files.ATTEMPT))
    place = F.dense_rank().over(_by("source")).cast("long")
    has_error = F.coalesce("error", F.lit("")) != ""
    return rows.withColumns({"evaluated": F.col("evaluation").isNotNull() & ~has_error, "success": F.coalesce("evaluation.success", F.lit(False)), "has_error": has_error, "file_no": place, "line_no": F.monotonically_increasing_id()})


def _by(column: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(*KEYS).orderBy(column)


def run_merge(spark: SparkSession, out: str, shards: list[str]) -> int:
    rows = load(spark, shards)
    arrival = [F.col("file_no"), F.col("line_no")]
    files.write_merged(merge.keep_best(rows, KEYS, "evaluated", "timestamp", arrival).drop("file_no", "line_no", "source"), out, KEYS)
    clashes = merge.conflicts(rows, KEYS, "evaluated", "success", "timestamp", "shard", arrival)
    legs = merge.per_leg(rows, "provider", "evaluated", "success", "has_error", "maze", F.coalesce("evaluation.efficiency_canary", F.lit(False)))
    legs.show(100, False)
    worst = clashes.where(F.col("kind") == "cross_shard").limit(5).collect()
    for r in worst:
        print("conflict:", r.provider, r.maze, r.trial)
    return int(bool(worst) or not legs.where(F.size("canary_tasks") > 0).isEmpty())


def leaderboard(rows: DataFrame) -> DataFrame:
    """Macro pass@1, and pass@8 over tasks with eight scored attempts."""
    cells = rows.where(~F.col("has_error")).groupBy("provider", "maze").agg(F.count("*").alias("n"), F.count_if("success").alias("c"))
    eight = F.when(F.col("n") >= 8, pass_at_k(F.greatest("n", F.lit(8)), F.col("c"), 8))
    return cells.groupBy("provider").agg(F.round(100 * F.avg(F.col("c") / F.col("n")), 1).alias("pass1"), F.round(100 * F.avg(eight), 1).alias("pass8"), F.sum("n").alias("attempts")).orderBy(F.desc("pass1"), "provider")


def plan(spark: SparkSession, config: str, index: str, shard: str = "0/1", done: list[str] | None = None, trials: int | None = None) -> DataFrame:
    """The units of a shard that are still to be run, in order: provider, maze, trial, ordinal. done: logs whose rows without an error count as run."""
    providers, default = files.read_run_config(spark, config)
    mazes = files.good(files.read_jsonl(spark, index, files.TASK_INDEX)).select(F.col("task_id").alias("maze"))
    units = merge.planned_units(providers.where("enabled").select("provider"), mazes, trials or default)
    units = merge.ordinals(units, "provider", "maze", "trial")
    i, n = (int(x) for x in shard.split("/"))
    units = merge.shard(units, i, n)
    if done:
        units = merge.missing_units(units, load(spark, files.discover(spark, done)), KEYS, "has_error")
    return units.orderBy("provider", "ordinal")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkgauge", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    for name, positional in {"merge": ["out", "shards"], "inventory": ["root"], "build": ["out"], "verify": ["out"], "evalset": ["index", "out"], "leaderboard": ["attempts"], "run": ["config", "index"], "styleswap": ["worlds", "out"], "archive": ["root", "out"], "check-archive": ["out"]}.items():
        q = sub.add_parser(name)
        for a in positional:
            q.add_argument(a, nargs="+" if a in ("shards", "attempts") else None)
        q.add_argument("--slots", type=int, default=16)
        q.add_argument("--seed", type=int, default=0)
        q.add_argument("--shard", default="0/1")
        q.add_argument("--trials", type=int)
        q.add_argument("--done", nargs="*")
        q.add_argument("--styles", default=",".join(render.STYLES))
        q.add_argument("--live", dest="live_root")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("sparkgauge").getOrCreate()
    if a.command == "merge":
        try:
            return run_merge(spark, a.out, files.discover(spark, a.shards))
        except FileNotFoundError as none:
            print(none)
            return 1
    if a.command == "check-archive":
        problems = archive.verify(spark, a.out, a.live_root)
        problems.show(1000, False)
        return int(not problems.isEmpty())
    if a.command == "run":
        plan(spark, a.config, a.index, a.shard, a.done, a.trials).show(1000, False)
    elif a.command == "styleswap":
        render.style_swap(spark.read.parquet(a.worlds).where(F.col("rejection").isNull()), a.styles.split(","), a.seed).write.mode("overwrite").parquet(a.out)
    elif a.command == "archive":
        archive.build(spark, a.root, a.out).orderBy("leg").show(1000, False)
    elif a.command == "inventory":
        files.inventory(spark, a.root).groupBy("leg").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).orderBy("leg").show(1000, False)
    elif a.command == "build":
        generate.build_split(spark, a.slots, base=a.seed).write.mode("overwrite").parquet(a.out)
    elif a.command == "verify":
        return int(not generate.verify_split(spark, spark.read.parquet(a.out), base=a.seed).isEmpty())
    elif a.command == "evalset":
        chosen = select.select_eval_set(files.good(files.read_jsonl(spark, a.index, files.TASK_INDEX)), select.SelectionSpec(), a.seed)
        chosen.select("task_id").orderBy("task_id").coalesce(1).write.mode("overwrite").text(a.out)  # a hundred ids
    else:
        leaderboard(load(spark, a.attempts)).show(100, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
