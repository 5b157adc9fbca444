"""The command line on small files."""

from __future__ import annotations

import json

from sparkgauge import cli
from sparkgauge.operators import generate, render


def write(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken")
    return f"file://{path}"


def row(maze, success, shard, ts="1", **more):
    return {"provider": "p", "maze": maze, "trial": 0, "timestamp": ts, "shard": shard, "evaluation": {"success": success}} | more


def test_merge_and_leaderboard(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", [row("x", True, 0), row("y", False, 0), {"provider": "p", "maze": "z", "trial": 0, "error": "late", "shard": 0}])
    b = write(tmp_path / "b.jsonl", [row("x", True, 1, "2"), row("z", True, 1)])
    out = f"file://{tmp_path}/out"
    assert cli.main(["merge", out, a, b]) == 0
    kept = {r.maze: r for r in spark.read.json(out).collect()}
    assert set(kept) == {"x", "y", "z"} and kept["x"].shard == 1 and kept["z"].success and kept["x"].copies == 2
    c = write(tmp_path / "c.jsonl", [row("y", True, 7, "3")])
    assert cli.main(["merge", out, a, c]) == 1
    board = cli.leaderboard(cli.load(spark, [a, b])).first()
    assert board.pass1 == 66.7 and board.pass8 is None


def test_build_verify_and_swap(spark, tmp_path):
    out = f"file://{tmp_path}/split"
    assert cli.main(["build", out, "--slots", "4"]) == 0 and cli.main(["verify", out]) == 0 and cli.main(["verify", out, "--seed", "9"]) == 1
    built = spark.read.parquet(out)
    from pyspark.sql import functions as F

    assert generate.leaks(built.withColumn("split", F.explode(F.array(F.lit("a"), F.lit("b"))))).count() == 4
    swapped = render.style_swap(built, ["notebook", "volcanic"]).groupBy("slot").agg(F.count("*").alias("n"), F.countDistinct("mask_sha256").alias("m")).collect()
    assert swapped and all((r.n, r.m) == (2, 1) for r in swapped)
    assert cli.main(["inventory", f"file://{tmp_path}"]) == 0
