"""Building splits, archives of runs, run plans and small documents."""

from __future__ import annotations

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge import cli
from sparkgauge.functions import text as T
from sparkgauge.operators import generate as G
from sparkgauge.operators import raster
from sparkgauge.sources import archive, files


def test_delaunay_edges_are_those_of_empty_circles():
    rng = np.random.default_rng(1)
    for _ in range(5):
        points = rng.uniform(0, 100, (12, 2))
        edges = set(G.delaunay(points, 1e9))
        for i in range(12):
            for j in range(i):
                # a pair is an edge if some circle through both holds no other point: centres on the bisector
                mid, along = (points[i] + points[j]) / 2, (points[j] - points[i])[::-1] * [-1, 1]
                low, high = -math.inf, math.inf
                for k in range(12):
                    if k not in (i, j):
                        d = points[k] - mid
                        a, b = 2 * float(d @ along), float(d @ d) - float((points[i] - mid) @ (points[i] - mid))
                        if a > 0:
                            high = min(high, b / a)
                        else:
                            low = max(low, b / a)
                assert ((i, j) in edges) == (low < high), (i, j)
    assert G.delaunay(points[:2], 1e9) == [(1, 0)] and not G.delaunay(points, 0.0)


def test_slots_fail_closed_and_are_rebuilt():
    row = G.build_slot(1, 0, 3, "rooms", 160, tier="easy")
    assert row == G.build_slot(1, 0, 3, "rooms", 160, tier="easy") and (row["tier"] == "easy") != row["tier_relaxed"]
    hard = G.build_slot(1, 0, 0, "rectilinear", 160, attempts=2, tier="easy")
    assert hard["rejection"] is None and hard["tier_relaxed"] == (hard["tier"] != "easy") and isinstance(json.loads(hard["rejections"]), list)
    world = G.with_endpoints(G.braided(np.random.default_rng(4), 160), np.random.default_rng(5))
    assert G.certify_route(world, G.route(world)) == pytest.approx(raster.path_length(G.route(world)))
    with pytest.raises(ValueError, match="optimum"):
        G.certify_route(world, [*G.route(world), (0.0, 0.0)])
    assert G.slot_tiers(7, {"easy": 0.3, "medium": 0.4}) == ["easy"] * 2 + ["medium"] * 3 + ["hard"] * 2
    for k in range(8):
        how = {"flip": k % 2 == 0, "quarters": k % 4, "turn_deg": k - 3.5, "canvas": 1.1, "width": 0.95}
        new = G.augment(world, how)
        assert G.graph_hash(new) == G.graph_hash(world) and new.size == int(160 * how["canvas"]) and all(0 <= v < new.size for p in new.nodes.values() for v in p)


def test_splits_are_verified_and_have_no_duplicates(spark, tmp_path):
    built = G.build_split(spark, 4, size=120, workers=2).persist()
    assert G.verify_split(spark, built, size=120).count() == 0
    broken = built.withColumn("graph_hash", F.when(F.col("slot") == 1, "x").otherwise(F.col("graph_hash")))
    assert [tuple(r) for r in G.verify_split(spark, broken, size=120).collect()] == [(1, "graph_hash differs")]
    taken = built.where("slot = 1").select("graph_hash")
    fresh = {r.slot: r.graph_hash for r in G.without_duplicates(built, taken, size=120).collect()}
    old = {r.slot: r.graph_hash for r in built.collect()}
    assert fresh[1] != old[1] and {k: fresh[k] for k in (0, 2, 3)} == {k: old[k] for k in (0, 2, 3)}
    files.write_tasks(files.task_documents(built, "dev"), f"file://{tmp_path}/tasks")
    tasks = files.read_tasks(spark, f"file://{tmp_path}/tasks").collect()
    assert len(tasks) == sum(v is not None for v in old.values()) >= 2 and all(t.start == t.points[0] and t.goal == t.points[-1] and 0 <= t.goal.x <= 1 and len(t.mask_sha256) == 64 for t in tasks)
    files.write_index(files.task_documents(built, "dev").select("task_id", F.get_json_object("task", "$.mask_sha256").alias("mask_sha256")), f"file://{tmp_path}/dev/index.jsonl", {"seed": 1})
    assert json.loads(spark.read.text(f"file://{tmp_path}/dev/index.jsonl-manifest").first().value)["rows"] == len(tasks)
    assert files.built_splits(spark, f"file://{tmp_path}") == ["dev"]
    built.unpersist()


def log(folder, rows, tail=""):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "attempts.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)


def test_archives(spark, tmp_path):
    root, out = tmp_path / "runs", f"file://{tmp_path}/out"
    attempt = lambda maze, **more: {"provider": "p", "maze": maze, "trial": 0, **more}
    log(root / "a", [attempt("x", raw_response="r", reasoning="t"), attempt("y")], "\n{broken\n")
    log(root / "b", [attempt("x", error="late")])
    (root / "empty").mkdir()
    got = {r.leg: r for r in archive.build(spark, f"file://{root}", out, "2100-01-01 00:00:00").collect()}
    assert set(got) == {"a", "b"} and (got["a"].archived, got["a"].malformed, got["a"].traces, got["a"].raw, got["a"].snapshot) == (4, 1, 1, 1, False)
    assert got["b"].note == "all attempts failed in transport" and not got["a"].note
    check = lambda root=None: {tuple(r) for r in archive.verify(spark, out, root).collect()}
    live = f"file://{root}"
    assert check() == check(live) == set()
    log(root / "b", [attempt("x", error="late"), attempt("z")])
    log(root / "c", [attempt("new")])
    assert check(live) == {("b", "log has grown"), ("c", "log has no copy")}
    (root / "c" / "attempts.jsonl").unlink()
    assert {r.leg: r.snapshot for r in archive.build(spark, live, out).collect()} == {"a": True, "b": True}
    three = [attempt("x", error="late"), attempt("z"), attempt("w")]
    log(root / "b", three)
    assert check(live) == set()
    log(root / "b", three[1::-1] + three[2:])
    assert check(live) == {("b", "log differs from line 1")}
    log(root / "b", three[1:2])
    assert check(live) == {("b", "log has lost lines")}
    (root / "b" / "attempts.jsonl").unlink()
    assert check(live) == {("b", "log is gone")}


def test_nested_runs_of_one_name_are_all_kept(spark, tmp_path):
    root, out = tmp_path / "all runs", f"file://{tmp_path}/out"
    legs = {"_root": root, "smoke": root / "smoke", "main/gpt/r1/shard-01": root / "main/gpt/r1/shard-01", "main/kimi+2/r1/shard-01": root / "main/kimi+2/r1/shard-01"}
    for i, folder in enumerate(legs.values()):
        log(folder, [{"provider": "p", "maze": f"m{i}", "trial": t} for t in range(i + 1)])
    live = f"file://{root}"
    got = {r.leg: r.archived for r in archive.build(spark, live, out).collect()}
    assert got == {leg: i + 1 for i, leg in enumerate(legs)}
    copies = archive._copies(spark, out).collect()
    assert {(r.leg, r.place, json.loads(r.value)["trial"]) for r in copies} == {(leg, t + 1, t) for i, leg in enumerate(legs) for t in range(i + 1)}
    assert archive.verify(spark, out, live).isEmpty()
    (root / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        archive.lines(spark, f"file://{root}/none")


def test_edits_in_long_logs_are_found_by_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "BLOCK", 10)
    monkeypatch.setattr("sparkgauge.operators.scan.LARGE", 20)
    root, out = tmp_path / "runs", f"file://{tmp_path}/out"
    rows = [{"provider": "p", "maze": "m", "trial": t} for t in range(95)]
    log(root / "long", rows)
    log(root / "torn", rows[:3], '{"provider": "p", "ma')
    live = f"file://{root}"
    archive.build(spark, live, out)
    check = lambda: {tuple(r) for r in archive.verify(spark, out, live).collect()}
    log(root / "long", [*rows, *rows])
    log(root / "torn", rows[:3], '{"provider": "p", "maze": "z"}\n{}\n')
    assert check() == set()
    log(root / "long", [*rows[:57], {"provider": "p", "maze": "edited", "trial": 57}, *rows[58:]])
    log(root / "torn", rows[:3], '{"another": 1}\n')
    assert check() == {("long", "log differs from line 51"), ("torn", "log differs from line 1")}
    log(root / "long", [*rows[:20], rows[21], rows[20], *rows[22:]])
    log(root / "torn", rows[:3], '{"provider": "p", "ma')
    assert check() == {("long", "log differs from line 21")}


def test_damaged_copies_and_manifests_are_found(spark, tmp_path):
    root, out = tmp_path / "runs", tmp_path / "out"
    for leg in "ab":
        log(root / leg, [{"provider": leg, "maze": "m", "trial": t} for t in range(3)])
    archive.build(spark, f"file://{root}", f"file://{out}", "2100-01-01 00:00:00")
    check = lambda: {tuple(r) for r in archive.verify(spark, f"file://{out}").collect()}
    assert check() == set()
    (copy,) = (out / "runs/leg=a").glob("part-*")
    for crc in (out / "runs/leg=a").glob(".*.crc"):
        crc.unlink()
    copy.write_bytes(gzip.compress(gzip.decompress(copy.read_bytes()).replace(b"2", b"7")))
    assert check() == {("a", "copy differs from line 1")}
    for f in (out / "runs/leg=b").iterdir():
        f.unlink()
    assert check() == {("a", "copy differs from line 1"), ("b", "copy is missing")}


def test_discovery_and_run_plans(spark, tmp_path):
    log(tmp_path / "s1", [{"provider": "p", "maze": "m1", "trial": 0}, {"provider": "p", "maze": "m2", "trial": 0, "error": "x"}])
    (tmp_path / "s2").mkdir()
    assert files.discover(spark, [f"file://{tmp_path}/s*", f"file://{tmp_path}/none"]) == [f"file:{tmp_path}/s1/attempts.jsonl"]
    with pytest.raises(FileNotFoundError):
        files.discover(spark, [f"file://{tmp_path}/s2"])
    assert cli.main(["merge", f"file://{tmp_path}/o", f"file://{tmp_path}/s2"]) == 1
    (tmp_path / "run.json").write_text(json.dumps({"providers": {"p": {"type": "a", "model": "m"}, "q": {"enabled": False}}, "trials": 2}))
    (tmp_path / "index.jsonl").write_text("".join(json.dumps({"task_id": f"m{i}"}) + "\n" for i in range(3)))
    config, index = f"file://{tmp_path}/run.json", f"file://{tmp_path}/index.jsonl"
    whole = cli.plan(spark, config, index).collect()
    assert [r.ordinal for r in whole] == list(range(6)) and {r.provider for r in whole} == {"p"}
    halves = [{(r.maze, r.trial) for r in cli.plan(spark, config, index, f"{i}/2").collect()} for i in range(2)]
    assert len(halves[0]) == 3 and not halves[0] & halves[1]
    left = {(r.maze, r.trial) for r in cli.plan(spark, config, index, done=[f"file://{tmp_path}/s1"]).collect()}
    assert left == {(r.maze, r.trial) for r in whole} - {("m1", 0)}


def test_small_documents(spark, tmp_path):
    d = spark.createDataFrame([(640, 480, [5.0, 1.0, 2.0, 9.0]), (None, 480, [])], "w int, h int, ys array<double>")
    got = d.select(T.coordinate_clause(F.col("w"), F.col("h")).alias("c"), T.coordinate_clause().alias("p"), T.spread_labels(F.col("ys")).alias("y")).collect()
    assert got[0].c.endswith("(px/640, py/480).") and got[1].c == got[1].p == got[0].p and got[1].y == []
    assert got[0].y == pytest.approx([1.0, 3.6, 6.2, 9.0])
    v = spark.createDataFrame([("p", "x", 0, "wrong_branch", ["near_miss"], ["a quote"], {"outside": 0.123456})], "provider string, maze string, trial int, primary string, secondary array<string>, evidence array<string>, measures map<string,double>")
    files.write_verdicts(v, f"file://{tmp_path}/v")
    assert json.loads(spark.read.text(f"file://{tmp_path}/v").first().value) == {"provider": "p", "maze": "x", "trial": 0, "primary": "wrong_branch", "secondary": ["near_miss"], "evidence": ["a quote"], "measures": {"outside": 0.1235}}
