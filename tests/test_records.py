"""Merging, rules, files, graphs and streams."""

from __future__ import annotations

import heapq
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import text as T
from sparkgauge.plans import QUERIES
from sparkgauge.operators import graph, merge
from sparkgauge.sources import files

SHARD = "provider string, maze string, trial long, ts string, shard long, at long, evaluated boolean, success boolean, has_error boolean"
KEYS = ["provider", "maze", "trial"]


def shards(spark, rows):
    return spark.createDataFrame([("p", m, 0, ts, shard, i, e, s, err) for i, (m, ts, shard, e, s, err) in enumerate(rows)], SHARD)


def best(spark, rows):
    return {r.maze: r for r in merge.keep_best(shards(spark, rows), KEYS, "evaluated", "ts", [F.col("at")]).collect()}


def test_keep_best(spark):
    got = best(spark, [("agree", "1", 0, True, True, False), ("agree", "1", 1, True, True, False), ("err", "1", 0, False, None, True), ("err", "0", 1, True, True, False), ("late", "2", 0, True, True, False), ("late", "9", 1, False, None, True), ("time", "1", 0, True, True, False), ("time", "2", 9, True, True, False), ("none", None, 3, True, True, False)])
    assert got["agree"].copies == 2 and got["agree"].shard == 0
    assert got["err"].evaluated and got["late"].evaluated and got["time"].shard == 9 and got["none"].shard == 3


def test_conflicts_compare_with_the_running_best(spark):
    rows = [("cross", "1", 0, True, True, False), ("cross", "2", 1, True, False, False), ("again", "1", 5, True, True, False), ("again", "2", 5, True, False, False), ("calm", "1", 0, True, True, False), ("calm", "2", 1, False, None, True)]
    got = merge.conflicts(shards(spark, rows), KEYS, "evaluated", "success", "ts", "shard", [F.col("at")]).collect()
    assert sorted((r.maze, r.kind) for r in got) == [("again", "re_execution"), ("cross", "cross_shard")]


def test_plans_shards_and_missing_units(spark):
    provider, maze = (spark.createDataFrame([(v,) for v in vs], f"{n} string") for n, vs in (("provider", "ab"), ("maze", "qrstuvwxyz")))
    units = merge.planned_units(provider, maze, 3)
    plan = merge.ordinals(units, "provider", "maze", "trial").collect()
    assert len({(r.provider, r.maze, r.trial) for r in plan}) == 60
    for p in "ab":
        mine = sorted((r for r in plan if r.provider == p), key=lambda r: r.ordinal)
        assert [r.ordinal for r in mine] == list(range(30)) and all(len({r.maze for r in mine[i : i + 3]}) == 1 for i in range(0, 30, 3))
    parts = [merge.shard(merge.ordinals(units, "provider", "maze", "trial"), i, 7).collect() for i in range(7)]
    assert sum(map(len, parts)) == 60 and max(map(len, parts)) - min(map(len, parts)) <= 2
    with pytest.raises(ValueError):
        merge.shard(units, 7, 7)
    done = spark.createDataFrame([("a", "q", 0, False), ("a", "q", 1, True)], "provider string, maze string, trial long, has_error boolean")
    assert merge.missing_units(units, done, KEYS, "has_error").count() == 59


CASES = [
    ('{"points": [{"x": 0, "y": 1}, {"x": 0.5, "y": 0.5, "z": 3}, {"x": 1, "y": 0}]}', None), ("null", "arguments must be an object"), (None, "arguments must be an object"), ("[1]", "arguments must be an object"), ('{"q": 1}', "missing required 'points' array"), ('{"points": {}}', "'points' must be an array"),
    ('{"points": [{"x": 0, "y": 0}]}', "too few points (1 < 2)"), (json.dumps({"points": [{"x": 0, "y": 0}] * 513}), "too many points (513 > 512)"), ('{"points": [{"x": 0, "y": 0}, [1]]}', "point 1 is not an object"), ('{"points": [{"x": 0}, {"x": 0, "y": 0}]}', "point 0 is missing 'y'"),
    ('{"points": [{"x": "0.1", "y": 0}, {"x": 0, "y": 0}]}', "point 0 'x' is not a number"), ('{"points": [{"x": 0, "y": true}, {"x": 0, "y": 0}]}', "point 0 'y' is not a number"), ('{"points": [{"x": 0, "y": 0}, {"x": -0.01, "y": 1.01}]}', "point 1 'x' is outside [0, 1]"),
]


def test_submissions_are_rejected_by_the_first_fault(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, body string")
    got = {r.i: r.e for r in rows.select("i", T.submission_error(F.try_parse_json("body")).alias("e")).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[1] for c in CASES]


def test_rules_need_both_kinds_of_evidence(spark):
    g = {"outside_fraction": 0.0, "first_outside": None, "spacing_cv": 1.0, "points": 20, "mean_segment": 10.0, "reversals": 0, "revisit": 0.0, "start_error": 1.0, "start_radius": 14.0}

    def modes(trace, started=True, free=True, progress=0.0, **k):
        cols = {n: F.lit(v).cast("double") for n, v in (g | k).items()}
        t = F.lit(trace).cast("string")
        return spark.range(1).select(T.classify(t, T.lexical_hits(t), cols, F.lit(started).cast("boolean"), F.lit(free).cast("boolean"), F.lit(progress)).alias("m")).first().m

    inverted = "the walls are the paths here"
    assert modes(inverted, outside_fraction=0.5, first_outside=0.1, free=False)[0] == "figure_ground_inversion"
    assert modes(inverted)[0] == "wrong_branch"  # said, but the path disagrees
    assert modes(None, free=False) == ["clearance_failure"] and modes(None, free=False, outside_fraction=0.1) == ["corridor_departure"]
    assert modes("x = 3", started=False)[0] == "endpoint_misidentification" and modes("x = 3", started=None) == ["wrong_branch"]
    assert modes("I thought about it.")[0] == "procedural_template" and modes("we backtrack", reversals=1)[0] == "exploration_leakage"
    assert modes("x = 3", progress=0.7, outside_fraction=0.05)[0] == "near_miss_precision"


def test_quotes_and_small_text_helpers(spark):
    row = spark.range(1).select(
        T.quotes(F.lit("So\nthe path. There are NO collisions at all, this path is clear."), "fabricated_verification").alias("q"), T.usage(F.lit('{"prompt_tokens": 7.9, "x": 1}'), T.USAGE_IN).alias("u"), T.usage(F.lit("{}"), T.USAGE_IN).alias("z"),
        T.scrub(F.lit("a/b/c"), {"a/": "", "b/": "_"}).alias("s"), T.first_nonblank(F.lit("  "), F.lit("x")).alias("n"), T.backoff(F.lit(9.0), 2.0, 60.0, F.lit(0.5)).alias("w"), T.redact(F.create_map(F.lit("api_KEY"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("m"),
    ).first()
    assert len(row.q) == 2 and "NO collisions" in row.q[0] and "\n" not in row.q[0]
    assert (row.u, row.z, row.s, row.n, row.w, row.m) == (7, 0, "a/_c", "x", 30.0, {"b": "2"})


def test_files(spark, tmp_path):
    lines = ['{"provider": "p", "maze": "a", "trial": 0, "reasoning": "r"}', "", '{"provider": "q", "error": "x"}', '{"provider": "p", "maze"']
    (tmp_path / "run" / "leg").mkdir(parents=True)
    (tmp_path / "run" / "leg" / "attempts.jsonl").write_text("\n".join(lines))
    rows = files.read_jsonl(spark, f"file://{tmp_path}/run/leg/attempts.jsonl", files.ATTEMPT)
    c = files.census(rows).first()
    assert (c.rows, c.malformed, c.errors, c.traces, c.evaluated, c.providers) == (2, 1, 1, 1, 0, ["p", "q"]) and files.good(rows).count() == 2
    (tmp_path / "ids.txt").write_text(" a ,b,,#c\n#d,e\n\n")
    assert sorted(r.id for r in files.read_ids(spark, f"file://{tmp_path}/ids.txt").collect()) == ["a", "b", "e"]
    before = files.inventory(spark, f"file://{tmp_path}/run").collect()
    assert [(r.path, r.leg) for r in before] == [("leg/attempts.jsonl", "leg")]
    held = spark.createDataFrame(before)
    (tmp_path / "run" / "leg" / "attempts.jsonl").write_text("changed")
    assert [r.problem for r in files.verify(held, files.inventory(spark, f"file://{tmp_path}/run")).collect()] == ["changed"]


def test_routes_match_a_heap(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(40), rng.randrange(40), round(rng.random() * 9, 3)) for _ in range(70)]
    best, heap = {}, [(0.0, 1)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in best:
            best[v] = d
            for a, b, w in edges:
                for p, q in ((a, b), (b, a)):
                    if p == v:
                        heapq.heappush(heap, (d + w, q))
    df = spark.createDataFrame(edges, "a long, b long, w double")
    got = {r.node: r.dist for r in graph.shortest(df, 1).collect()}
    assert got.keys() == best.keys() and all(abs(got[v] - best[v]) < 1e-9 for v in best)
    assert {r.node for r in graph.bfs(df, 1).collect()} == set(best)
    route = spark.createDataFrame([(0, 0, edges[0][0]), (0, 1, edges[0][1])], "route_id long, at long, node long")
    assert graph.route_length(df, route).first().length <= edges[0][2]
    with pytest.raises(Exception, match="no edge"):
        graph.route_length(df, spark.createDataFrame([(0, 0, 1), (0, 1, 999)], "route_id long, at long, node long")).collect()


def test_equal_graphs_have_equal_labels(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0)]
    renamed = [(9 - a, 9 - b, w) for a, b, w in edges]
    label = lambda e: sorted(r.label for r in graph.wl_labels(spark.createDataFrame(e, "a long, b long, w double")).collect())
    assert label(edges) == label(renamed) != label(edges[:3])


def test_hints_never_hide_a_match():
    import re

    rng = random.Random(3)
    said = ["walls are paths", "it is actually open", "inverted wall", "bands represent walls", "hidden connection", "teleport", "likely connected", "assume a gap", "there must be a gap", "radius of 3", "step through angles", "polar sweep", "smooth arc", "arc path", "counterclockwise", "at angle 3", "nodes connected", "adjacency", "let's identify nodes", "dead-end avoid", "this is not the correct path", "backtrack", "go back to the start", "from the starting point go", "checked all", "verified the full", "no collision", "stays within the corridor", "this path is safe", "i'm confident in this path", "checking its integrity", "no obstruction along", "each node connects correctly", "can be approximate", "good enough", "maybe so. ok", "fine. ", "not sure so submit", "i'll trust", "approximate route", "no dead ends on the way", "confirmed every"]
    for mode, patterns in T.LEXICAL.items():
        for _ in range(300):
            low = " ".join(rng.sample(said, 3))
            if any(re.search(p, low) for p in patterns):
                assert any(h in low for h in T.HINTS[mode]), (mode, low)


def test_all_documents_are_searched(spark, tmp_path):
    """Every language, letter and null; Python's patterns are the brute force."""
    texts = [("de", "Die Wände sind Wege. good enough für mich."), ("fr", "caféwalls are paths. dételeport, é backtrack"), ("en", "naïve: no collisions. the thin line looks blue"), (None, "dead end, wrong"), ("es", None), ("en", "plain")] * 4
    spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    turns = [[(100.0 + (i * j) % 50) for j in range(64)] for i in range(len(texts))]
    spark.createDataFrame([(i, 0, v) for i, v in enumerate(turns)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    phrases = ["this path is clear. ", "assume a gap here. ", "good enough, i'll commit to it. ", "the walls are the paths. ", "node A and node B, adjacency. ", "we backtrack. ", "x = 12. ", ""]
    traces = {i: (phrases[i % 8] + (t or "")).lower() for i, (_, t) in enumerate(texts)}
    met = lambda patterns, t: any(re.search(p, t) for p in patterns)
    sf = str(tmp_path)
    assert {r.doc_id: r.modes for r in QUERIES["lexical_hits"](spark, sf).collect()} == {i: ",".join(m for m, ps in T.LEXICAL.items() if met(ps, t)) for i, t in traces.items()}
    assert {r.doc_id: r.perceptual for r in QUERIES["perceptual_flag"](spark, sf).collect()} == {i: met(T.PERCEPTUAL, t) for i, t in traces.items()}
    assert {r.doc_id for r in QUERIES["classify_modes"](spark, sf).collect()} == set(traces)
