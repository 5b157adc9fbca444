"""Near pairs of segments against all pairs, with crowded and with empty space."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import spatial
from sparkgauge.operators.spatial import near_counts, near_pairs


def to_segment(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / size)) if size else 0.0
    return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2


def squared(s, t):
    a, b, c, d = s[:2], s[2:], t[:2], t[2:]
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
        return 0.0
    return min(to_segment(a, c, d), to_segment(b, c, d), to_segment(c, a, b), to_segment(d, a, b))


def scattered(seed, n, wide):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.uniform(-wide, wide), r.uniform(-wide, wide)
        long = r.choice([0, 0.5, 3, wide])
        out.append((r.choice("ab"), i, (x, y, x + r.uniform(-long, long), y + r.uniform(-long, long))))
    return out


@pytest.mark.parametrize(("seed", "n", "wide", "cap"), [(1, 250, 40, 10), (2, 250, 40, 4096), (3, 120, 0.4, 7), (4, 150, 5, 3)])
def test_pairs_are_those_of_all_pairs(spark, seed, n, wide, cap):
    """The third case has all segments in one cell of the width of the distance, so it is dealt into blocks."""
    rows, reach = scattered(seed, n, wide), 1.5
    df = spark.createDataFrame([(g, i, *map(float, e), -i) for g, i, e in rows], "g string, id long, x0 double, y0 double, x1 double, y1 double, note long")
    got = {(r.a, r.b): r for r in near_pairs(df, ["g"], "id", ["x0", "y0", "x1", "y1"], reach, apart=["note"], cap=cap).collect()}
    want = {(i, j): squared(e, f) for g, i, e in rows for h, j, f in rows if g == h and i < j and squared(e, f) < reach * reach}
    assert got.keys() == want.keys() and len(want) > 20
    for k, r in got.items():
        assert math.isclose(r.squared, want[k], abs_tol=1e-9) and (r.a_note, r.b_note) == (-k[0], -k[1])


def test_no_pair_is_found_twice_and_counts_agree(spark):
    df = spark.range(400).select(F.lit("g").alias("g"), "id", (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    pairs = near_pairs(df, ["g"], "id", ["x", "y", "x", "y"], 1.2, cap=8)
    assert pairs.count() == pairs.distinct().count() == 2 * 20 * 19
    counts = near_counts(pairs, ["g"])
    assert counts.agg(F.sum("near")).first()[0] == 4 * 20 * 19 and {r.near for r in counts.select("near").distinct().collect()} == {2, 3, 4}


def test_heap_in_one_place_has_small_keys(spark):
    """A thousand equal points: every pair is an answer, but no join key owns more than a block or two of rows."""
    df = spark.range(300).select(F.lit(1).alias("g"), "id", F.lit(3.0).alias("x"))
    pairs = near_pairs(df, ["g"], "id", ["x", "x", "x", "x"], 1.0, cap=32)
    assert pairs.count() == 300 * 299 // 2 and pairs.where("squared <> 0").isEmpty()


def test_nulls_repeated_keys_and_empty_tables(spark):
    schema = "g string, id long, x double, y double"
    df = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 1, 0.0, 0.0), ("a", None, 0.0, 0.0), ("a", 2, None, 0.0), (None, 3, 0.0, 0.0), (None, 4, 0.0, 0.0), ("b", 5, 0.0, 0.0)], schema)
    assert near_pairs(df, ["g"], "id", ["x", "y", "x", "y"], 1.0).collect() == []
    assert near_pairs(df.limit(0), ["g"], "id", ["x", "y", "x", "y"], 1.0).collect() == []


@pytest.mark.parametrize(("seed", "n", "wide", "least"), [(1, 250, 40, 16), (2, 200, 0.4, 8), (3, 150, 5000, 4), (4, 60, 5, 1024)])
def test_tallies_are_those_of_all_pairs(spark, monkeypatch, seed, n, wide, least):
    """With copies and points among the segments, in several blocks and tiles; long segments are not dealt to every cell of their boxes."""
    monkeypatch.setattr(spatial, "BLOCK_LEAST", least)
    monkeypatch.setattr(spatial, "TILE", (8, 16))
    rows, reach = scattered(seed, n, wide), 1.5
    rows += [(g, n + i, e) for g, i, e in rows[:40]] + [("b", 2 * n + i, rows[0][2]) for i in range(5)]
    ends = ["x0", "y0", "x1", "y1"]
    df = spark.createDataFrame([(g, *map(float, e)) for g, _, e in rows] + [(None, 0.0, 0.0, 0.0, 0.0), ("a", None, 0.0, 0.0, 0.0)], "g string, x0 double, y0 double, x1 double, y1 double")
    got = spatial.near_tallies(df, ["g"], ends, reach).collect()
    assert len(got) == len({(g, e) for g, _, e in rows}) and sum(r.copies for r in got) == len(rows)
    for r in got:
        d = [squared((r.x0, r.y0, r.x1, r.y1), e) for g, _, e in rows if g == r.g]
        above = [x for x in d if 0 < x < reach * reach]
        assert (r.near, r.touched) == (sum(x < reach * reach for x in d), d.count(0.0))
        assert r.nearest is None if not above else math.isclose(r.nearest, min(above), abs_tol=1e-9)


def test_tallies_of_an_empty_table(spark):
    assert spatial.near_tallies(spark.createDataFrame([], "g long, x double, y double, u double, v double"), ["g"], ["x", "y", "u", "v"], 1.0).collect() == []


def test_tallies_compare_a_small_share_of_all_pairs(monkeypatch):
    """Four times the segments make 16 times the pairs; those that are compared grow by less than 11, and two regions make the whole."""
    compared = []
    tiles = spatial.Tally._tiles
    monkeypatch.setattr(spatial.Tally, "_tiles", lambda self, i, j: compared.append(len(i) * len(j)) or tiles(self, i, j))
    shares = []
    for n in (1000, 4000):
        e = np.random.default_rng(n).normal(0, 50, (n, 4))
        compared.clear()
        found = [spatial.Tally(e, np.ones(n, np.int64), np.zeros(n), 0.01, (32, 1024)).run(region, 1) for region in (0, 1)]
        shares.append(sum(compared))
        some = range(0, n, n // 20)
        assert [int(sum(t.crossed[i] + t.near[i] for t in found)) for i in some] == [sum(squared(tuple(e[i]), tuple(f)) < 1e-4 for f in e) for i in some]
    assert shares[1] < 11 * shares[0]
