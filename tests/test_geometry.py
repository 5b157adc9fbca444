"""Polyline functions and raster kernels."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import geometry as G
from sparkgauge.operators import generate as N
from sparkgauge.operators import raster as R


def line(*points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_lengths_and_projection(spark):
    assert one(spark, G.cumulative(line((0, 0), (3, 0), (3, 4)))) == [0, 3, 7]
    at = lambda p, *pts: tuple(one(spark, G.project(line(p)[0], line(*pts))))
    assert at((5, 2), (0, 0), (10, 0)) == (5, 2, 0)
    assert at((5, 1), (0, 0), (10, 0), (10, 2), (0, 2))[0] == 5  # the earlier of two equal passes
    assert at((3, 4), (0, 0)) == (0, 5, 0)
    assert one(spark, F.size(G.densify(line((0, 0), (10, 0)), 3.0))) == 5


def test_route_progress(spark):
    progress = lambda stop, *route, ok=False, started=True: one(spark, G.route_progress(F.lit(ok), F.lit(started), line(stop)[0], line(*route)))
    straight = ((0, 0), (100, 0))
    assert progress((50, 0), *straight) == pytest.approx(0.5, abs=0.02) and progress((10, 0), *straight) == pytest.approx(0.1, abs=0.02)
    assert progress((500, 0), *straight) == 1 and progress((70, 0), *straight, started=False) == 0 and progress((7, 0), *straight, ok=True) == 1
    assert progress((100, 50), (0, 0), (100, 0), (100, 100)) == pytest.approx(0.75, abs=0.02) and progress((1, 1), (0, 0), (0, 0)) == 0


def test_turns_variation_walk_downsample(spark):
    bends = line((0, 0), (10, 0), (10, 10), (10, 10), (20, 10), (30, 11))
    assert one(spark, G.turn_count(bends)) == 1
    assert one(spark, F.size(G.turn_angles(line((0, 0), (1, 0))))) == 0
    assert one(spark, G.variation(F.array(F.lit(2.0), F.lit(2.0)))) == 0 and one(spark, G.variation(F.array().cast("array<double>"))) == 0
    end = one(spark, F.element_at(G.walk(line((0, 0), (10, 0), (10, 10)), 0.75), -1))
    assert (end.x, end.y) == (10, 5)
    assert [p.x for p in one(spark, G.downsample(line(*[(i, 0) for i in range(11)]), 3))] == [0, 5, 10]
    assert one(spark, F.size(G.disk(3))) == len(R.disk(3)) == 29


def test_walk_makes_lengths_once_and_agrees_with_a_loop(spark):
    """The lengths stand in the expression a single time, outside of any lambda over points, so time is linear in the points."""
    rng = random.Random(5)
    bends = [[(rng.randrange(9), rng.randrange(9)) for _ in range(n)] for n in (1, 2, 3, 40, 400)] + [[(3, 3)] * 4, [(0, 0), (0, 0), (4, 0), (4, 0)]]
    df = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in b]) for i, b in enumerate(bends)], "i int, pts array<struct<x: double, y: double>>")
    for share in (0.0, 0.3, 0.5, 1.0):
        walked = df.select("i", G.walk(F.col("pts"), share).alias("w"))
        assert walked._jdf.queryExecution().analyzed().toString().lower().count("hypot") == 1
        for r in walked.collect():
            pts = bends[r.i]
            at = [0.0]
            for a, b in zip(pts, pts[1:]):
                at.append(at[-1] + math.hypot(b[0] - a[0], b[1] - a[1]))
            want = [p for p, d in zip(pts, at) if d <= at[-1] * share]
            if (k := len(want)) < len(pts) and at[-1] * share > at[k - 1]:
                t = (at[-1] * share - at[k - 1]) / (at[k] - at[k - 1])
                want.append(tuple(u + (v - u) * t for u, v in zip(pts[k - 1], pts[k])))
            assert [c for p in r.w for c in (p.x, p.y)] == pytest.approx([c for p in want for c in p])


U = R.draw(200, 200, [([(20, 20), (20, 180), (180, 180), (180, 20)], 15)])
ROUTE = [(20, 20), (20, 180), (180, 180), (180, 20)]
score = lambda pts, mask=U: R.evaluate(pts, mask, (20, 20), (180, 20), 10, 10, reference=480)


def test_scoring_on_a_u_corridor():
    good = score(ROUTE)
    assert good["success"] and good["efficiency"] == 1 and not good["efficiency_canary"]
    assert not score([(20, 20), (180, 20)])["collision_free"]
    assert not score([(20, 20), (26, 174), (100, 170), (180, 180), (180, 20)])["success"]
    assert not score(ROUTE[:3])["ends_correctly"] and not score([(60, 60), *ROUTE[1:]])["starts_correctly"]
    assert score([(20, 20), (180, 20)], np.ones((200, 200), bool))["efficiency_canary"]
    wall = np.ones((200, 200), bool)
    wall[:, 100:102] = False
    assert R.first_collision(wall, [(20, 20), (180, 20)], 3)["segment_index"] == 0
    assert R.first_collision(np.ones((50, 50), bool), [(5, 1), (40, 1)], 3) is not None  # over the edge
    assert score(None) == {"success": False, "schema_valid": False}


def test_geodesics_and_distance_fields():
    room = np.ones((120, 120), bool)
    assert R.geodesic(room, (20, 20), (100, 80))[0] == pytest.approx(math.dist((20, 20), (100, 80)), rel=0.02)
    assert 440 <= R.geodesic(U, (20, 20), (180, 20))[0] <= 481
    pockets = np.zeros((60, 60), bool)
    pockets[10:25, 10:25] = pockets[40:55, 40:55] = True
    with pytest.raises(ValueError):
        R.geodesic(pockets, (17, 17), (47, 47))
    field = R.distance_to_wall(U)
    ys, xs = np.nonzero(~U)
    for y, x in ((100, 20), (180, 100), (20, 180), (5, 5)):
        assert field[y, x] == pytest.approx(np.hypot(ys - y, xs - x).min() if U[y, x] else 0)
    assert R.clearance(U, ROUTE) == pytest.approx(field[100, 20], abs=1.5)


def test_masks_travel_and_radii_shrink():
    assert (R.unpack(*R.pack(U)) == U).all() and R.mask_hash(U) != R.mask_hash(~U)
    two = R.draw(100, 100, [([(10, 50), (90, 50)], 9), ([(10, 70), (90, 70)], 9)])
    assert R.endpoint_radius(two, (50, 50), 10) == 10 and 12 < R.endpoint_radius(two, (50, 50), 28) < 16


@pytest.mark.parametrize("family", list(N.FAMILIES))
def test_worlds_are_valid_and_repeat(family):
    a, b = (N.build_slot(1, 2, 3, family) for _ in range(2))
    assert a == b and a["rejection"] is None
    mask, path = R.unpack(a["mask"], a["h"], a["w"]), [(p["x"], p["y"]) for p in a["route"]]
    assert R.first_collision(mask, path, 3) is None and a["length_px"] >= 100
    assert N.build_slot(1, 2, 4, family)["mask_sha256"] != a["mask_sha256"]


def test_few_rows_are_python_objects_at_a_time(spark):
    """Ten thousand rows of an Arrow batch, of two masks or of one that no row holds: a task's Python grows by far less than the rows would take as objects."""
    import resource

    bits, h, w = R.pack(U)
    half, _, _ = R.pack(np.zeros_like(U))
    other = F.when(F.col("id") % 2 == 0, F.lit(half)).otherwise(F.lit(bits)).alias("mask")
    points = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.struct((F.col("id") + i).cast("double").alias("x"), i.cast("double").alias("y")))

    def kernel(mask, row):
        return {"id": row["id"], "open": int(mask.sum()), "peak": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024}

    rows = spark.range(0, 10_000, 1, 1).select("id", points.alias("pts"))
    shared = R.apply_to_tasks(rows, kernel, "id long, open long, peak long", mask=U).orderBy("id").collect()
    assert [r.id for r in shared] == list(range(10_000)) and {r.open for r in shared} == {int(U.sum())}
    each = R.apply_to_tasks(rows.select("*", other, F.lit(h).alias("h"), F.lit(w).alias("w")), kernel, "id long, open long, peak long").orderBy("id").collect()
    assert [(r.id, r.open) for r in each] == [(i, 0 if i % 2 == 0 else int(U.sum())) for i in range(10_000)]
    assert shared[-1].peak - shared[0].peak < 64
