"""Polyline geometry as column expressions over array<struct<x: double, y: double>>.

All of it is higher-order functions, so rows never leave the JVM. Folds whose step depends on the one before
(projection, walking) are ordered aggregate() calls; everything else is a transform over positions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated a single time, however often use() names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def dist(a: Column, b: Column) -> Column:
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def _pairs(points: Column) -> Column:
    """(a, b) for consecutive points; empty for fewer than two."""
    tail = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    head = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def segments(points: Column) -> Column:
    """Length of each segment."""
    return F.transform(_pairs(points), lambda s: dist(s["a"], s["b"]))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def length(points: Column) -> Column:
    return total(segments(points))


def cumulative(points: Column) -> Column:
    """Arclength at every point, from 0. Quadratic in the points, of which a submission has at most 512."""
    return once(segments(points), lambda lengths: F.transform(points, lambda p, i: total(F.slice(lengths, 1, i))))


def densify(points: Column, spacing: float) -> Column:
    """Points at most spacing apart; all original ones stay."""
    def along(s: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil(dist(s["a"], s["b"]) / spacing)).cast("int")
        return F.transform(F.sequence(F.lit(1), n), lambda k: point(s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * (k / n), s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * (k / n)))

    return F.when(F.size(points) < 2, points).otherwise(F.concat(F.slice(points, 1, 1), F.flatten(F.transform(_pairs(points), along))))


def project(p: Column, points: Column, slack: float = 1.0) -> Column:
    """(arclength, perpendicular, segment) of the nearest place on a polyline; a later segment must be closer by more than slack."""
    def feet(s: Column) -> Column:
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        square = dx * dx + dy * dy
        t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / square)))
        return F.struct(t.alias("t"), F.sqrt(square).alias("len"), F.hypot(p["x"] - (s["a"]["x"] + dx * t), p["y"] - (s["a"]["y"] + dy * t)).alias("d"))

    start = F.struct(F.lit(0.0).alias("arc"), F.lit(float("inf")).alias("perp"), F.lit(0).alias("seg"), F.lit(0.0).alias("before"), F.lit(0).alias("i"))

    def step(s: Column, f: Column) -> Column:
        closer = f["d"] < s["perp"] - slack
        return F.struct(F.when(closer, s["before"] + f["t"] * f["len"]).otherwise(s["arc"]).alias("arc"), F.when(closer, f["d"]).otherwise(s["perp"]).alias("perp"), F.when(closer, s["i"]).otherwise(s["seg"]).alias("seg"), (s["before"] + f["len"]).alias("before"), (s["i"] + 1).alias("i"))

    # the feet are computed once per segment, then folded in order
    several = F.aggregate(F.transform(_pairs(points), feet), start, step, lambda s: F.struct(s["arc"].alias("arclength"), s["perp"].alias("perpendicular"), s["seg"].alias("segment")))
    alone = F.when(F.size(points) == 1, dist(p, F.get(points, F.lit(0)))).otherwise(0.0)
    return F.when(F.size(points) >= 2, several).otherwise(F.struct(F.lit(0.0).alias("arclength"), alone.alias("perpendicular"), F.lit(0).alias("segment")))


def turn_angles(points: Column) -> Column:
    """Absolute change of direction at every inner point, 0 to pi."""
    def at(i: Column) -> Column:
        a, b, c = (F.get(points, i + k) for k in range(3))
        d = F.atan2(c["y"] - b["y"], c["x"] - b["x"]) - F.atan2(b["y"] - a["y"], b["x"] - a["x"])
        return F.abs(F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi)

    return F.transform(_inner(points), at)


def _inner(points: Column) -> Column:
    """Positions from 0 that start a triple; none for fewer than three points."""
    return F.when(F.size(points) > 2, F.sequence(F.lit(0), F.size(points) - 3)).otherwise(F.array().cast("array<int>"))


def turn_count(points: Column, degrees: float = 30.0) -> Column:
    """Direction changes of at least so many degrees; segments without length don't count."""
    def turns(i: Column) -> Column:
        a, b, c = (F.get(points, i + k) for k in range(3))
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        m, n = F.hypot(ux, uy), F.hypot(vx, vy)
        cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ux * vx + uy * vy, m * n)))
        return (m >= 1e-9) & (n >= 1e-9) & (F.degrees(F.acos(cosine)) >= degrees)

    return F.size(F.filter(_inner(points), lambda i: F.coalesce(turns(i), F.lit(False))))


def variation(values: Column, least: float = 0.0) -> Column:
    """Population coefficient of variation; 0 where the mean is not above least, or without values."""
    n = F.size(values)
    mean = F.try_divide(total(values), n)
    spread = F.sqrt(F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), n))
    return F.when((n > 0) & (mean > least), F.try_divide(spread, mean)).otherwise(0.0)


def revisit(points: Column, gap: int = 8, near: float = 12.0, most: int = 200) -> Column:
    """Share of samples that a sample at least gap later comes near again; 0 for 40 points or fewer. About most samples are compared."""
    step = F.greatest(F.lit(1), F.floor(F.size(points) / most)).cast("int")
    sampled = F.filter(points, lambda p, i: i % step == 0)
    again = F.transform(sampled, lambda p, i: F.exists(F.slice(sampled, i + 1 + gap, F.size(sampled)), lambda q: dist(p, q) < near).cast("int"))
    return F.when(F.size(points) > 40, F.aggregate(again, F.lit(0), lambda a, v: a + v) / F.greatest(F.size(sampled), F.lit(1))).otherwise(0.0)


def walk(points: Column, fraction: float) -> Column:
    """The part of a polyline up to a fraction of its length, the last point interpolated. Linear in the points: the lengths are made once and folded once."""
    def upto(lengths: Column) -> Column:
        goal = F.aggregate(lengths, F.lit(0.0), lambda a, v: a + v) * fraction
        start = F.struct(F.lit(0.0).alias("at"), F.lit(0).alias("k"), F.lit(0.0).alias("la"), F.lit(None).cast("double").alias("lb"))

        def step(s: Column, v: Column) -> Column:
            """k: segments whose end is kept; la and lb: arclength at the last point that is kept and at the next one."""
            to = s["at"] + v
            kept, on = to <= goal, s["lb"].isNull()
            return F.struct(to.alias("at"), (s["k"] + F.when(on & kept, 1).otherwise(0)).alias("k"), F.when(on & kept, to).otherwise(s["la"]).alias("la"), F.when(on & ~kept, to).otherwise(s["lb"]).alias("lb"))

        return F.struct(goal.alias("goal"), F.aggregate(lengths, start, step).alias("s"))

    def cut(found: Column) -> Column:
        goal, s = found["goal"], found["s"]
        kept = F.slice(points, 1, s["k"] + 1)
        a, b, t = F.get(points, s["k"]), F.get(points, s["k"] + 1), F.try_divide(goal - s["la"], s["lb"] - s["la"])
        end = F.array(point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t))
        return F.when(s["lb"].isNotNull() & (goal > s["la"]), F.concat(kept, end)).otherwise(kept)

    return once(once(segments(points), upto), cut)


def bezier(p0: Column, c: Column, p1: Column, n: int = 24) -> Column:
    """n + 1 points of a quadratic Bezier curve."""
    def at(k: Column) -> Column:
        t = k / F.lit(float(n))
        u = 1 - t
        return point(u * u * p0["x"] + 2 * u * t * c["x"] + t * t * p1["x"], u * u * p0["y"] + 2 * u * t * c["y"] + t * t * p1["y"])

    return F.transform(F.sequence(F.lit(0), F.lit(n)), at)


def arc(centre: Column, radius: Column, a0: Column, a1: Column, step: float = 0.06) -> Column:
    """Points of an arc with steps of at most so many radians, two steps at least."""
    n = F.greatest(F.lit(2), F.ceil(F.abs(a1 - a0) / step)).cast("int")
    angle = lambda k: a0 + (a1 - a0) * (k / n)
    return F.transform(F.sequence(F.lit(0), n), lambda k: point(centre["x"] + radius * F.cos(angle(k)), centre["y"] + radius * F.sin(angle(k))))


def downsample(points: Column, most: int = 200) -> Column:
    """At most so many points, both ends among them, at half-even rounded steps."""
    n = F.size(points)
    step = (n - 1) / F.lit(float(most - 1))
    return F.when(n <= most, points).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(points, F.rint(i * step).cast("int"))))


def disk(radius: int) -> Column:
    """Integer offsets of a filled disk."""
    side = F.sequence(F.lit(-radius), F.lit(radius))
    every = F.flatten(F.transform(side, lambda y: F.transform(side, lambda x: F.struct(x.alias("dx"), y.alias("dy")))))
    return F.filter(every, lambda o: o["dx"] * o["dx"] + o["dy"] * o["dy"] <= radius * radius)


def scale(points: Column, width: Column, height: Column) -> Column:
    """Normalised to pixel coordinates."""
    return F.transform(points, lambda p: point(p["x"] * (width - 1), p["y"] * (height - 1)))


def rect_distance(p: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.hypot(F.greatest(x0 - p["x"], F.lit(0.0), p["x"] - x1), F.greatest(y0 - p["y"], F.lit(0.0), p["y"] - y1))


def affine(points: Column, width: float, height: float, flip: bool = False, quarters: int = 0, angle: float = 0.0) -> Column:
    """Mirror, then quarter turns within the canvas, then a free rotation about the centre (radians)."""
    out = points
    if flip:
        out = F.transform(out, lambda p: point(width - p["x"], p["y"]))
    turn = lambda pts, tall: F.transform(pts, lambda p: point(tall - p["y"], p["x"]))
    for i in range(quarters % 4):
        out = turn(out, height if i % 2 == 0 else width)
    if angle:
        c, s, mx, my = math.cos(angle), math.sin(angle), width / 2, height / 2
        out = F.transform(out, lambda p: point(mx + (p["x"] - mx) * c - (p["y"] - my) * s, my + (p["x"] - mx) * s + (p["y"] - my) * c))
    return out


def route_progress(success: Column, started: Column, stop: Column, reference: Column, spacing: float = 2.0) -> Column:
    """1 for success, 0 if the route was never entered, else the share of the reference's length at the stop's projection."""
    share = once(densify(reference, spacing), lambda dense: F.try_divide(project(stop, dense)["arclength"], length(dense)))
    return F.when(success, F.lit(1.0)).when(~started | stop.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))))
