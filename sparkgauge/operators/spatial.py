"""Pairs of segments nearer than a distance, over space that is split where it is crowded.

Every segment goes to the cells that its box, widened by half the distance, touches. Cells start wide, so long segments
have few copies; a cell of too many rows is split into four, down to the distance itself. What is still crowded then is one
heap in which most pairs are answers: its rows are dealt into blocks, and pairs of blocks meet. So no join key owns more
than about twice ``cap`` rows, wherever the segments lie. A pair that shares several cells counts in the one that holds the
corner where both boxes begin, so nothing has to be made distinct.

Where segments are as long as the space is wide, most cells hold most of them, and near pairs are a share of all pairs.
Then near_tallies() counts without making a row of any pair: equal segments are one, they are packed into blocks, and
pairs of blocks are counted in numpy by halving the plane (see Tally). Most crossings are counted by sorting, without
comparing pairs, so time grows as the power 1.5 of the different segments of a group, and with the ends of segments
times what lies within reach of them. What is moved and written is a constant times the input, up to BLOCK_MOST segments a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .scan import Fold, segmented_scan

#: Rows of a cell or block, and how often the first cells can be halved: they are 2^LEVELS distances wide.
CAP, LEVELS = 4096, 4
#: Segments of a packed block (20 MB). A pair of blocks is counted in up to REGIONS tasks, of about BLOCK_LEAST segments at least.
BLOCK_LEAST, BLOCK_MOST, REGIONS = 1024, 1 << 19, 16
#: Ends of segments in a box that isn't halved again, and segments that they are compared with at a time.
TILE = (128, 1024)


def _to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared distance of a point from a segment, which may be a point too."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(F.lit(0.0))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Of two segments (x, y, x, y): 0 where they cross, else that of the nearest end."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a, b
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    cross = (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)
    ends = F.least(_to_segment(ax, ay, cx, cy, dx, dy), _to_segment(bx, by, cx, cy, dx, dy), _to_segment(cx, cy, ax, ay, bx, by), _to_segment(dx, dy, ax, ay, bx, by))
    return F.when(cross, F.lit(0.0)).otherwise(ends)


def _leaves(rows: DataFrame, group: Sequence[str], reach: float, cap: int, levels: int) -> DataFrame:
    """A row for each cell that a row of rows lies in, with __level, __cx, __cy, and __blocks, how many blocks the cell is dealt into."""
    side = lambda level: reach * (1 << level)
    range_of = lambda lo, hi, level: F.sequence(F.floor(F.col(lo) / side(level)), F.floor(F.col(hi) / side(level)))
    key = [*group, "__cx", "__cy"]
    at = rows.withColumn("__cx", F.explode(range_of("__x0", "__x1", levels))).withColumn("__cy", F.explode(range_of("__y0", "__y1", levels)))
    out, level = None, levels
    while True:
        crowded = cut(at.groupBy(*key).agg(F.count("*").alias("__n")).where(F.col("__n") > cap), "crowded")
        if crowded.isEmpty():
            leaf = at.withColumn("__blocks", F.lit(1).cast("long"))
        else:
            sized = at.join(crowded, key, "left")
            leaf = sized if level == 0 else sized.where(F.col("__n").isNull())
            leaf = leaf.withColumn("__blocks", F.coalesce(F.ceil(F.col("__n") / cap), F.lit(1).cast("long"))).drop("__n")
        leaf = leaf.withColumn("__level", F.lit(level))
        out = leaf if out is None else out.unionByName(leaf)
        if level == 0 or crowded.isEmpty():
            return out
        level -= 1
        inside = lambda c, lo, hi: F.explode(F.array_intersect(range_of(lo, hi, level), F.array(F.col(c) * 2, F.col(c) * 2 + 1)))  # noqa: B023, E731
        at = cut(at.join(crowded.drop("__n"), key).withColumn("__cx", inside("__cx", "__x0", "__x1")).withColumn("__cy", inside("__cy", "__y0", "__y1")), "split")


def near_pairs(segments: DataFrame, group: Sequence[str], key: str, ends: Sequence[str], reach: float, apart: Sequence[str] = (), cap: int = CAP, levels: int = LEVELS) -> DataFrame:
    """Pairs of one group whose distance is below reach: group, a and b (keys, a below b), squared (their squared distance), apart's columns as a_ and b_.

    ends names the columns x, y, x, y of a segment's ends; a point has equal ones. key is unique within a group: rows of equal
    keys make no pair. A null in group, key or ends makes no pair either.
    """
    good = F.lit(True)
    for c in (*group, key, *ends):
        good = good & F.col(c).isNotNull()
    half = reach * 0.5000001
    ax, ay, bx, by = (F.col(c).cast("double") for c in ends)
    rows = segments.where(good).select(*group, F.col(key).alias("__id"), *[c.alias(f"__e{i}") for i, c in enumerate((ax, ay, bx, by))], *[F.col(c).alias(f"__w_{c}") for c in apart])
    rows = rows.withColumns({"__x0": F.least("__e0", "__e2") - half, "__x1": F.greatest("__e0", "__e2") + half, "__y0": F.least("__e1", "__e3") - half, "__y1": F.greatest("__e1", "__e3") + half})
    cells = _leaves(rows, group, reach, cap, levels).withColumn("__block", F.pmod(F.xxhash64("__id"), "__blocks"))
    own = ["__id", "__block", "__x0", "__x1", "__y0", "__y1", *[f"__e{i}" for i in range(4)], *[f"__w_{c}" for c in apart]]
    place = [*group, "__level", "__cx", "__cy", "__low", "__high"]
    low = cells.withColumn("__low", F.col("__block")).withColumn("__high", F.explode(F.sequence("__block", F.col("__blocks") - 1)))
    high = cells.withColumn("__high", F.col("__block")).withColumn("__low", F.explode(F.sequence(F.lit(0).cast("long"), "__block")))
    met = low.select(*place, *[F.col(c).alias(f"l{c}") for c in own]).join(high.select(*place, *[F.col(c).alias(f"h{c}") for c in own]), place)
    side = F.lit(reach) * F.pow(F.lit(2.0), F.col("__level"))
    first = (F.floor(F.greatest("l__x0", "h__x0") / side) == F.col("__cx")) & (F.floor(F.greatest("l__y0", "h__y0") / side) == F.col("__cy"))
    touch = (F.col("l__x0") <= F.col("h__x1")) & (F.col("h__x0") <= F.col("l__x1")) & (F.col("l__y0") <= F.col("h__y1")) & (F.col("h__y0") <= F.col("l__y1"))
    once = (F.col("__low") < F.col("__high")) | (F.col("l__id") < F.col("h__id"))
    swap = F.col("l__id") > F.col("h__id")
    squared = squared_distance([F.when(swap, F.col(f"h__e{i}")).otherwise(F.col(f"l__e{i}")) for i in range(4)], [F.when(swap, F.col(f"l__e{i}")).otherwise(F.col(f"h__e{i}")) for i in range(4)])
    pairs = met.where(touch & first & once & (F.col("l__id") != F.col("h__id"))).withColumn("squared", squared).where(F.col("squared") < reach * reach)
    pick = lambda c, a, b: F.when(swap, F.col(f"{a}{c}")).otherwise(F.col(f"{b}{c}"))
    return pairs.select(*group, pick("__id", "h", "l").alias("a"), pick("__id", "l", "h").alias("b"), "squared", *[x for c in apart for x in (pick(f"__w_{c}", "h", "l").alias(f"a_{c}"), pick(f"__w_{c}", "l", "h").alias(f"b_{c}"))])


def near_counts(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, id, near (how many others of its pairs), nearest (squared): pairs are counted where they are found and never meet as rows."""
    ends = pairs.select(*group, F.explode(F.array("a", "b")).alias("id"), "squared")
    return ends.groupBy(*group, "id").agg(F.count("*").alias("near"), F.min("squared").alias("nearest"))


def _exact_ends(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Squared distances, of rows (x, y, x, y): a's first end from b, a's last, b's first from a, b's last; by squared_distance()'s operations."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a.T, b.T

    def to_segment(px, py, sx, sy, ex, ey):
        ux, uy = ex - sx, ey - sy
        size = ux * ux + uy * uy
        t = np.where(size <= 0, 0.0, np.maximum(0.0, np.fmin(1.0, ((px - sx) * ux + (py - sy) * uy) / size)))
        gx, gy = px - (sx + t * ux), py - (sy + t * uy)
        return gx * gx + gy * gy

    return [to_segment(ax, ay, cx, cy, dx, dy), to_segment(bx, by, cx, cy, dx, dy), to_segment(cx, cy, ax, ay, bx, by), to_segment(dx, dy, ax, ay, bx, by)]


def _exact_cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the rows (x, y, x, y) of a and b cross, by squared_distance()'s operations."""
    (ax, ay, bx, by), (cx, cy, dx, dy) = a.T, b.T
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    return (side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0) & (side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0)


def _lines(e: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of segments: unit normal and offset of the line through each (zeros for a point), the same across its first end, and length."""
    along = e[:, 2:] - e[:, :2]
    size = np.hypot(along[:, 0], along[:, 1])
    ux, uy = (along / np.where(size > 0, size, 1.0)[:, None]).T
    x, y = (e[:, :2] - centre).T
    return np.stack([-uy, ux, uy * x - ux * y], axis=1), np.stack([ux, uy, -ux * x - uy * y], axis=1), size


def _later_below(rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each of different numbers the weight of later ones that are smaller."""
    m = len(rank)
    if m > 1 << 13:
        left, right = rank[: m // 2], rank[m // 2 :]
        order = np.argsort(right)
        below = np.concatenate([[0.0], np.cumsum(weight[m // 2 :][order])])[np.searchsorted(right[order], left)]
        return np.concatenate([below + _later_below(left, weight[: m // 2]), _later_below(right, weight[m // 2 :])])
    step = max(1, int(2 * m**0.5))
    n = -(-m // step)
    order, chunk = np.argsort(rank), np.arange(m) // step
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    table = np.zeros((n + 1, m))
    table[chunk, place] = weight
    out = np.cumsum(np.cumsum(table, axis=1)[::-1], axis=0)[::-1][chunk + 1, place]
    full, heavy = np.full(n * step, m), np.zeros(n * step, weight.dtype)
    full[:m], heavy[:m] = place, weight
    full, heavy = full.astype(np.int16).reshape(n, step), heavy.reshape(n, step)
    inside = (full[:, None, :] < full[:, :, None]) & (np.arange(step) > np.arange(step)[:, None])
    return out + np.matmul(inside.astype(np.float32 if weight.max(initial=0) * step < 1 << 24 else np.float64), heavy.astype(np.float32 if weight.max(initial=0) * step < 1 << 24 else np.float64)[:, :, None])[:, :, 0].ravel()[:m]


def _interleaved(low: np.ndarray, high: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Of chords between places low < high on a closed curve: the weight of those that each crosses, by each of weights."""
    order = np.argsort(low)
    m, low, high, out = len(low), low[order], high[order], []
    places = np.concatenate([low, high])
    rank = np.empty(2 * m, np.int64)
    rank[np.argsort(places)] = np.arange(2 * m)
    for w in (w[order].astype(np.float64) for w in weights):
        ends = np.zeros(2 * m)
        ends[rank] = np.concatenate([w, w])
        ends = np.cumsum(ends)
        found = np.empty(m)
        found[order] = ends[rank[m:]] - w - ends[rank[:m]] - 2 * _later_below(high, w)
        out.append(found)
    return out


class Tally:
    """Near segments among e (x, y, x, y), counted with copies; where colour isn't constant, only between different colours.

    The plane is halved at the ends of segments until a box has few of them. Pieces of segments that pass a box from side to side
    cross in it just if their places on its border alternate, which is counted by sorting. Only the ends in a box
    are compared with the pieces there (do they cross?) and with the segments within reach of it (are they near?).
    So time is that of n to the power 1.5, and of the ends of segments with what lies within reach of them.

    No piece meets a border within ``gap`` of another: a border is moved until this holds, and pieces for which it can't hold
    (those that lie upon each other) are compared with all in the box. Sides within rounding are told by the exact test.
    """

    def __init__(self, e: np.ndarray, copies: np.ndarray, colour: np.ndarray, reach: float, tile: tuple[int, int]) -> None:
        self.e, self.w, self.colour, self.reach, self.tile = e, copies.astype(np.float64), colour.astype(np.int8), reach, tile
        self.mixed, self.light = len(colour) > 0 and bool((colour != colour[0]).any()), bool(copies.max(initial=0) * max(tile) < 1 << 24)
        self.crossed, self.near, self.zero, self.nearest = np.zeros(len(e)), np.zeros(len(e)), np.zeros(len(e)), np.full(len(e), np.inf)
        # what is not a number, too large to be squared or far beyond the others is compared with all
        self.odd = ~(np.abs(e).max(axis=1, initial=0.0) < 1e100)
        if not self.odd.all():
            out = np.abs(e - np.tile(np.median(e[~self.odd].reshape(-1, 2), axis=0), 2)).max(axis=1)
            if common := np.quantile(out[~self.odd], 0.9):
                self.odd |= out > 1e6 * common
        fine = e[~self.odd].reshape(-1, 2)
        self.centre = fine.mean(axis=0) if len(fine) else np.zeros(2)
        self.wide = max(1e-300, np.abs(fine).max(initial=0.0), np.abs(fine - self.centre).max(initial=0.0))
        self.doubt, self.gap = 64 * np.finfo(np.float64).eps * self.wide, 512 * np.finfo(np.float64).eps * self.wide
        self.normal, self.along, self.size = _lines(np.where(self.odd[:, None], 0.0, e), self.centre)

    def run(self, region: int = 0, halvings: int = 0) -> Tally:
        """Count what is found in one of 2^halvings regions; the sums over all regions are the whole."""
        with np.errstate(all="ignore"):
            fine = np.flatnonzero(~self.odd)
            if region == 0:
                self._alone()
            if len(fine):
                e = self.e[fine]
                low, high = np.minimum(e[:, :2], e[:, 2:]).min(axis=0), np.maximum(e[:, :2], e[:, 2:]).max(axis=0)
                margin = (high - low).max() * 0.01 + self.wide * 1e-9
                ends = np.concatenate([fine, fine]), np.repeat([0, 1], len(fine))
                self._box((*(low - margin), *(high + margin)), fine, e[:, :2].copy(), e[:, 2:].copy(), np.ones(len(fine), bool), np.ones(len(fine), bool), fine, ends, region, halvings)
        return self

    def _alone(self) -> None:
        """Each segment with itself, and odd ones with all."""
        if not self.mixed:
            own = _exact_ends(self.e, self.e)
            least = reduce(np.fmin, own)
            self.near += np.where(least < self.reach * self.reach, self.w, 0.0)
            self.zero += np.where(least == 0, self.w, 0.0)
        odd = np.flatnonzero(self.odd)
        for i, j in self._tiles(odd, np.arange(len(self.e))):
            x, y = np.nonzero(self._meet(i, j) & (~self.odd[j] | (i[:, None] < j)))
            self._add_exact(i[x], j[y])

    def _tiles(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        m, n = self.tile
        for p in range(0, len(i), m):
            for q in range(0, len(j), n):
                yield i[p : p + m], j[q : q + n]

    def _meet(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.colour[i][:, None] != self.colour[j] if self.mixed else i[:, None] != j

    def _add(self, into: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(into, i, self.w[j])
        np.add.at(into, j, self.w[i])

    def _add_exact(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs, each once, by the exact distance alone."""
        cross = _exact_cross(self.e[i], self.e[j])
        squared = np.where(cross, 0.0, reduce(np.fmin, _exact_ends(self.e[i], self.e[j])))
        self._add_near(i, j, squared)

    def _add_near(self, i: np.ndarray, j: np.ndarray, squared: np.ndarray) -> None:
        near = squared < self.reach * self.reach
        i, j, squared = i[near], j[near], squared[near]
        self._add(self.near, i, j)
        self._add(self.zero, i[squared == 0], j[squared == 0])
        above = squared > 0
        for k in (i, j):
            np.minimum.at(self.nearest, k[above], squared[above])

    def _box(self, box, idx, s, t, s_in, t_in, near, ends, region, halvings) -> None:
        """Pieces idx from s to t in a box (x0, y0, x1, y1), where s_in and t_in tell ends of segments; near are all segments within reach of it."""
        if len(ends[0]) <= self.tile[0] and not halvings:
            return self._leaf(box, idx, s, t, s_in, t_in, near, ends)
        at = self.e[ends[0][:, None], ends[1][:, None] * 2 + np.arange(2)]
        best = None
        wide = (at.max(axis=0) - at.min(axis=0)) if len(at) else np.zeros(2)
        for axis in (int(wide[1] > wide[0]), int(wide[1] <= wide[0])):
            order = np.sort(at[:, axis])
            open_ = np.flatnonzero(np.diff(order) > 4 * self.gap)
            for share in (0.5, 0.47, 0.53, 0.4, 0.6) if len(open_) else ():
                k = open_[min(len(open_) - 1, np.searchsorted(open_, share * len(at)))]
                c = order[k] + (order[k + 1] - order[k]) * 0.4871
                cross, v, bad = self._cuts(box, idx, s, t, axis, c)
                if best is None or bad.sum() < best[-1].sum():
                    best = axis, c, cross, v, bad
                if not bad.any():
                    break
            if best is not None:
                break
        if best is None:
            if region == 0:
                self._leaf(box, idx, s, t, s_in, t_in, near, ends)
            return None
        axis, c, cross, v, bad = best
        if bad.any():
            if not region:
                self._among(idx, s, t, np.flatnonzero(bad))
            keep = ~bad
            v, idx, s, t, s_in, t_in, cross = v[keep[cross]], idx[keep], s[keep], t[keep], s_in[keep], t_in[keep], cross[keep]
        below = s[:, axis] < c
        for half in (0, 1):
            if halvings and region & 1 != half:
                continue
            sub = list(box)
            sub[(2, 0)[half] + axis] = c
            mine = np.flatnonzero((below == (half == 0)) | cross)
            cs, ct, ci, ti = s[mine], t[mine], s_in[mine], t_in[mine]
            met = np.flatnonzero(cross[mine])
            border = np.empty((len(met), 2))
            border[:, axis], border[:, 1 - axis] = c, v
            begins = below[mine[met]] == (half == 0)
            ct[met[begins]], ti[met[begins]] = border[begins], False
            cs[met[~begins]], ci[met[~begins]] = border[~begins], False
            here = (at[:, axis] < c) == (half == 0)
            self._box(tuple(sub), idx[mine], cs, ct, ci, ti, near[self._within(sub, near)], (ends[0][here], ends[1][here]), region >> 1, max(0, halvings - 1))
        return None

    def _cuts(self, box, idx, s, t, axis, c) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces a line halves, where, and which of all come within gap of an end or of another there."""
        us, ut = s[:, axis], t[:, axis]
        cross = (us < c) != (ut < c)
        bad = (np.abs(us - c) < self.gap) | (np.abs(ut - c) < self.gap)
        e = self.e[idx[cross]]
        au, av, bu, bv = e[:, axis], e[:, 1 - axis], e[:, 2 + axis], e[:, 3 - axis]
        v = av + (c - au) * ((bv - av) / (bu - au))
        order = np.argsort(v)
        tight = np.flatnonzero(~(np.diff(v[order]) >= self.gap))
        k = np.flatnonzero(cross)
        bad[k[order[tight]]] = True
        bad[k[order[tight + 1]]] = True
        bad[k[~((v > box[1 - axis] + self.gap) & (v < box[3 - axis] - self.gap))]] = True
        return cross, v, bad

    def _within(self, box, near) -> np.ndarray:
        """Which segments may be within reach of a box."""
        e, slack = self.e[near], self.reach + self.gap + self.reach * 1e-6
        out = np.ones(len(near), bool)
        for c in (0, 1):
            out &= (np.minimum(e[:, c], e[:, 2 + c]) <= box[2 + c] + slack) & (np.maximum(e[:, c], e[:, 2 + c]) >= box[c] - slack)
        middle, half = np.array([(box[0] + box[2]) / 2, (box[1] + box[3]) / 2]) - self.centre, (np.array(box[2:]) - np.array(box[:2])) / 2
        n = self.normal[near]
        out &= np.abs(n[:, 0] * middle[0] + n[:, 1] * middle[1] + n[:, 2]) <= np.abs(n[:, 0]) * half[0] + np.abs(n[:, 1]) * half[1] + slack
        return out

    def _sides(self, i, p) -> np.ndarray:
        """Distances of points p from the lines of segments i, a row for each point."""
        n = self.normal[i]
        return (p - self.centre) @ n[:, :2].T + n[:, 2]

    def _told(self, told, doubtful, i, j) -> np.ndarray:
        """told, with doubtful pairs by the exact test, less pairs that don't count."""
        x, y = np.nonzero(doubtful)
        if len(x):
            told[x, y] = _exact_cross(self.e[i[x]], self.e[j[y]])
        return told & self._meet(i, j)

    def _add_cross(self, told, i, j) -> None:
        np.add.at(self.crossed, i, told @ self.w[j])
        np.add.at(self.crossed, j, self.w[i] @ told)

    def _among(self, idx, s, t, some) -> None:
        """Crossings within a box of some of its pieces with all of them."""
        place = np.full(len(idx), -1)
        place[some] = np.arange(len(some))
        for x, y in self._tiles(some, np.arange(len(idx))):
            i, j = idx[x], idx[y]
            p, q, r, u = self._sides(j, s[x]), self._sides(j, t[x]), self._sides(i, s[y]).T, self._sides(i, t[y]).T
            doubtful = np.minimum(np.minimum(np.abs(p), np.abs(q)), np.minimum(np.abs(r), np.abs(u))) < self.doubt
            told = self._told((p * q < 0) & (r * u < 0), doubtful, i, j)
            self._add_cross(told & ((place[y] < 0) | (place[x][:, None] < place[y])), i, j)

    def _leaf(self, box, idx, s, t, s_in, t_in, near, ends) -> None:
        x0, y0, x1, y1 = box
        w, h = x1 - x0, y1 - y0
        round_ = lambda p: np.where(p[:, 1] == y0, p[:, 0] - x0, np.where(p[:, 0] == x1, w + (p[:, 1] - y0), np.where(p[:, 1] == y1, w + h + (x1 - p[:, 0]), 2 * w + h + (y1 - p[:, 1]))))
        first, last = round_(s), round_(t)
        low, high, forth = np.minimum(first, last), np.maximum(first, last), first < last
        part = s_in | t_in
        chord, part = np.flatnonzero(~part), np.flatnonzero(part)
        if len(chord) > 1:
            k = idx[chord]
            if not self.mixed:
                self.crossed[k] += _interleaved(low[chord], high[chord], [self.w[k]])[0]
            else:
                one = self.colour[k] == self.colour[0]
                other, same = _interleaved(low[chord], high[chord], [np.where(one, 0.0, self.w[k]), np.where(one, self.w[k], 0.0)])
                self.crossed[k] += np.where(one, other, same)
        if len(part):
            self._among(idx[part], s[part], t[part], np.arange(len(part)))
            for x, y in self._tiles(part, chord):
                i, j = idx[x], idx[y]
                inner = self._sides(j, np.where(s_in[x][:, None], s[x], t[x]))
                out = np.where(s_in[x], last[x], first[x])[:, None]
                beyond = ((out > low[y]) & (out < high[y])) != forth[y]
                doubtful = np.abs(inner) < self.doubt
                both = np.flatnonzero(s_in[x] & t_in[x])
                if len(both):
                    far = self._sides(j, t[x[both]])
                    beyond[both] = far > 0
                    doubtful[both] |= np.abs(far) < self.doubt
                self._add_cross(self._told((inner > 0) != beyond, doubtful, i, j), i, j)
        for i, j in self._tiles(np.arange(len(ends[0])), near):
            self._ends(ends[0][i], ends[1][i], j)

    def _ends(self, i, end, j) -> None:
        """Ends of segments i with segments j: pairs that don't cross count at the first of their four ends that is near the other."""
        reach, e = self.reach, self.e
        p = e[i[:, None], end[:, None] * 2 + np.arange(2)]
        o = e[i[:, None], 2 - end[:, None] * 2 + np.arange(2)]
        middle = p.mean(axis=0)
        wide = max(np.abs(e[j].reshape(-1, 2) - middle).max(), np.abs(o - middle).max(), np.abs(p - middle).max())
        # a product is near enough in single precision unless the segments are long
        kind = np.float32 if 16 * np.finfo(np.float32).eps * wide < reach / 64 else np.float64
        doubt = 16 * np.finfo(kind).eps * wide + 16 * np.finfo(np.float64).eps * self.wide
        shift = middle - self.centre
        moved = lambda c: np.column_stack([c[:, :2], c[:, 2] + c[:, :2] @ shift]).astype(kind)
        flat = lambda q: np.column_stack([q - middle, np.ones(len(q))]).astype(kind)
        la, ua, lb, ub = moved(self.normal[i]), moved(self.along[i]), moved(self.normal[j]).T, moved(self.along[j]).T
        fp, fo, f0, f1 = flat(p), flat(o), flat(e[j, :2]).T, flat(e[j, 2:]).T
        za, zb, over, under, doubt = self.size[i].astype(kind), self.size[j].astype(kind), kind(reach + doubt), kind(reach - doubt), kind(doubt)
        # distances of ends from lines and, for this end, from the nearer end along its line (below 0 outside)
        r, s, a, b, u = fp @ lb, fo @ lb, la @ f0, la @ f1, fp @ ub
        np.minimum(u, zb - u, out=u)
        alike = (r * s > 0) | (a * b > 0)
        np.abs(r, out=r)
        least = np.minimum(np.abs(s), np.minimum(np.abs(a), np.abs(b)))
        here = (r < over) & (u > -over)
        self._unmeet(here, i, j)
        # in these the end is near the other's inside, and no other end is near the other's line
        known = (least > over) & (r < under) & (np.minimum(r, u) > doubt) & here
        rest = here & ~known & (alike | (np.minimum(r, least) <= doubt))
        known &= alike
        wi, wj = self.w[i], self.w[j]
        told = known.astype(np.float32 if self.light else np.float64)
        np.add.at(self.near, i, told @ wj.astype(told.dtype))
        self.near[j] += wi.astype(told.dtype) @ told
        self._lessen(i, j, np.maximum(r, np.multiply(~known, kind(1e30), dtype=kind)), doubt)
        if not len(hit := np.flatnonzero(rest)):
            return
        x, y = np.divmod(hit, len(j))
        of = lambda m: m.ravel().take(hit)
        aside = lambda far, beyond: far * far + np.square(np.minimum(0, beyond))
        inner = lambda m, size: np.minimum(m, size - m)
        zx, zy = za.take(x), zb.take(y)
        four = [aside(of(r), of(u)), aside(of(s), inner(of(fo @ ub), zy)), aside(of(a), inner(of(ua @ f0), zx)), aside(of(b), inner(of(ua @ f1), zx))]
        squared = np.minimum(np.minimum(four[0], four[1]), np.minimum(four[2], four[3]))
        low, high, alike = kind(reach - 2 * doubt) ** 2, kind(reach + 2 * doubt) ** 2, of(alike)
        clear = (of(least) > doubt) & (squared > 4 * doubt * doubt) & alike & bool(reach > 4 * doubt)
        for d in four:
            clear &= (d < low) | (d > high)
        first = np.flatnonzero(clear & self._first(end.take(x), i.take(x) < j.take(y), [d < low for d in four]))
        k, m, far = x[first], y[first], np.sqrt(squared[first])
        np.add.at(self.near, i, np.bincount(k, wj[m], len(i)))
        self.near[j] += np.bincount(m, wi[k], len(j))
        low = np.flatnonzero((far - 2 * doubt < np.sqrt(self.nearest[i])[k]) | (far - 2 * doubt < np.sqrt(self.nearest[j])[m]))
        self._nearest(i[k[low]], j[m[low]])
        vague = np.flatnonzero(~clear)
        at, x, y = end[x[vague]], i[x[vague]], j[y[vague]]
        four = _exact_ends(e[x], e[y])
        four[:2] = np.where(at == 0, four[0], four[1]), np.where(at == 0, four[1], four[0])
        first = self._first(at, x < y, [d < reach * reach for d in four]) & ~_exact_cross(e[x], e[y])
        self._add_near(x[first], y[first], reduce(np.fmin, four)[first])

    def _unmeet(self, told, i, j) -> None:
        """Leave out of told the pairs that don't count; j ascends."""
        if self.mixed:
            told &= self.colour[i][:, None] != self.colour[j]
        elif len(j):
            k = np.minimum(np.searchsorted(j, i), len(j) - 1)
            own = np.flatnonzero(j[k] == i)
            told[own, k[own]] = False

    @staticmethod
    def _first(end, before, near) -> np.ndarray:
        """Whether this end of a is the first of the ends near the other: a's two, b's two, or b's before, where a isn't before b. near is told of this end, a's other and b's two."""
        return np.where(end == 0, near[0], near[0] & ~near[1]) & (before | ~(near[2] | near[3]))

    def _lessen(self, i, j, far, doubt) -> None:
        """nearest by distances (inf where a pair doesn't count) known up to doubt: those that may be least are computed exactly."""
        rows, cols = (np.minimum(np.sqrt(self.nearest[k]), far.min(axis=axis, initial=np.inf) + doubt) + doubt for k, axis in ((i, 1), (j, 0)))
        x, y = np.divmod(np.flatnonzero((far < 1e30) & ((far <= rows[:, None].astype(far.dtype)) | (far <= cols.astype(far.dtype)))), len(j))
        self._nearest(i[x], j[y])

    def _nearest(self, i, j) -> None:
        squared = reduce(np.fmin, _exact_ends(self.e[i], self.e[j]))
        for k in (i, j):
            np.minimum.at(self.nearest, k, squared)


def near_tallies(segments: DataFrame, group: Sequence[str], ends: Sequence[str], reach: float) -> DataFrame:
    """Of each different segment of a group: group, ends, copies (its rows), near (rows of the group nearer than reach, its own
    among them), touched (those at distance 0) and nearest (the least squared distance above 0 and below reach squared, else null).

    ends names the columns x, y, x, y of a segment's ends. Rows with a null in group or ends don't count and have no row.
    """
    spark = segments.sparkSession
    own = [F.col(c).cast("double").alias(c) for c in ends]
    classes = segments.where(reduce(lambda p, c: p & F.col(c).isNotNull(), [*group, *ends], F.lit(True))).select(*group, *own).groupBy(*group, *ends).agg(F.count("*").alias("copies"))
    x0, y0, x1, y1 = (F.col(c) for c in ends)
    # alike in length, then in strips, so that blocks and tiles are small in space
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.abs(x1 - x0), F.abs(y1 - y0), F.lit(reach)) / reach)))
    placed = classes.withColumn("__level", level).withColumn("__strip", F.floor((x0 + x1) / (reach * 32 * F.pow(F.lit(2.0), "__level")))).withColumn("__y", y0 + y1)
    numbered = segmented_scan(cut(placed, "classes"), group, ["__level", "__strip", "__y"], {"__n": Fold(F.lit(1).cast("long")), "__all": Fold(F.lit(1).cast("long"), rows="all")})
    size = F.ceil(F.col("__all") / F.ceil(F.col("__all") / BLOCK_MOST))
    dealt = numbered.withColumn("__block", F.floor((F.col("__n") - 1) / size)).select(*group, "__block", *ends, "copies", "__n")
    key = [*group, "__block"]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*key).schema)

    def packed(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__n")
        e = frame[list(ends)].to_numpy(np.float64)
        low, high = np.minimum(e[:, :2], e[:, 2:]).min(axis=0), np.maximum(e[:, :2], e[:, 2:]).max(axis=0)
        return pd.DataFrame([(*keys, len(e), e.tobytes(), frame["copies"].to_numpy(np.int64).tobytes(), low[0], high[0], low[1], high[1])])

    blocks = cut(dealt.groupBy(*key).applyInPandas(packed, f"{head}, segments long, ends binary, copies binary, x0 double, x1 double, y0 double, y1 double"), "blocks")
    # bits of a region's number: each halves the plane once more
    side = lambda p: blocks.select(*group, F.col("__block").alias(f"__{p}"), F.col("segments").alias(f"{p}n"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "x1", "y0", "y1")])
    away = [F.col(f"{p}{c}0") > F.col(f"{q}{c}1") + reach * 1.000001 for p, q in (("l", "h"), ("h", "l")) for c in "xy"]
    pairs = side("l").join(side("h"), [*group]).where((F.col("__l") <= F.col("__h")) & ~reduce(lambda p, q: p | q, away))
    bits = F.floor(F.log2(F.least(F.lit(REGIONS), F.greatest(F.lit(1), F.greatest("ln", "hn") / BLOCK_LEAST)))).cast("int")
    pairs = pairs.select(*group, "__l", "__h", bits.alias("__bits")).withColumn("__region", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), "__bits").cast("int") - 1)))
    pairs = cut(pairs, "block-pairs")
    if not (n := pairs.count()):
        return classes.withColumns({"near": F.lit(0).cast("long"), "touched": F.lit(0).cast("long"), "nearest": F.lit(None).cast("double")})
    both = pairs.withColumn("__block", F.explode(F.array_distinct(F.array("__l", "__h"))))
    met = blocks.select(*key, "ends", "copies").join(both, key).repartition(min(4 * n, 1 << 14), *group, "__l", "__h", "__region", "__bits")
    unpack = lambda r: (np.frombuffer(r["ends"]).reshape(-1, 4), np.frombuffer(r["copies"], np.int64))
    tile = TILE

    def compared(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__block")
        ends, copies = zip(*(unpack(r) for _, r in frame.iterrows()), strict=True)
        colour = np.repeat(np.arange(len(ends)), [len(e) for e in ends])
        found = Tally(np.concatenate(ends), np.concatenate(copies), colour, reach, tile).run(keys[-2], keys[-1])
        out = []
        for k, block in enumerate(frame["__block"]):
            own = colour == k
            near, touched, nearest = (found.crossed + found.near)[own], (found.crossed + found.zero)[own], found.nearest[own]
            at = np.flatnonzero(near)
            out.append((*keys[:-4], block, at.astype(np.int32).tobytes(), near[at].astype(np.int64).tobytes(), touched[at].astype(np.int64).tobytes(), nearest[at].tobytes()))
        return pd.DataFrame(out)

    parts = met.groupBy(*group, "__l", "__h", "__region", "__bits").applyInPandas(compared, f"{head}, at binary, near binary, touched binary, nearest binary")

    def summed(keys: tuple, parts: Iterator[pd.DataFrame] | pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        e, copies = unpack(block.iloc[0])
        near, touched, nearest = np.zeros(len(e), np.int64), np.zeros(len(e), np.int64), np.full(len(e), np.inf)
        for _, r in parts.iterrows():
            at = np.frombuffer(r["at"], np.int32)
            near[at] += np.frombuffer(r["near"], np.int64)
            touched[at] += np.frombuffer(r["touched"], np.int64)
            nearest[at] = np.minimum(nearest[at], np.frombuffer(r["nearest"]))
        out = pd.DataFrame({c: [k] * len(e) for c, k in zip(group, keys, strict=False)})
        out[list(ends)] = e
        return out.assign(copies=copies, near=near, touched=touched, nearest=pd.array(nearest, "Float64")).replace({"nearest": {np.inf: None}})[[*group, *ends, "copies", "near", "touched", "nearest"]]

    shape = head.rsplit(", ", 1)[0] + "".join(f", `{c}` double" for c in ends) + ", copies long, near long, touched long, nearest double"
    return parts.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInPandas(summed, shape)
