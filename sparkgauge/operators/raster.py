"""Raster kernels in numpy: swept-disk scoring, clearance, erosion, pixel routes and masks.

A mask is a two-dimensional boolean array, true where the pointer may be; it travels as packed bits with its
shape. All kernels work on one task, and apply_to_tasks() runs them for many, each with its own mask.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Points = list[tuple[float, float]]
SAMPLE_PX, CANARY = 0.75, 1.02


def pack(mask: np.ndarray) -> tuple[bytes, int, int]:
    return np.packbits(mask).tobytes(), *mask.shape


def unpack(bits: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=h * w).astype(bool).reshape(h, w)


def mask_hash(mask: np.ndarray) -> str:
    """SHA-256 of the shape and the packed bits."""
    h, w = mask.shape
    return sha256(f"{h}x{w};".encode() + np.packbits(mask).tobytes()).hexdigest()


def disk(radius: float) -> np.ndarray:
    """Offsets (dy, dx) of the pixels of a disk."""
    r = math.ceil(radius)
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    inside = dx * dx + dy * dy <= radius * radius
    return np.stack([dy[inside], dx[inside]], axis=1)


def _covered(mask: np.ndarray, xs: np.ndarray, ys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the disk at each centre (rounded half to even) lies on open pixels alone."""
    h, w = mask.shape
    py = np.rint(ys).astype(int)[:, None] + offsets[:, 0]
    px = np.rint(xs).astype(int)[:, None] + offsets[:, 1]
    inside = (py >= 0) & (py < h) & (px >= 0) & (px < w)
    return (inside & mask[py.clip(0, h - 1), px.clip(0, w - 1)]).all(axis=1)


def first_collision(mask: np.ndarray, points: Points, radius: float = 3) -> dict | None:
    """Where a disk swept along points first leaves the mask: segment_index, x_px, y_px (two places, but the first point as given)."""
    offsets = disk(radius)
    x0, y0 = points[0]
    if not _covered(mask, np.array([x0]), np.array([y0]), offsets)[0]:
        return {"segment_index": 0, "x_px": x0, "y_px": y0}
    for i, ((ax, ay), (bx, by)) in enumerate(zip(points, points[1:], strict=False)):
        t = np.arange(1, (n := max(1, math.ceil(math.hypot(bx - ax, by - ay) / SAMPLE_PX))) + 1) / n
        xs, ys = ax + (bx - ax) * t, ay + (by - ay) * t
        for lo in range(0, n, 512):  # stop early on long segments
            bad = np.nonzero(~_covered(mask, xs[lo : lo + 512], ys[lo : lo + 512], offsets))[0]
            if len(bad):
                return {"segment_index": i, "x_px": round(float(xs[lo + bad[0]]), 2), "y_px": round(float(ys[lo + bad[0]]), 2)}
    return None


def distance_to_wall(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of every open pixel to the nearest closed one: a column pass, then rows' lower envelopes."""
    h, w = mask.shape
    far = float(h * h + w * w)
    down = np.where(mask, far, 0.0)
    for y in range(1, h):
        down[y] = np.minimum(down[y], down[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        down[y] = np.minimum(down[y], down[y + 1] + 1)
    square = np.minimum(down * down, far * 4)
    cost = (np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2
    return np.sqrt(np.stack([(square[y][None, :] + cost).min(axis=1) for y in range(h)]))


def clearance(mask: np.ndarray, points: Points, step: float = 2.0) -> float:
    """Least distance to a wall along a path, sampled every step pixels; 0 off the canvas."""
    field, best = distance_to_wall(mask), math.inf
    for x, y in densify(points, step):
        px, py = int(np.rint(x)), int(np.rint(y))
        best = min(best, float(field[py, px]) if 0 <= py < mask.shape[0] and 0 <= px < mask.shape[1] else 0.0)
    return best


def densify(points: Points, step: float) -> Points:
    out = points[:1]
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / step))
        out = out + [(ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for k in range(1, n + 1)]
    return out


def path_length(points: Points) -> float:
    return sum(math.dist(a, b) for a, b in zip(points, points[1:], strict=False))


def evaluate(points: Points | None, mask: np.ndarray, start: tuple, goal: tuple, start_radius: float, goal_radius: float, radius: float = 3, reference: float = 0.0) -> dict:
    """Score a path in pixels: gates at both ends, no collision, success if all hold; efficiency on success alone."""
    if not points or len(points) < 2:
        return {"success": False, "schema_valid": False}
    out: dict = {"schema_valid": True, "starts_correctly": math.dist(points[0], start) <= start_radius, "ends_correctly": math.dist(points[-1], goal) <= goal_radius}
    out["first_collision"] = first_collision(mask, points, radius)
    out["collision_free"] = out["first_collision"] is None
    out["path_length_px"] = round(path_length(points), 2)
    out["success"] = out["starts_correctly"] and out["ends_correctly"] and out["collision_free"]
    raw = reference / path_length(points) if out["success"] and path_length(points) > 0 else None
    out["efficiency"] = None if raw is None else round(min(1.0, raw), 4)
    out["efficiency_canary"] = raw is not None and raw > CANARY
    return out


def erode(mask: np.ndarray, radius: float) -> np.ndarray:
    """Pixels where a disk fits; the border is closed."""
    r = math.ceil(radius)
    padded = np.pad(mask, r, constant_values=False)
    out = np.ones_like(mask)
    for dy, dx in disk(radius):
        out &= padded[r + dy : r + dy + mask.shape[0], r + dx : r + dx + mask.shape[1]]
    return out


def pixel_route(legal: np.ndarray, start: tuple[int, int], goal: tuple[int, int]) -> list[tuple[int, int]] | None:
    """Shortest 8-connected route (x, y) over legal pixels; None if there is none."""
    h, w = legal.shape
    if not (legal[start[1], start[0]] and legal[goal[1], goal[0]]):
        return None
    best, came, heap = {start: 0.0}, {}, [(0.0, start)]
    moves = [(dx, dy, math.hypot(dx, dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    while heap:
        d, at = heapq.heappop(heap)
        if at == goal:
            route = [at]
            while at != start:
                at = came[at]
                route.append(at)
            return route[::-1]
        if d > best[at]:
            continue
        for dx, dy, cost in moves:
            x, y = at[0] + dx, at[1] + dy
            if 0 <= x < w and 0 <= y < h and legal[y, x] and d + cost < best.get((x, y), math.inf):
                best[x, y], came[x, y] = d + cost, at
                heapq.heappush(heap, (d + cost, (x, y)))
    return None


def pull(route: Points, mask: np.ndarray, radius: float) -> Points:
    """Shortcut a route: from each point go straight to the farthest one found visible by bisection."""
    out, i = [route[0]], 0
    while i < len(route) - 1:
        low, high = i + 1, len(route) - 1
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if first_collision(mask, [route[i], route[mid]], radius) is None else (low, mid - 1)
        out.append(route[low])
        i = low
    return out


def geodesic(mask: np.ndarray, start: tuple, goal: tuple, radius: float = 3, margin: float = 1) -> tuple[float, Points]:
    """Length and points of the shortest legal route; an error if the ends aren't connected."""
    legal = erode(mask, radius + margin)
    ends = [tuple(int(np.rint(c)) for c in p) for p in (start, goal)]
    route = pixel_route(legal, *ends)
    if route is None:
        raise ValueError("no legal route")
    points = pull([(float(x), float(y)) for x, y in route], mask, radius)
    return path_length(points), points


def component(mask: np.ndarray, seed: tuple[int, int]) -> np.ndarray:
    """The 4-connected open region around seed (x, y), grown a ring at a time."""
    out = np.zeros_like(mask)
    if not mask[seed[1], seed[0]]:
        return out
    out[seed[1], seed[0]] = True
    while True:
        grown = out.copy()
        grown[1:] |= out[:-1]
        grown[:-1] |= out[1:]
        grown[:, 1:] |= out[:, :-1]
        grown[:, :-1] |= out[:, 1:]
        grown &= mask
        if (grown == out).all():
            return out
        out = grown


def endpoint_radius(mask: np.ndarray, centre: tuple[float, float], radius: float) -> float:
    """The radius shrunk so that all open pixels within belong to the corridor at the centre."""
    cx, cy = (int(np.rint(c)) for c in centre)
    r = math.ceil(radius)
    y0, x0 = max(0, cy - r), max(0, cx - r)
    window = mask[y0 : cy + r + 1, x0 : cx + r + 1]
    if not mask[cy, cx]:
        raise ValueError("the endpoint is not on the mask")
    ys, xs = np.nonzero(window & ~component(window, (cx - x0, cy - y0)))
    away = np.hypot(xs + x0 - centre[0], ys + y0 - centre[1])
    away = away[away <= radius]
    return max(0.0, float(away.min()) - 1) if len(away) else radius


def draw(width: int, height: int, corridors: list[tuple[Points, float]], pads: list[tuple[tuple[float, float], float]] = (), rects: list[tuple[float, float, float, float]] = ()) -> np.ndarray:
    """A mask of corridors (polyline, width), round pads and rectangles: a pixel is open if its centre is inside one."""
    ys, xs = np.mgrid[0:height, 0:width].astype(float)
    out = np.zeros((height, width), bool)
    for points, wide in corridors:
        for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
            lo_x, hi_x = int(max(0, min(ax, bx) - wide)), int(min(width, max(ax, bx) + wide + 1))
            lo_y, hi_y = int(max(0, min(ay, by) - wide)), int(min(height, max(ay, by) + wide + 1))
            x, y, dx, dy = xs[lo_y:hi_y, lo_x:hi_x], ys[lo_y:hi_y, lo_x:hi_x], bx - ax, by - ay
            t = np.clip(((x - ax) * dx + (y - ay) * dy) / ((dx * dx + dy * dy) or 1), 0, 1)
            out[lo_y:hi_y, lo_x:hi_x] |= np.hypot(x - ax - t * dx, y - ay - t * dy) <= wide / 2
    for (cx, cy), r in pads:
        out |= np.hypot(xs - cx, ys - cy) <= r
    for x0, y0, x1, y1 in rects:
        out |= (xs >= x0) & (xs <= x1) & (ys >= y0) & (ys <= y1)
    return out


#: Rows that are Python objects at a time.
AT_ONCE = 128


def apply_to_tasks(rows: DataFrame, kernel: Callable[[np.ndarray, dict], dict], schema: str, mask: np.ndarray | None = None) -> DataFrame:
    """kernel(mask, row) for every row of rows (a dict; columns mask binary, h, w and others); its dict is the new row.

    A mask that all rows share is given as ``mask`` and then is in no row. Rows stay in Arrow but for AT_ONCE of them, and as many
    masks as these have, so a task's memory doesn't depend on the rows of a batch.
    """
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                held: dict[tuple, np.ndarray] = {}
                out = []
                for row in batch.slice(lo, AT_ONCE).to_pylist():
                    if mask is None and (key := (row["mask"], row["h"], row["w"])) not in held:
                        held[key] = unpack(*key)
                    out.append(kernel(held[key] if mask is None else mask, row))
                yield pa.RecordBatch.from_pylist(out, schema=fields)

    return rows.mapInArrow(run, schema)
