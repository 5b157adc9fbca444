"""Task images: twenty painting styles over a mask, their certification, overlays and image variants.

A style is a row of a table: base colours and a list of layers, each a painter with its settings. Colours and settings
are drawn from a seed, so a style has as many looks as seeds. The corridor is painted through the mask itself, and
certification checks in pixels that what looks open is open. PNG bytes are written here, as no imaging library is assumed.
"""

from __future__ import annotations

import colorsys
import struct
import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import raster

Colour = tuple[int, int, int]
#: Certification: similar colours beyond the edge, blobs that extend a corridor, contrast within, contrast of markers.
EDGE_TAU, EDGE_SHARE, BLOB_BAND, BLOB_PX, INNER_TAU, INNER_SHARE, MARKER_CONTRAST, MARKER_PX = 32.0, 0.03, 18, 60, 110.0, 0.15, 30.0, 22
START, GOAL = (0, 200, 220), (255, 170, 0)


class Look(NamedTuple):
    """Colours drawn for one image: wall ground, accent for textures, corridor, outline."""

    ground: Colour
    accent: Colour
    corridor: Colour
    line: Colour


class Canvas(NamedTuple):
    pixels: np.ndarray
    mask: np.ndarray
    away: np.ndarray  # distance from the corridor, outside it
    rng: np.random.Generator
    look: Look


def _stripes(c: Canvas, step: int, across: bool = True, thick: int = 1) -> np.ndarray:
    y, x = np.indices(c.mask.shape)
    return (y if across else x) % step < thick


def _grid(c: Canvas, step: int) -> np.ndarray:
    return _stripes(c, step) | _stripes(c, step, False)


def _checks(c: Canvas, step: int) -> np.ndarray:
    y, x = np.indices(c.mask.shape)
    return (y // step + x // step) % 2 == 0


def _hatch(c: Canvas, step: int) -> np.ndarray:
    y, x = np.indices(c.mask.shape)
    return (x + y) % step < 2


def _speckle(c: Canvas, share: float) -> np.ndarray:
    return c.rng.random(c.mask.shape) < share


def _strata(c: Canvas, low: int, high: int) -> np.ndarray:
    edges = np.cumsum(c.rng.integers(low, high, c.mask.shape[0]))
    return np.repeat((np.searchsorted(edges, np.arange(c.mask.shape[0])) % 2 == 0)[:, None], c.mask.shape[1], 1)


def _dots(c: Canvas, count: int, radius: int) -> np.ndarray:
    out = np.zeros_like(c.mask)
    h, w = c.mask.shape
    offsets = raster.disk(radius)
    for y, x in zip(c.rng.integers(0, h, count), c.rng.integers(0, w, count), strict=True):
        out[(y + offsets[:, 0]).clip(0, h - 1), (x + offsets[:, 1]).clip(0, w - 1)] = True
    return out


def _band(c: Canvas, low: float, high: float) -> np.ndarray:
    """Outside the corridor, at a distance from it."""
    return ~c.mask & (c.away >= low) & (c.away < high)


def _waves(c: Canvas, step: int) -> np.ndarray:
    y, x = np.indices(c.mask.shape)
    return (y + np.rint(3 * np.sin(x / 9))).astype(int) % step < 2


PAINTERS: dict[str, Callable[..., np.ndarray]] = {"stripes": _stripes, "grid": _grid, "checks": _checks, "hatch": _hatch, "speckle": _speckle, "strata": _strata, "dots": _dots, "band": _band, "waves": _waves}


class Style(NamedTuple):
    """hues: ground, accent, corridor (0 to 1); values likewise; layers: (painter, settings) outside the corridor; inner: within it."""

    hues: tuple[float, float, float]
    values: tuple[float, float, float]
    layers: tuple[tuple, ...]
    inner: tuple[tuple, ...] = ()
    edge: float = 2.0


# The names of the styles. Their looks are this module's own.
STYLES: dict[str, Style] = {
    "notebook": Style((0.12, 0.58, 0.12), (0.72, 0.60, 0.99), (("stripes", 26),), edge=4),
    "dungeon-pebble": Style((0.09, 0.09, 0.09), (0.14, 0.55, 0.90), (("speckle", 0.05), ("dots", 40, 3))),
    "blueprint-rooms": Style((0.60, 0.58, 0.58), (0.40, 0.62, 0.97), (("grid", 20),)),
    "forest-path": Style((0.33, 0.30, 0.10), (0.35, 0.50, 0.92), (("dots", 90, 4),)),
    "glow-cavern": Style((0.75, 0.80, 0.50), (0.15, 0.45, 0.90), (("speckle", 0.02),)),
    "parchment-chart": Style((0.62, 0.60, 0.12), (0.25, 0.60, 0.93), (("speckle", 0.01),)),
    "watercolor-archipelago": Style((0.55, 0.52, 0.13), (0.60, 0.75, 0.98), (("waves", 14),)),
    "neon-pipes": Style((0.70, 0.85, 0.45), (0.10, 0.30, 0.95), (("grid", 24),), edge=3),
    "circuit-board": Style((0.40, 0.38, 0.12), (0.30, 0.45, 0.90), (("grid", 12),)),
    "hedge-garden": Style((0.30, 0.33, 0.12), (0.30, 0.50, 0.94), (("dots", 120, 3), ("band", 8, 14))),
    "metro-map": Style((0.15, 0.60, 0.02), (0.92, 0.80, 0.45), (("grid", 40),), edge=3),
    "ice-glacier": Style((0.55, 0.56, 0.58), (0.60, 0.75, 0.99), (("hatch", 30),)),
    "treasure-map": Style((0.09, 0.08, 0.12), (0.50, 0.35, 0.95), (("dots", 14, 6),)),
    "paper-cutout": Style((0.95, 0.95, 0.10), (0.60, 0.40, 0.98), (("band", 2, 7),)),
    "volcanic": Style((0.02, 0.05, 0.12), (0.15, 0.70, 0.95), (("speckle", 0.03),)),
    "candy-pastel": Style((0.90, 0.85, 0.15), (0.70, 0.60, 0.99), (("stripes", 18, False, 8),)),
    "mosaic-tile": Style((0.55, 0.57, 0.12), (0.35, 0.50, 0.95), (("checks", 9),)),
    "pencil-sketch": Style((0.10, 0.10, 0.12), (0.65, 0.35, 0.99), (("hatch", 7),)),
    "desert-canyon": Style((0.06, 0.07, 0.13), (0.45, 0.60, 0.97), (("strata", 5, 14),)),
    "biolab-vessels": Style((0.98, 0.96, 0.50), (0.45, 0.60, 0.95), (("dots", 60, 2),)),
}


def register(name: str, style: Style) -> None:
    """Add a style of one's own."""
    STYLES[name] = style


def sample(name: str, seed: int) -> Look:
    rng, s = np.random.default_rng([seed, zlib.crc32(name.encode())]), STYLES[name]

    def colour(hue: float, value: float, saturation: float) -> Colour:
        rgb = colorsys.hsv_to_rgb((hue + rng.uniform(-0.02, 0.02)) % 1, saturation, min(1.0, max(0.0, value + rng.uniform(-0.02, 0.02))))
        return tuple(round(255 * v) for v in rgb)

    light = s.values[2] > 0.6
    ground, accent = (colour(h, v, 0.6) for h, v in zip(s.hues[:2], s.values[:2], strict=True))
    corridor = colour(s.hues[2], s.values[2], 0.12 if light else 0.5)
    return Look(ground, accent, corridor, tuple(round(v * 0.4) for v in ground))


def paint(mask: np.ndarray, name: str, seed: int, start: tuple | None = None, goal: tuple | None = None) -> np.ndarray:
    """Pixels (h, w, 3) of a task in a style."""
    look, s = sample(name, seed), STYLES[name]
    c = Canvas(np.empty((*mask.shape, 3), np.uint8), mask, raster.distance_to_wall(~mask), np.random.default_rng([seed, 1]), look)
    c.pixels[:] = look.ground
    for kind, *settings in s.layers:
        c.pixels[PAINTERS[kind](c, *settings) & ~mask] = look.accent
    c.pixels[_band(c, 0, s.edge)] = look.line
    c.pixels[mask] = look.corridor
    for kind, *settings in s.inner:
        c.pixels[PAINTERS[kind](c, *settings) & mask] = tuple(max(0, v - 12) for v in look.corridor)
    for at, badge in ((start, START), (goal, GOAL)):
        if at is not None:
            badge_disk(c.pixels, at, badge)
    return c.pixels


def badge_disk(pixels: np.ndarray, at: tuple, colour: Colour, radius: int = 5) -> None:
    y, x = np.indices(pixels.shape[:2])
    pixels[np.hypot(x - at[0], y - at[1]) <= radius] = colour


def certify(pixels: np.ndarray, mask: np.ndarray, look: Look, markers: list[tuple] = ()) -> list[str]:
    """The checks that fail: edge, extension, interior, marker."""
    y, x = np.indices(mask.shape)
    clear = np.ones_like(mask)
    for at in markers:
        clear &= np.hypot(x - at[0], y - at[1]) > MARKER_PX
    far = np.sqrt(((pixels.astype(float) - np.array(look.corridor)) ** 2).sum(axis=2))
    away = raster.distance_to_wall(~mask)
    failed = []
    rim = ~mask & (away <= 2) & clear
    if rim.any() and (far[rim] < EDGE_TAU).mean() > EDGE_SHARE:
        failed.append("edge")
    alike = ~mask & (far < EDGE_TAU) & (away <= BLOB_BAND) & clear
    touching = np.argwhere(alike & (away <= 1.5))
    left = alike.copy()
    for ty, tx in touching:
        if left[ty, tx]:
            blob = raster.component(left, (int(tx), int(ty)))
            left &= ~blob
            if blob.sum() > BLOB_PX:
                failed.append("extension")
                break
    inner = mask & clear
    if inner.any() and (far[inner] > INNER_TAU).mean() > INNER_SHARE:
        failed.append("interior")
    for at in markers:
        d = np.hypot(x - at[0], y - at[1])
        ring = (d > 6) & (d <= 12) & mask
        if ring.any() and np.linalg.norm(pixels[d <= 4].mean(axis=0) - pixels[ring].mean(axis=0)) < MARKER_CONTRAST:
            failed.append("marker")
            break
    return failed


#: Fixed value: images tried before a task is given up.
RESAMPLES = 6


def certified(mask: np.ndarray, name: str, seed: int, start: tuple, goal: tuple, tries: int = RESAMPLES) -> tuple[np.ndarray, list[tuple[int, list[str]]]]:
    """The first look that passes, and the rejected ones before it (seed, failures). Raises if none does: an image that fails is never returned."""
    rejected = []
    for k in range(tries):
        look_seed = seed + 1_000_003 * k
        pixels = paint(mask, name, look_seed, start, goal)
        failed = certify(pixels, mask, sample(name, look_seed), [start, goal])
        if not failed:
            return pixels, rejected
        rejected.append((look_seed, failed))
    raise ValueError(f"no image in style {name} is certified after {tries} tries: {rejected}")


def overlay(pixels: np.ndarray, points: raster.Points, success: bool, collision: tuple | None = None) -> np.ndarray:
    """A path drawn over an image, green or red, with a mark where it collides."""
    out = pixels.copy()
    line = raster.draw(out.shape[1], out.shape[0], [(points, 3)])
    out[line] = (0, 160, 60) if success else (210, 30, 30)
    if collision is not None:
        badge_disk(out, collision, (255, 0, 255), 4)
    return out


def rescale(pixels: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resize."""
    h, w = (max(1, round(n * scale)) for n in pixels.shape[:2])
    ys, xs = (np.clip((np.arange(n) + 0.5) / scale - 0.5, 0, m - 1) for n, m in ((h, pixels.shape[0]), (w, pixels.shape[1])))
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, pixels.shape[0] - 1), np.minimum(x0 + 1, pixels.shape[1] - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    p = pixels.astype(float)
    top, low = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def variant(mode: str, own: np.ndarray, other: np.ndarray | None = None, scale: float = 1.0) -> np.ndarray:
    """What a model is shown: real, blank, mismatched (another task's image) or rescale."""
    if mode == "blank":
        return np.full_like(own, 255)
    if mode == "mismatched":
        if other is None:
            raise ValueError("no image of another task")
        return other
    return rescale(own, scale) if mode == "rescale" else own


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB or gray PNG."""
    rows = pixels if pixels.ndim == 3 else pixels[:, :, None]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 2 if rows.shape[2] == 3 else 0, 0, 0, 0)
    body = b"".join(b"\0" + r.tobytes() for r in rows.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


RENDERS = "slot long, style string, attempts int, failures string, bytes int, png binary"


def render_all(worlds: DataFrame, seed: int = 0) -> DataFrame:
    """Every world (slot, mask, h, w, route) in every style, certified; a task's images are made where its row is.

    A style without a certified image has a row without bytes, whose failures are those of the last try.
    """

    def run(batches):
        for frame in batches:
            for _, row in frame.iterrows():
                mask = raster.unpack(row["mask"], row["h"], row["w"])
                ends = [(row["route"][i]["x"], row["route"][i]["y"]) for i in (0, -1)]
                out = []
                for k, name in enumerate(STYLES):
                    try:
                        pixels, rejected = certified(mask, name, seed + int(row["slot"]) * 1_000_003 + k, *ends)
                        data = png(pixels)
                        out.append((int(row["slot"]), name, len(rejected) + 1, "", len(data), data))
                    except ValueError as failed:
                        out.append((int(row["slot"]), name, RESAMPLES, str(failed), 0, None))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in RENDERS.split(", ")])

    return worlds.mapInPandas(run, RENDERS)


def style_swap(worlds: DataFrame, styles: list[str], seed: int = 0) -> DataFrame:
    """Worlds in each of some styles, all or nothing: a world of which one style can't be certified is left out.

    The mask and route of a world are the same in all its styles, which is what makes them comparable. The style seed
    is seed + slot * 1,000,003 + the style's position.
    """
    schema = "slot long, style string, mask_sha256 string, png binary"

    def run(batches):
        for frame in batches:
            out = []
            for _, row in frame.iterrows():
                mask = raster.unpack(row["mask"], row["h"], row["w"])
                route = [(p["x"], p["y"]) for p in row["route"]]
                try:
                    done = [certified(mask, name, seed + int(row["slot"]) * 1_000_003 + k, route[0], route[-1])[0] for k, name in enumerate(styles)]
                except ValueError:
                    continue  # all styles or none
                if raster.first_collision(mask, route) is None:
                    out += [(int(row["slot"]), name, raster.mask_hash(mask), png(pixels)) for name, pixels in zip(styles, done, strict=True)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return worlds.mapInPandas(run, schema)
