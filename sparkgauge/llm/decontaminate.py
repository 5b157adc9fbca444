"""Benchmark decontamination by pigeonhole edit matching.

A text that holds a test item with at most k errors holds at least one of any k + 1 pieces of it unchanged. So every
item is cut into k + 1 pieces, one automaton finds all pieces of all items in a text, and around each hit Myers'
bit-parallel algorithm computes the edit distance of the whole item to the best place. The pieces needn't cover the item: they
are cut from stretches that few items share, so a common opening of many questions leads to none of them. Items of one
text are compared once. Letter case and white space don't count as errors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Errors allowed, as a share of an item's characters.
ERROR_RATE = 0.08
#: A shorter item allows no error and must stand as whole words: such strings occur by chance within others.
MIN_CHARS = 20
#: Stretches of so many characters that more items than this share are common, and a piece has so many characters at least if it is cut around them.
GRAM, SHARED = 8, 8
#: Characters of items in one automaton; a larger benchmark takes one pass over the documents for each such block.
BLOCK_CHARS = 4_000_000

LEAKS = T.ArrayType(T.StructType().add("item_id", "long").add("start", "long").add("end", "long").add("distance", "long"))
_LEAKS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64())]))


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of normalise(text), where it comes from in text."""
    out: list[int] = []
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(m.start() - 1)
        for i, c in enumerate(m[0], m.start()):
            out += [i] * len(c.lower())
    return out


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern of m characters within text, the first of equals; None if worse than most."""
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = every, 0, m, (most + 1, -1)
    for j, c in enumerate(text):
        eq = pattern.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (every & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1, mh << 1
        plus = (mh | ~(xv | ph)) & every
        minus = ph & xv & every
        if score < best[0]:
            best = (score, j + 1)
    return best if best[1] >= 0 else None


def common_places(texts: list[str]) -> list[np.ndarray]:
    """For each text, which characters begin a stretch of GRAM characters that more than SHARED of the texts hold."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    hashed = np.zeros(max(0, len(codes) - GRAM + 1), np.uint64)
    for j in range(GRAM if len(hashed) else 0):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(hashed)] + np.uint64(1)
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(hashed)) + GRAM <= np.repeat(starts + sizes, sizes)[: len(hashed)]
    held, where = hashed[inside], np.flatnonzero(inside)
    _, number = np.unique(held, return_inverse=True)
    order = np.lexsort((owner[where], number))
    fresh = np.concatenate([[True], (np.diff(number[order]) != 0) | (np.diff(owner[where][order]) != 0)]) if len(order) else np.zeros(0, bool)
    often = np.bincount(number[order][fresh]) > SHARED if len(order) else np.zeros(0, bool)
    marked = np.zeros(len(codes), bool)
    marked[where] = often[number] if len(order) else False
    return [marked[a : a + n] for a, n in zip(starts, sizes, strict=True)]


def pieces_of(m: int, k: int, common: np.ndarray) -> list[tuple[int, int]]:
    """k + 1 disjoint (start, end) of an item of m characters, between its common stretches if they leave room for pieces of GRAM characters, else even ones over all of it."""
    covered = np.zeros(m + 1, bool)
    for a in np.flatnonzero(common):
        covered[a : a + GRAM] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[True], covered[:m], [True]]).astype(int)))
    runs = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= GRAM]
    room = sum(b - a for a, b in runs)
    if not covered.any() or sum((b - a) // GRAM for a, b in runs) < k + 1:
        return [(m * p // (k + 1), m * (p + 1) // (k + 1)) for p in range(k + 1)]
    shares = [min((b - a) // GRAM, (k + 1) * (b - a) // room) for a, b in runs]
    while sum(shares) < k + 1:  # the rest to where pieces are longest
        best = max((i for i, (a, b) in enumerate(runs) if (b - a) // GRAM > shares[i]), key=lambda i: (runs[i][1] - runs[i][0]) / (shares[i] + 1))
        shares[best] += 1
    return [(a + (b - a) * p // n, a + (b - a) * (p + 1) // n) for (a, b), n in zip(runs, shares, strict=True) for p in range(n)]


class Matcher:
    """Finds all items of a block in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for item_id, text in items:
            if norm := normalise(text):
                by_text.setdefault(norm, []).append(item_id)
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for (norm, ids), common in zip(by_text.items(), common_places(list(by_text)), strict=True):
            m, k = len(norm), int(rate * len(norm)) if len(norm) >= MIN_CHARS else 0
            for a, b in pieces_of(m, k, common) if m >= MIN_CHARS else [(0, m)]:
                pieces.setdefault(norm[a:b], []).append((len(self.items), a))
            self.items.append((ids, m, k, masks(norm), masks(norm[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) in code points of text, by place; matches of one item don't overlap."""
        if not text or not self.items:
            return []
        norm = normalise(text)
        begins: dict[int, list[int]] = {}
        for at, (n, uses) in self.automaton.iter(norm):
            for item, offset in uses:
                begins.setdefault(item, []).append(at - n + 1 - offset)
        found = []
        for item, starts in begins.items():
            ids, m, k, ahead, back = self.items[item]
            if m < MIN_CHARS:
                end = 0
                for s in starts:
                    if s >= end and not norm[s - 1 : s].isalnum() and not norm[s + m : s + m + 1].isalnum():
                        found, end = [*found, *((i, s, s + m, 0) for i in ids)], s + m
                continue
            for low, high in self._windows(sorted(starts), m, k, len(norm)):
                parts = [(low, high)]
                while parts:
                    low, high = parts.pop()
                    if high - low < m - k or not (hit := myers(ahead, m, norm[low:high], k)):
                        continue
                    end = low + hit[1]
                    begin = max(low, end - m - k)
                    reach = myers(back, m, norm[begin:end][::-1], k)
                    start = end - (reach[1] if reach else min(m, end - begin))
                    found += [(i, start, end, hit[0]) for i in ids]
                    parts += [(low, start), (end, high)]
        if not found:
            return []
        at = places(text)
        return sorted(((i, at[s], at[e - 1] + 1, d) for i, s, e, d in found), key=lambda x: (x[1], x[2], x[0] is None, x[0]))

    @staticmethod
    def _windows(starts: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
        low = high = None
        for s in starts:
            a, b = max(0, s - k), min(n, s + m + k)
            if high is not None and a <= high:
                high = max(high, b)
            else:
                if high is not None:
                    yield low, high
                low, high = a, b
        if high is not None:
            yield low, high


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.length("text") > 0).toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _finder(block: list[tuple[int, str]], rate: float):
    held: list[Matcher] = []  # built once for each task

    @F.arrow_udf(LEAKS)
    def find(text: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(block, rate))
        names = ("item_id", "start", "end", "distance")
        return pa.array([[dict(zip(names, x, strict=True)) for x in held[0].find(t.as_py())] for t in text], _LEAKS_ARROW)

    return find


def with_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, into: str = "leaks") -> DataFrame:
    """docs with a column of leaks: an array of (item_id, start, end, distance), empty where a text holds no item.

    Every row stays, repeated ones too. Null and empty texts have no leaks; null and blank items match nothing, and those of
    fewer than MIN_CHARS characters (white space as one space) whole words without an error. Items of equal text match each. Matches of one item
    don't overlap: the best of a stretch counts, the first of equals, and then what is left before and after it. A benchmark of several blocks takes a pass each,
    written out in between, so the driver never holds more than one block.
    """
    rows = docs.withColumn(into, F.array().cast(LEAKS))
    for i, block in enumerate(_blocks(benchmark)):
        if i:
            rows = materialize(rows, "leaks")
        more = _finder(block, rate)(F.col("text").cast("string"))
        rows = rows.withColumn(into, F.concat(into, more) if i else more)
    return rows


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """One row per leak: doc_id, item_id, start, end (code points of the text, end exclusive), distance. See with_leaks."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, rate)
    # explode() would add a filter on the array below it, and so find everything twice
    return found.select("doc_id", F.explode_outer("leaks").alias("leak")).where(F.col("leak").isNotNull()).select("doc_id", "leak.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no item, repeated rows too, with their own columns. An empty benchmark drops none."""
    return with_leaks(docs, benchmark, rate, "__leaks").where(F.size("__leaks") == 0).drop("__leaks")
