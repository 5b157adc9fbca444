"""Substring dedup by hashing of lines, sentences and word runs.

Units are lines, the sentences in them, and runs of ANCHOR_WORDS words that the text itself marks out. A unit is
normalised (lower case, single spaces) and hashed; digests are grouped over all documents; the occurrence
that comes first stays and the others are removed, with their offsets in the original text retained.

A run is marked out (an anchor) if its hash is the least among the runs within some PASSAGE_WORDS words in a row. That depends on
those words only, so every passage of PASSAGE_WORDS words or more that occurs again has a unit in common with its first
occurrence, whatever its lines, sentences and surroundings. Units that follow one another in both places are merged, and
the ends are moved outwards, word by word, as far as both places agree.

Words stand between white space; in scripts that don't space their words, every character is one.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lookup, materialize

#: Shorter lines and sentences recur without being copies (bylines, menus, licences, set phrases) and are left alone.
MIN_WORDS = 20
#: Repeated runs of this many words are passages; an anchor is one of ANCHOR_WORDS of them. Apart by PASSAGE_WORDS - ANCHOR_WORDS + 1 at most.
PASSAGE_WORDS, ANCHOR_WORDS = 50, 36
SENTENCE_END, WIDE_STOP = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*"), re.compile("[。！？]")
#: Thai to Tibetan, Myanmar, Khmer, Japanese and Chinese: scripts without spaces between words.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNSPACED_LETTER, WORD = re.compile(f"[{UNSPACED}]"), re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")


def split_words(text: str) -> list[str]:
    """The lower-case words of a text, as many as WORD finds in it."""
    if text.isascii() or not UNSPACED_LETTER.search(text):
        return text.lower().split()
    return [m.lower() for m in WORD.findall(text)]


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: 0 for white space, 2 for a word of its own, 1 for others."""
    kinds = np.ones(0x110000, np.uint8)
    kinds[[i for i in range(0x10000) if chr(i).isspace()]] = 0
    for first, last in re.findall("(.)-(.)", UNSPACED):
        kinds[ord(first) : ord(last) + 1] = 2
    return kinds


def word_places(text: str) -> np.ndarray:
    """A row (start, end) for each of the words that split_words finds."""
    kinds = np.zeros(len(text) + 2, np.uint8)
    kinds[1:-1] = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    here, alone = kinds[1:-1], kinds[1:-1] == 2
    starts, ends = ((here > 0) & (alone | (here != beside)) for beside in (kinds[:-2], kinds[2:]))
    return np.stack([np.flatnonzero(starts), np.flatnonzero(ends) + 1], axis=1).astype(np.int32)


def _sentences(line: str, words: list[str] | None, min_words: int) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of min_words or more in a line of several.

    words are those of the line if every sentence in it ends with a word: then they needn't be split again, and places are sought only
    where a sentence is long enough.
    """
    if words is not None:
        ends = [i for i, w in enumerate(words, 1) if w[-1] in ".!?"]
        if not ends or ends[-1] < len(words):
            ends.append(len(words))
        parts = [words[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if len(parts) < 2 or max(map(len, parts)) < min_words:
            return
    edges = [0]
    for cut in SENTENCE_END.finditer(line):
        edges += cut.span()
    edges.append(len(line))
    spans = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if b > a]
    if len(spans) < 2:
        return
    if words is None:
        parts = [split_words(line[a:b]) for a, b in spans]
    for (a, b), part in zip(spans, parts, strict=True):
        if len(part) >= min_words:
            yield a, b, part


def _digest(words: list[str]) -> bytes:
    return blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def units(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(level, start, end, words, digest) of every line and sentence of min_words or more; a line of one sentence is a line only."""
    text = text or ""
    spaced, at = text.isascii() or not UNSPACED_LETTER.search(text), 0
    whole = spaced and (text.isascii() or not WIDE_STOP.search(text))
    for line in text.split("\n"):
        # a line of fewer words has no sentence of more
        if len(line) >= (2 * min_words - 1 if spaced else min_words) and len(words := split_words(line)) >= min_words:
            yield "line", at, at + len(line), len(words), _digest(words)
            for a, b, part in _sentences(line, words if whole else None, min_words):
                yield "sentence", at + a, at + b, len(part), _digest(part)
        at += len(line) + 1


UNITS = "doc_id long, row_uid long, level string, start int, end int, words int, high long, low long"


def _emit(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        names = [x.split()[0] for x in UNITS.split(", ")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            *columns, digests = zip(*rows, strict=True)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), *map(pa.array, halves.T)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows += [(doc_id, uid, *unit) for unit in units(text.as_py(), min_words)]
                if len(rows) > 100_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

    return run


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS, uid: str | None = None) -> DataFrame:
    """The units to remove: doc_id, row_uid, level, start, end, words, keep_doc_id, keep_start, copies.

    A line of one sentence and that sentence within a longer line are the same unit. Occurrences rank by doc_id (null last), then row, then place; the first stays, also among repeats within a
    document and among rows with one doc_id. copies counts all occurrences. Offsets are code points of the original
    text, end exclusive. Null and empty texts have no units; other columns are ignored; an empty table gives no rows.
    row_uid is what docs has in the column uid, a number of each row, or else a number of this run; other columns of docs aren't read, whatever their names.
    """
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long"), number.alias("row_uid"), F.col("text").cast("string"))
    found = materialize(rows.mapInArrow(_emit(min_words), UNITS), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_uid", "start")
    groups = found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    groups = materialize(groups.select("high", "low", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.row_uid").alias("keep_uid"), F.col("first.start").alias("keep_start"), "copies"), "repeats")
    met = lookup(found, groups, ["high", "low"], "copies", how="inner")
    later = (F.col("row_uid") != F.col("keep_uid")) | (F.col("start") != F.col("keep_start"))
    return met.where(later).select("doc_id", "row_uid", "level", "start", "end", "words", "keep_doc_id", "keep_start", "copies")


#: Bases of the rolling hashes, odd so that they have inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """A 64-bit hash of a word; forgotten from time to time, as a corpus has no end of words. Long ones are not kept."""

    def __missing__(self, word: str) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) > 300_000:
                self.clear()
            self[word] = out
        return out


class _Rolling:
    """Hashes of all windows of some length, modulo 2^64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.grow(1 << 12)

    def grow(self, n: int) -> None:
        powers = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
        self.up, self.down = powers(self.base), powers(self.inverse)

    def __call__(self, hashes: np.ndarray, size: int) -> np.ndarray:
        n = len(hashes)
        if n > len(self.up):
            self.grow(2 * n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[:n], dtype=np.uint64)])
        return (sums[size:] - sums[:-size]) * self.down[: n - size + 1]


def _hashes(words: list[str], cache: _Words) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _slide(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or largest of every width values in a row, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = best(values[:-step], values[step:]), have + step
    return values


def _is_anchor(mixed: np.ndarray, width: int) -> np.ndarray:
    """Of runs by their hashes, those that are the least of some width of them in a row."""
    edge = np.zeros(width - 1, np.uint64)
    return _slide(np.maximum, np.concatenate([edge, _slide(np.minimum, mixed, width), edge]), width) == mixed


def _anchors(size: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, roll = _Words(), _Rolling(BASES[0])
        for batch in batches:
            starts, ends, counts, found = [], [], [], []
            for text in batch.column("text"):
                t = text.as_py()
                words = split_words(t)
                if len(words) < size:
                    starts.append(None), ends.append(None), counts.append(None), found.append(None)
                    continue
                mixed = _mixed(roll(_hashes(words, cache), anchor))
                starts.append(len(t) - len(t.lstrip())), ends.append(len(t.rstrip())), counts.append(len(words))
                found.append(mixed[_is_anchor(mixed, size - anchor + 1)].view(np.int64))
            columns = [batch.column("doc_id"), batch.column("row_uid"), batch.column("body"), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(counts, pa.int32()), pa.array(found, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_uid", "body", "start", "end", "words", "anchors"])
            yield out.filter(out.column("words").is_valid())

    return run


RUNS = "doc_id long, row_uid long, weight long, at int, start int, end int, after int, high long, low long"


def _runs(size: int, anchor: int):
    """Anchors of texts that are among the given ones; at counts words, and after is where the next word begins."""
    names = [x.split()[0] for x in RUNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, rolls = _Words(), [_Rolling(b) for b in BASES]
        for batch in batches:
            held, n = [], 0
            for *same, text, given in zip(*(batch.column(c) for c in ("doc_id", "row_uid", "weight", "text", "anchors")), strict=True):
                t = text.as_py()
                hashes = _hashes(split_words(t), cache)
                mixed = _mixed(rolls[0](hashes, anchor))
                picked = np.flatnonzero(_is_anchor(mixed, size - anchor + 1) & np.isin(mixed.view(np.int64), given.values.to_numpy()))
                places = word_places(t)
                after = np.append(places[1:, 0], np.int32(len(t)))
                high, low = (roll(h, anchor)[picked].view(np.int64) for roll, h in zip(rolls, (hashes, _mixed(hashes)), strict=True))
                last = picked + anchor - 1
                rest = [picked.astype(np.int32), places[picked, 0], places[last, 1], after[last], high, low]
                held.append([*(pa.repeat(v, len(picked)) for v in same), *map(pa.array, rest)])
                n += len(picked)
                if n > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names=names)
                    held, n = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*held, strict=True)], names=names)

    return run


CONTEXTS = "row_uid long, side int, at int, words array<long>, places array<int>"


def _contexts(reach: int):
    """The words before (side 0) or from (side 1) each given place of a text, nearest first, ``reach`` at most, and where they start or end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, names, steps = _Words(), [x.split()[0] for x in CONTEXTS.split(", ")], np.arange(reach)[None, :]
        for batch in batches:
            asked, parts = batch.column("asked"), []
            edges, sides, places_at = asked.offsets.to_numpy(), asked.values.field("side").to_numpy(), asked.values.field("at").to_numpy()
            for i, (uid, text) in enumerate(zip(batch.column("row_uid").to_pylist(), batch.column("text"), strict=True)):
                t, side, at = text.as_py(), sides[edges[i] : edges[i + 1]], places_at[edges[i] : edges[i + 1]]
                hashes, places = _hashes(split_words(t), cache).view(np.int64), word_places(t)
                n = np.minimum(reach, np.where(side == 0, at, len(places) - at))
                inside = steps < n[:, None]
                word = np.where(side[:, None] == 0, at[:, None] - 1 - steps, at[:, None] + steps)[inside]
                parts.append((np.full(len(side), uid), side, at, n, hashes[word], places[word, np.repeat(side, n)]))
            if parts:
                uid, side, at, n, words, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(side), pa.array(at), pa.ListArray.from_arrays(offsets, pa.array(words)), pa.ListArray.from_arrays(offsets, pa.array(ends))], names=names)

    return run


def _widened(spans: DataFrame, texts: DataFrame, reach: int) -> DataFrame:
    """spans whose ends are moved outwards, by up to reach words, as far as the text and the earlier one agree.

    No unit lies further out, so an end that could go on has another span there. Contexts are fetched once for each place of a text
    that spans start or end at, of which a text has at most as many as words, however many spans lead to it.
    """
    ends = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("from").alias("at")), F.struct(F.lit(1).alias("side"), F.col("to").alias("at"))))
    sides = spans.where(~F.col("own")).withColumn("end", ends).select("span", "row_uid", "end.side", "end.at", F.col("keep_uid").alias("k_uid"), (F.col("end.at") - F.col("shift")).alias("k_at"))
    sides = materialize(sides, "span-ends")
    mine = sides.groupBy("row_uid", "side", "at").agg(F.count("*").alias("n"))
    kept = sides.groupBy(F.col("k_uid").alias("row_uid"), "side", F.col("k_at").alias("at")).agg(F.count("*").alias("n"))
    asked = mine.unionByName(kept).groupBy("row_uid").agg(F.collect_set(F.struct("side", "at")).alias("asked"))
    found = materialize(texts.select("row_uid", "text").join(asked, "row_uid").mapInArrow(_contexts(reach), CONTEXTS), "contexts")
    key = ["row_uid", "side", "at"]
    first = lookup(sides, materialize(found.join(mine, key), "own-contexts"), key, "n", how="inner").drop("n")
    first = materialize(first.withColumnsRenamed({"words": "own_words", "places": "own_places"}), "ends-here")
    theirs = materialize(found.join(kept, key).select(F.col("row_uid").alias("k_uid"), "side", F.col("at").alias("k_at"), "words", "places", "n"), "kept-contexts")
    both = lookup(first, theirs, ["k_uid", "side", "k_at"], "n", how="inner")
    same = F.zip_with("own_words", "words", lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, False)
    n = F.when(differ > 0, differ - 1).otherwise(F.size(same)).cast("int")
    at = lambda places: F.when(F.col("more") > 0, F.get(places, F.col("more") - 1))
    moved = both.withColumn("more", n).select("span", "side", "more", at("own_places").alias("own_place"), at("places").alias("keep_place"))
    left = lambda c: F.max(F.when(F.col("side") == 0, F.col(c)))
    moved = moved.groupBy("span").agg(left("own_place").alias("new_start"), left("keep_place").alias("new_keep"), F.max(F.when(F.col("side") == 1, F.col("own_place"))).alias("new_end"), F.sum("more").cast("int").alias("more"))
    wide = spans.join(moved, "span", "left")
    wide = wide.withColumns({"start": F.coalesce("new_start", "start"), "end": F.coalesce("new_end", "end"), "keep_start": F.coalesce("new_keep", "keep_start"), "words": F.col("words") + F.coalesce("more", F.lit(0))})
    # units that the first text doesn't mark out lead elsewhere, often to the same words: the earliest text counts
    first = F.min(F.struct(F.col("keep_doc_id").isNull().alias("no_id"), "keep_doc_id", "keep_uid", "keep_start"))
    one = wide.groupBy("row_uid", "start", "end").agg(F.first("doc_id").alias("doc_id"), F.first("level").alias("level"), F.first("words").alias("words"), first.alias("keep"), F.max("copies").alias("copies"))
    return materialize(one.select("*", "keep.keep_doc_id", "keep.keep_start").drop("keep"), "wide-spans")


def repeated_passages(docs: DataFrame, size: int = PASSAGE_WORDS, anchor: int = ANCHOR_WORDS, uid: str | None = None) -> DataFrame:
    """The runs of words that an earlier place holds too, in the columns of repeated_units; level is passage.

    Rank and offsets are those of repeated_units. Every repeated run of size words or more is found, with all words on which it agrees
    with the earlier place that its units lead to; where they lead to several places, spans may overlap, and up to size - anchor words at an
    end can be missing. Of shorter runs, those of anchor words or more are found where a unit lies in them. keep_start is where the run begins in the
    earlier place, and copies the least count of its units. Where a run overlaps its own earlier place, as in a word said a hundred times,
    the first anchor words stay; runs with an earlier place in their own text are not widened. Later rows of equal text are passages as a whole.
    Null, empty and shorter texts have none; an empty table gives no rows.
    """
    number = F.col(uid) if uid else F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("long"), number.alias("row_uid"), F.col("text").cast("string")).where(F.length("text") >= size)
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = rows.withColumn("body", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = materialize(rows.mapInArrow(_anchors(size, anchor), "doc_id long, row_uid long, body binary, start int, end int, words int, anchors array<long>"), "texts")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_uid")
    bodies = texts.groupBy("body").agg(F.min(order).alias("first"), F.count("*").alias("weight"))
    bodies = materialize(bodies.select("body", F.col("first.row_uid").alias("keep_uid"), F.col("first.doc_id").alias("keep_doc_id"), "weight"), "bodies")
    known = materialize(lookup(texts, bodies, ["body"], "weight", how="inner"), "known")
    discard(texts, bodies)
    copies = known.where(F.col("row_uid") != F.col("keep_uid")).select("doc_id", "row_uid", F.lit("passage").alias("level"), "start", "end", "words", "keep_doc_id", F.col("start").alias("keep_start"), F.col("weight").alias("copies"))
    copies = materialize(copies, "copies")

    firsts = known.where(F.col("row_uid") == F.col("keep_uid"))
    anchors = firsts.select("row_uid", F.explode("anchors").alias("anchor"))
    often = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > 1), "anchors")
    met = lookup(anchors, often, ["anchor"], "n", how="inner").groupBy("row_uid").agg(F.collect_set("anchor").alias("anchors"))
    # The text is found again by its digest and doc_id, as a row's number may differ from one reading to the next.
    wanted = firsts.select("doc_id", "row_uid", "body", "weight").join(met, "row_uid").select(F.concat("body", doc).alias("spot"), "doc_id", "row_uid", "weight", "anchors")
    again = rows.select(F.concat("body", doc).alias("spot"), "text").join(wanted, "spot").dropDuplicates(["spot"])
    again = materialize(again.select("doc_id", "row_uid", "weight", "text", "anchors"), "again")
    discard(often, known)
    found = materialize(again.mapInArrow(_runs(size, anchor), RUNS), "runs")

    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_uid", "at", "start", "after")
    groups = found.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count("*").alias("n"), F.sum("weight").alias("copies")).where(F.col("n") > 1)
    first = {"keep_doc_id": "doc_id", "keep_uid": "row_uid", "keep_at": "at", "keep_start": "start", "keep_after": "after"}
    groups = materialize(groups.select("high", "low", *[F.col(f"first.{c}").alias(k) for k, c in first.items()], "n", "copies"), "passages")
    later = lookup(found, groups, ["high", "low"], "n", how="inner").where((F.col("row_uid") != F.col("keep_uid")) | (F.col("at") != F.col("keep_at")))
    own = F.col("row_uid") == F.col("keep_uid")
    later = later.select(
        "doc_id", "row_uid", "at", "end", "keep_uid", "keep_doc_id", "keep_start", "copies", own.alias("own"),
        F.when(own, F.greatest("start", "keep_after")).otherwise(F.col("start")).alias("start"),
        F.when(own, F.greatest("at", F.col("keep_at") + anchor)).otherwise(F.col("at")).alias("from"),
        F.when(own, 0).otherwise(F.col("at") - F.col("keep_at")).alias("shift"),
    )
    w = Window.partitionBy("row_uid", "keep_uid", "shift").orderBy("at")
    follows = F.col("at") <= F.lag("at").over(w) + anchor
    merged = later.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w))
    spans = merged.groupBy("row_uid", "keep_uid", "shift", "run").agg(
        F.first("doc_id").alias("doc_id"), F.first("own").alias("own"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("from").alias("from"), (F.max("at") + anchor).alias("to"),
        F.first("keep_doc_id").alias("keep_doc_id"), F.min("keep_start").alias("keep_start"), F.min("copies").alias("copies"),
    )
    spans = spans.withColumns({"span": F.monotonically_increasing_id(), "level": F.lit("passage"), "words": (F.col("to") - F.col("from")).cast("int")})
    spans = materialize(spans, "spans")
    discard(found, groups)
    wide = _widened(spans, again, size - anchor)
    discard(spans, again)
    return copies.unionByName(wide.select(copies.columns))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, uid: str | None = None) -> DataFrame:
    """Repeated units and repeated passages of docs, whose rows the column uid numbers, or which are numbered here. See repeated_units and repeated_passages."""
    kept, uid = (docs, uid) if uid else (docs.withColumn("__uid", F.monotonically_increasing_id()), "__uid")
    passages = repeated_passages(kept, uid=uid)
    return repeated_units(kept, min_words, uid).unionByName(passages)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text freed of repeated units and passages, and removed: the spans taken out, merged, as offsets in the original.

    Every row stays, with its own columns, of which only one named removed is replaced. White space around a removed unit stays as well;
    a null text stays null.
    """
    kept = materialize(docs.withColumn("__uid", F.monotonically_increasing_id()), "documents")
    spans = repeats(kept, min_words, "__uid").groupBy(F.col("row_uid").alias("__row")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__spans"))

    @F.pandas_udf("struct<text:string,removed:array<struct<start:int,end:int>>>")
    def strip(text, spans):
        import pandas as pd

        out = []
        for t, given in zip(text, spans, strict=True):
            merged: list[list[int]] = []
            for s in [] if given is None else given:
                if merged and s["start"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s["end"])
                else:
                    merged.append([s["start"], s["end"]])
            edges = [0, *(e for m in merged for e in m), len(t or "")]
            out.append((None if t is None else "".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), merged))
        return pd.DataFrame({"text": [t for t, _ in out], "removed": [[{"start": a, "end": b} for a, b in m] for _, m in out]})

    joined = kept.join(spans, F.col("__uid") == F.col("__row"), "left").withColumn("__new", strip("text", "__spans"))
    return joined.select(*[F.col("__new.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "removed"], F.col("__new.removed").alias("removed"))
