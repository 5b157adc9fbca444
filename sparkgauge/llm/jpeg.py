"""Baseline JPEG in numpy: markers, Huffman coding of scans, and thumbnails of the DC coefficients.

Both directions work on many images at once. The reader cuts the coded data of all scans at their restart markers and
decodes these pieces in step, one symbol of every piece at a time; the writer ends a piece after every block, so that its
images are read in at most 64 steps, however large they are.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Blocks that are coded or decoded in step: their arrays stay in the processor's cache.
BLOCKS_AT_ONCE = 16384
#: Bytes of images that are read together.
BYTES_AT_ONCE = 1 << 20
MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
#: The first byte of a block is its mean, in steps of 8 / 8; the others are stored in steps of one.
QUANT = bytes([8] + [1] * 63)


def _lengths(short: dict[int, int], middle: list[int], rest: list[int]) -> tuple[bytes, bytes]:
    """Counts by length and symbols of a Huffman table: each of short with its length, middle with 9 bits, rest with 16."""
    by = {s: n for s, n in short.items()} | dict.fromkeys(middle, 9) | dict.fromkeys(rest, 16)
    order = sorted(by, key=lambda s: (by[s], s))
    return bytes(sum(by[s] == n for s in order) for n in range(1, 17)), bytes(order)


#: A value of n bits has a code of 8 - n, so the bytes of common texts stay bytes, and stored texts can still be compressed.
WHOLE_BYTES = {n: 8 - n for n in range(1, 8)}
DC_TABLE = _lengths(WHOLE_BYTES, [0, 8], [])
AC_TABLE = _lengths(WHOLE_BYTES, [0, 8], [0xF0, *(run << 4 | size for run in range(1, 16) for size in range(1, 9))])


class Corrupt(ValueError):
    """The bytes are no baseline JPEG."""


@lru_cache(256)
def _codes(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol; length 0: the table doesn't have it."""
    codes, lengths, code, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(table[0][n - 1]):
            codes[table[1][at]], lengths[table[1][at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths


@lru_cache(256)
def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: length * 256 + symbol, 0 where no code fits."""
    out, code, at = np.zeros(1 << 16, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(table[0][n - 1]):
            if code >= 1 << n or at >= len(table[1]):
                raise Corrupt("a Huffman table has too many codes")
            out[code << 16 - n : code + 1 << 16 - n] = n << 8 | table[1][at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


# Writing


@lru_cache(1)
def _words() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a byte after a run of 0 to 15 zeros, and in row 16 as a first coefficient: code and value together."""
    value = np.arange(256, dtype=np.uint8).view(np.int8).astype(np.int64)
    size = np.array([abs(int(v)).bit_length() for v in value])
    low = np.where(value < 0, value + (1 << size) - 1, value)
    pairs = [tuple(x[run << 4 | size] for x in _codes(AC_TABLE)) for run in range(16)] + [tuple(x[size] for x in _codes(DC_TABLE))]
    return np.concatenate([c << size | low for c, _ in pairs]), np.concatenate([n + size for _, n in pairs])


def _events(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, bits and number of bits of every code word, in order; blocks are rows of 64 coefficients of up to 8 bits."""
    n = len(blocks)
    mask = np.empty((n, 65), bool)
    mask[:, :64] = blocks != 0
    mask[:, 0] = True
    mask[:, 64] = ~mask[:, 63]  # end of block
    block, k = np.nonzero(mask)
    value = np.zeros((n, 65), np.uint8)
    value[:, :64] = blocks.view(np.uint8)
    value = value[block, k]
    words, lengths = _words()
    run = np.diff(k, prepend=0) - 1
    run[(k == 0) | (k == 64)] = 0
    row = np.where(k == 0, 16, run & 15) << 8 | value
    bits, length = words[row], lengths[row]
    if (long := run >> 4).any():  # runs of 16 zeros
        zeros, (code, size) = 0xF0, _codes(AC_TABLE)
        at = np.repeat(np.arange(len(k)), long + 1)
        last = np.concatenate([at[1:] != at[:-1], [True]])
        block, bits, length = block[at], np.where(last, bits[at], code[zeros]), np.where(last, length[at], size[zeros])
    return block, bits, length


def _coded(blocks: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coded bytes of blocks, each begun on a byte and followed by its restart marker (none where restart < 0), and where each ends."""
    n = len(blocks)
    block, bits, length = _events(blocks)
    ends = np.cumsum(length)
    last = np.searchsorted(block, np.arange(n), "right") - 1
    of_block = ends[last] - np.concatenate([[0], ends[last][:-1]])
    pad = -of_block % 8
    first_byte = np.concatenate([[0], np.cumsum((of_block + pad) // 8)])
    inside = ends - length - (ends[last] - of_block)[block]
    offset = np.concatenate([8 * first_byte[block] + inside, 8 * first_byte[1:] - pad])
    bits, length = np.concatenate([bits, (1 << pad) - 1]), np.concatenate([length, pad])
    word, byte = bits << (32 - offset % 8 - length), offset // 8
    out = sum(np.bincount(byte + j, (word >> (24 - 8 * j)) & 255, first_byte[-1] + 4) for j in range(4))[: first_byte[-1]].astype(np.uint8)
    width = 1 + (out == 255)
    width[first_byte[1:] - 1] += 2 * (restart >= 0)
    stops = np.cumsum(width)
    stuffed = np.zeros(int(stops[-1]), np.uint8)
    stuffed[stops - width] = out
    marked = stops[first_byte[1:] - 1][restart >= 0]
    stuffed[marked - 2], stuffed[marked - 1] = 255, 0xD0 + restart[restart >= 0]
    return stuffed, stops[first_byte[1:] - 1]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def header(width: int, height: int, comment: bytes) -> bytes:
    """All that stands before the coded data of a grey image of our own."""
    tables = b"".join(_segment(0xC4, bytes([kind]) + t[0] + t[1]) for kind, t in ((0x00, DC_TABLE), (0x10, AC_TABLE)))
    start = _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + _segment(0xFE, comment) + _segment(0xDB, b"\0" + QUANT)
    return b"\xff\xd8" + start + _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\0") + tables + _segment(0xDD, b"\0\x01") + _segment(0xDA, b"\x01\x01\0\0\x3f\0")


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of 64 bytes, as a grey image that holds it losslessly.

    64 bytes are the coefficients of a block in the order of the scan, each byte a number from -128 to 127: coding them loses
    nothing, while the samples that they stand for would be rounded. Blocks lie in rows about as long as there are rows, and
    zero blocks fill the last one; the comment says how many bytes count. Equal payloads give equal images.
    """
    shapes = [((n := len(p) // 64), (w := int(np.ceil(np.sqrt(n)))), -(-n // w)) for p in payloads]
    buffer = b"".join(p + bytes(64 * (w * h - n)) for p, (n, w, h) in zip(payloads, shapes, strict=True))
    blocks = np.frombuffer(buffer, np.int8).reshape(-1, 64)
    counts = np.array([w * h for _, w, h in shapes], np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    restart = (np.arange(len(blocks)) - np.repeat(firsts[:-1], counts)) % 8
    restart[firsts[1:] - 1] = -1
    parts: list[list[bytes]] = [[header(8 * w, 8 * h, b"payload=%d" % len(p))] for p, (_, w, h) in zip(payloads, shapes, strict=True)]
    for a in range(0, len(blocks), BLOCKS_AT_ONCE):
        b = min(a + BLOCKS_AT_ONCE, len(blocks))
        data, stops = _coded(blocks[a:b], restart[a:b])
        data, at = data.tobytes(), a
        for i in range(int(np.searchsorted(firsts, a, "right")) - 1, len(payloads)):
            if firsts[i] >= b:
                break
            until = min(b, int(firsts[i + 1]))
            parts[i].append(data[int(stops[at - a - 1]) if at > a else 0 : int(stops[until - a - 1])])
            at = until
    return [b"".join([*x, b"\xff\xd9"]) for x in parts]


# Reading


@dataclass
class Part:
    """A component of an image: its sampling and what has been decoded of it."""

    h: int
    v: int
    quant: int
    coefficients: np.ndarray | None = None


@dataclass
class Scan:
    parts: list[int]
    tables: list[tuple[np.ndarray, np.ndarray]]
    start: int
    end: int
    restart: int


@dataclass
class Image:
    """A parsed image; error says why it couldn't be read, and is None for a good one."""

    width: int = 0
    height: int = 0
    parts: list[Part] = field(default_factory=list)
    quants: dict[int, int] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""
    error: str | None = None

    def grid(self, part: Part, alone: bool) -> tuple[int, int]:
        """Columns and rows of a component's blocks, in a scan of its own or padded to whole units of several components."""
        most_h, most_v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        if alone:
            return -(-(-(-self.width * part.h // most_h)) // 8), -(-(-(-self.height * part.v // most_v)) // 8)
        return -(-self.width // (8 * most_h)) * part.h, -(-self.height // (8 * most_v)) * part.v

    def units(self, scan: Scan) -> int:
        """Units (MCUs) of a scan: blocks of its only component, or groups of blocks of several."""
        across, down = self.grid(part := self.parts[scan.parts[0]], len(scan.parts) == 1)
        return across * down // (1 if len(scan.parts) == 1 else part.h * part.v)

    def pattern(self, scan: Scan) -> list[int]:
        """The place among scan.parts of each block of a unit."""
        return [0] if len(scan.parts) == 1 else [i for i, p in enumerate(scan.parts) for _ in range(self.parts[p].h * self.parts[p].v)]

    def thumbnail(self) -> np.ndarray:
        """Luminance of the first component, a sample for each of its blocks: from DC coefficients only."""
        part = self.parts[0]
        across, down = self.grid(part, True)
        return np.clip(np.floor(part.coefficients[:down, :across, 0] * self.quants[part.quant] / 8 + 128.5), 0, 255).astype(np.uint8)


def parse(data: bytes) -> Image:
    """Markers and tables of an image; coded data is only delimited."""
    out = Image()
    try:
        _parse(data, out)
    except (Corrupt, struct.error, IndexError) as e:
        out.error = str(e) or "cut off"
    return out


def _parse(data: bytes, out: Image) -> None:
    if data[:2] != b"\xff\xd8":
        raise Corrupt("no start of image")
    at, tables, restart, ids = 2, {}, 0, []
    while True:
        if at + 1 >= len(data) or data[at] != 255:
            raise Corrupt("no marker where one must stand")
        while at + 1 < len(data) and data[at + 1] == 255:  # fill bytes
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            break
        if marker in (0xD8, 0x00, 0x01) or 0xD0 <= marker <= 0xD7:
            raise Corrupt("a marker out of place")
        (n,) = struct.unpack_from(">H", data, at + 2)
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if n < 2 or at > len(data):
            raise Corrupt("cut off")
        if marker == 0xFE:
            out.comment = body
        elif marker == 0xDB:
            while body:
                wide, number = body[0] >> 4, body[0] & 15
                if wide > 1 or len(body) < 1 + 64 * (wide + 1):
                    raise Corrupt("a quantisation table is cut off")
                out.quants[number], body = int.from_bytes(body[1 : 2 + wide], "big"), body[1 + 64 * (wide + 1) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n or body[0] & 0xEC:
                    raise Corrupt("a Huffman table is cut off")
                tables[body[0]], body = _lookup((body[1:17], body[17 : 17 + n])), body[17 + n :]
        elif marker == 0xC0:
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out.height or not out.width or out.parts:
                raise Corrupt("not one frame of 8-bit samples of known size")
            ids = [body[6 + 3 * i] for i in range(n)]
            out.parts = [Part(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if not n or any(not 1 <= x <= 4 for p in out.parts for x in (p.h, p.v)):
                raise Corrupt("sampling factors out of range")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Corrupt("not baseline")
        elif marker == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif marker == 0xDA:
            picked = [(ids.index(body[1 + 2 * i]) if body[1 + 2 * i] in ids else -1, body[2 + 2 * i]) for i in range(body[0])]
            if not picked or any(i < 0 for i, _ in picked) or body[1 + 2 * len(picked) :] != b"\0\x3f\0":
                raise Corrupt("a scan of unknown components or of parts of blocks")
            if any(t >> 4 not in tables or 0x10 | t & 15 not in tables for _, t in picked):
                raise Corrupt("a scan without its Huffman tables")
            if not (found := MARKER.search(data, at)):
                raise Corrupt("coded data without an end")
            out.scans.append(Scan([i for i, _ in picked], [(tables[t >> 4], tables[0x10 | t & 15]) for _, t in picked], at, found.start(), restart))
            at = found.start()
    if not out.parts or {p for s in out.scans for p in s.parts} != set(range(len(out.parts))):
        raise Corrupt("components without a scan")
    if out.parts[0].quant not in out.quants:
        raise Corrupt("no quantisation table")


def _in_step(data: np.ndarray, first: np.ndarray, end: np.ndarray, blocks: np.ndarray, base: np.ndarray, kind: np.ndarray, patterns: list[tuple[np.ndarray, np.ndarray, np.ndarray]], tables: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Decode pieces of coded data into the rows of out, all pieces in step; which of them are broken.

    first and end are bytes of data, blocks how many each piece holds, base the row of the first one, kind its row of the
    patterns: by block of a unit, the number of its component, and of its DC and AC tables.
    """
    windows = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    size = np.array([len(p[0]) for p in patterns])
    part_of, dc_of, ac_of = (np.zeros((len(patterns), size.max()), np.int64) for _ in range(3))
    for i, p in enumerate(patterns):
        part_of[i, : size[i]], dc_of[i, : size[i]], ac_of[i, : size[i]] = p
    broken = np.zeros(len(first), bool)
    at, k, block, before = 8 * first.astype(np.int64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros((len(first), 4), np.int64)
    live = np.flatnonzero(blocks > 0)
    simple = bool((size == 1).all())
    while len(live):
        pos, kk, of = at[live], k[live], kind[live]
        turn = 0 if simple else block[live] % size[of]
        starts = kk == 0
        word = windows[np.minimum(pos >> 3, len(windows) - 1)].astype(np.uint64) << (pos & 7).astype(np.uint64)
        entry = tables[np.where(starts, dc_of[of, turn], ac_of[of, turn]), (word >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry >> 8, entry & 255
        bits, run = np.where(starts, symbol, symbol & 15), np.where(starts, 0, symbol >> 4)
        amount = (((word << length.astype(np.uint64)) >> np.uint64(1)) >> (63 - bits).clip(0).astype(np.uint64)).astype(np.int64)
        value = np.where((bits > 0) & (amount < (1 << bits >> 1)), amount - (1 << bits) + 1, amount)
        pos += length + bits
        if starts.any():
            who = live[starts]
            part = part_of[of, turn][starts]
            value[starts] += before[who, part]
            before[who, part] = value[starts]
        put = kk + run
        wrong = (length == 0) | (bits > 11) | (pos > 8 * end[live]) | ((bits > 0) & (put > 63))
        write = (starts | (bits > 0)) & ~wrong
        out[(base[live] + block[live])[write], put[write]] = value[write]
        after = np.where(starts | (bits > 0), put + 1, np.where(run == 15, kk + 16, 64))
        over = after >= 64
        at[live], k[live] = pos, np.where(over, 0, after)
        block[live] += over
        broken[live] |= wrong
        if over.any() or wrong.any():
            live = live[~wrong & (block[live] < blocks[live])]
    return broken


def _pieces(buffer: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The coded data without stuffed zeros, padded, and for each span the first bytes and the ends of its pieces there; an empty list if its restart markers are out of order."""
    full = np.flatnonzero(buffer[:-1] == 255)
    after = buffer[full + 1]
    stuffed, marks = full[after == 0] + 1, full[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(buffer), bool)
    keep[stuffed] = False
    moved = lambda x: x - np.searchsorted(stuffed, x)
    out = []
    for a, b in spans:
        mine = marks[np.searchsorted(marks, a) : np.searchsorted(marks, b - 1)]
        right = np.array_equal(buffer[mine + 1] - 0xD0, np.arange(len(mine)) % 8)
        out.append((moved(np.concatenate([[a], mine + 2])), moved(np.concatenate([mine, [b]]))) if right else (mine[:0], mine[:0]))
    return np.concatenate([buffer[keep], np.zeros(16, np.uint8)]), out


def decode(files: list[bytes]) -> Iterator[Image]:
    """The images, in order, with all coefficients, or with an error. Files are read together up to BYTES_AT_ONCE, so memory follows the largest one."""
    group: list[bytes] = []
    held = 0
    for data in files:
        if group and held + len(data) > BYTES_AT_ONCE:
            yield from _decode(group)
            group, held = [], 0
        group.append(data)
        held += len(data)
    yield from _decode(group)


def _decode(files: list[bytes]) -> list[Image]:
    images = [parse(d) for d in files]
    scans = [(i, s) for i, x in enumerate(images) if not x.error for s in x.scans]
    if not scans:
        return images
    joined = b"".join(files[i][s.start : s.end] + b"\0\0" for i, s in scans)
    stops = np.cumsum([s.end - s.start + 2 for _, s in scans])
    data, pieces = _pieces(np.frombuffer(joined, np.uint8), [(int(b) - 2 - (s.end - s.start), int(b) - 2) for b, (_, s) in zip(stops, scans, strict=True)])
    tables, numbers, patterns, known = [], {}, [], {}
    first, end, blocks, base, kind, owner, rows = [], [], [], [], [], [], 0
    bases = []
    for (i, s), (a, b) in zip(scans, pieces, strict=True):
        x, shape = images[i], images[i].pattern(s)
        units, each = x.units(s), s.restart or x.units(s)
        bases.append(rows)
        if len(a) != -(-units // each) or len(shape) > 10:
            x.error = "restart markers missing or out of order" if len(shape) <= 10 else "too many blocks in a unit"
            continue
        picked = []
        for pair in s.tables:
            for t in pair:
                if id(t) not in numbers:
                    numbers[id(t)] = len(tables)
                    tables.append(t)
            picked.append(tuple(numbers[id(t)] for t in pair))
        key = tuple((p, *picked[p]) for p in shape)
        if key not in known:
            known[key] = len(patterns)
            patterns.append(tuple(np.array(c) for c in zip(*key, strict=True)))
        n = np.full(len(a), each * len(shape), np.int64)
        n[-1] = (units - each * (len(a) - 1)) * len(shape)
        first.append(a), end.append(b), blocks.append(n), base.append(rows + np.cumsum(n) - n)
        kind.append(np.full(len(a), known[key])), owner.append(np.full(len(a), i))
        rows += int(n.sum())
    if not first:
        return images
    first, end, blocks, base, kind, owner = map(np.concatenate, (first, end, blocks, base, kind, owner))
    out, stacked = np.zeros((rows, 64), np.int16), np.stack(tables)
    for a in range(0, len(first), BLOCKS_AT_ONCE):
        p = slice(a, a + BLOCKS_AT_ONCE)
        broken = _in_step(data, first[p], end[p], blocks[p], base[p], kind[p], patterns, stacked, out)
        for i in np.unique(owner[p][broken]):
            images[i].error = "the coded data is broken"
    for (i, s), a in zip(scans, bases, strict=True):
        if not images[i].error:
            _place(images[i], s, out[a:])
    return images


def _place(image: Image, scan: Scan, rows: np.ndarray) -> None:
    """Give each component of a scan its blocks, as (down, across, 64)."""
    if len(scan.parts) == 1:
        part = image.parts[scan.parts[0]]
        across, down = image.grid(part, True)
        part.coefficients = rows[: across * down].reshape(down, across, 64)
        return
    units, at = image.units(scan), 0
    step = len(image.pattern(scan))
    unit = rows[: units * step].reshape(units, step, 64)
    for number in scan.parts:
        part = image.parts[number]
        across, down = image.grid(part, False)
        mine = unit[:, at : at + part.h * part.v].reshape(down // part.v, across // part.h, part.v, part.h, 64)
        part.coefficients = mine.transpose(0, 2, 1, 3, 4).reshape(down, across, 64)
        at += part.h * part.v


def payload(image: Image) -> bytes:
    """What encode() stored in a good image; Corrupt if it is none of its images."""
    found = re.fullmatch(rb"payload=(\d+)", image.comment)
    held = image.parts[0].coefficients
    if not found or len(image.parts) != 1 or int(found[1]) > held.size:
        raise Corrupt("the image holds no payload")
    return held.astype(np.int8).tobytes()[: int(found[1])]
