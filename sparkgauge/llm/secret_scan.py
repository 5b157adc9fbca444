r"""Secret scans: fixed patterns, and a guess-cost model on values in a credential context.

The model estimates how many guesses an attacker needs for a value. Dynamic programming finds its cheapest
segmentation into common words, dates, repeats, keyboard walks and brute-force spans; costs are log10
guesses and add up, with a little more for every further segment. A value that even the best
segmentation leaves expensive is taken for a secret; an easy one (a word, a placeholder) is not.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The base patterns and the least length of what must be long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "guess")

#: Wider contexts whose values the model judges. The hint is a cheap test that a text can have one at all.
HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth", "bearer", "login")
CONTEXT = re.compile(r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|(?:access|auth|session)[_-]?token|token|(?:api|access|secret|private)[_-]?key|credentials?|auth(?:orization)?|bearer|login)["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20+is\x20+|(?<=bearer)\x20+)["']?([^\s"'<>,;]+)""", re.IGNORECASE | re.ASCII)
#: log10 guesses from which a value counts as a secret.
MIN_GUESSES = 10.0
MIN_VALUE = 8

#: Words that attackers try first, commonest first.
WORDS = tuple("password qwerty admin welcome login letmein dragon master monkey shadow sunshine princess football baseball superman batman michael jordan charlie secret token test guest default changeme example sample user root system server database hello world love money summer winter spring autumn access account private public please trust freedom whatever killer soccer hockey computer internet google apple orange banana cookie pepper ginger tiger lion eagle falcon silver golden diamond crystal purple yellow green blue black white happy lucky angel flower star moon light magic wizard ninja pirate hunter ranger soldier thunder storm rocket turbo power".split())
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@8031!$5+7", "aaboeiisstt")
YEARS = r"(?:19|20)\d\d"
DATE = re.compile(rf"{YEARS}[-/._]?[01]?\d[-/._]?[0-3]?\d|[0-3]?\d[-/._]?[01]?\d[-/._]?{YEARS}|{YEARS}")
REPEAT = re.compile(r"(.{1,8}?)\1{1,}", re.DOTALL)

_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
_PLACE = {c: (x + y * 0.5, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
_MORE = math.log10(2)  # of each further segment


def _near(a: str, b: str) -> tuple[float, int] | None:
    p, q = _PLACE.get(a), _PLACE.get(b)
    if p and q and (step := (q[0] - p[0], q[1] - p[1])) != (0, 0) and abs(step[0]) <= 1 and abs(step[1]) <= 1:
        return step
    return None


def _pieces(value: str):
    """(start, end, log10 guesses) of every pattern in value but brute force."""
    low = value.lower()
    plain = low.translate(LEET) if len(low) == len(value) else low
    for i in range(len(low)):
        for j in range(i + 3, min(len(low), i + _LONGEST) + 1):
            if rank := _RANK.get(low[i:j]) or _RANK.get(plain[i:j]):
                turned = sum(a != b for a, b in zip(value[i:j], plain[i:j], strict=False))
                yield i, j, math.log10(rank) + turned * _MORE
    for m in DATE.finditer(value):
        yield m.start(), m.end(), math.log10(365 * 60 * 4 if m.end() - m.start() > 4 else 120)
    for m in REPEAT.finditer(value):
        unit = m[1]
        yield m.start(), m.end(), min(len(unit), guess_cost(unit) if len(unit) > 2 else len(unit)) + math.log10((m.end() - m.start()) // len(unit))
    i = 0
    while i < len(low) - 2:
        j, turns, step = i, 0, None
        while j + 1 < len(low) and (new := _near(low[j], low[j + 1])):
            turns, step, j = turns + (new != step), new, j + 1
        if j - i >= 2:
            yield i, j + 1, math.log10(47 * (j - i + 1)) + turns * math.log10(4)
        i = max(j, i + 1)


def guess_cost(value: str) -> float:
    """log10 of the guesses for value by its cheapest segmentation; linear in its length."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _pieces(value):
        ends.setdefault(j, []).append((i, cost))
    brute, other = [math.inf] * (len(value) + 1), [math.inf] * (len(value) + 1)
    other[0] = -_MORE
    for j in range(1, len(value) + 1):
        brute[j] = 1 + min(brute[j - 1], other[j - 1] + _MORE)
        for i, cost in ends.get(j, ()):
            other[j] = min(other[j], min(brute[i], other[i]) + _MORE + cost)
    return max(0.0, min(brute[-1], other[-1])) if value else 0.0


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans cover; spans that touch are one stretch."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scan(text: str | None, least: float = MIN_GUESSES) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses of the value) by start, then kind; whole text, code points, end exclusive.

    Base kinds are matched leftmost and without overlap each, and a match that is too short is dropped
    after it has taken its place; their values are not judged, so they have no guesses. A ``guess`` span is a value in a
    wider context that costs at least ``least`` and that base spans do not cover as a whole; a value that several contexts
    lead to is one span. Null and empty texts have none.
    """
    if not text:
        return []
    low = text.lower()
    found: list[tuple[str, int, int, float | None]] = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [("access", *m.span(), None) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    if any(h in low for h in HINTS):
        starts, ends = _merged([x[1:3] for x in found])
        for m in CONTEXT.finditer(text):
            s, e = m.span(1)
            at = bisect_right(starts, s) - 1
            covered = at >= 0 and e <= ends[at]
            if e - s >= MIN_VALUE and not covered and (cost := guess_cost(m[1])) >= least:
                found.append(("guess", s, e, cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("guesses", pa.float64())]))


@F.arrow_udf(T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("guesses", "double")))
def _scan_all(text: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "guesses"), x, strict=True)) for x in scan(t.as_py())] for t in text], SPANS)


def secret_spans(text: Column) -> Column:
    """All spans of a text column: array of (kind, start, end, guesses as log10). See scan."""
    return _scan_all(text)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
